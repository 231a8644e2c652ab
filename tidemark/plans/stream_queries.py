"""Queries of the streams, run over all there is and compared with what a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.streaming import activity


def weekly_activity_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events and churn of every repository by week, each activity counted once."""
    return activity.run_once(activity.weekly(activity.once(activity.read(spark, f"{d}/file_activity.parquet*"), "4000 days")), "weekly", "complete")


def followed_stream(spark: SparkSession, d: str) -> DataFrame:
    """A change closed at a file within a week of its opening."""
    return activity.run_once(activity.followed(activity.once(activity.read(spark, f"{d}/file_activity.parquet*"), "4000 days"), "change.open", "change.close"), "followed", "append")


QUERIES = {"weekly_activity_stream": weekly_activity_stream, "followed_stream": followed_stream}

ONCE = "(SELECT activity_id, any_value(repo) AS repo, any_value(file_path) AS file_path, any_value(lower(trim(event_kind))) AS kind, any_value(happened_at) AS happened_at, any_value(churn) AS churn FROM file_activity WHERE happened_at IS NOT NULL GROUP BY activity_id)"
ORACLES = {
    "weekly_activity_stream": f"SELECT repo, (floor((epoch(happened_at) - 345600) / 604800.0) * 604800 + 345600)::BIGINT AS week, count(*) AS events, coalesce(sum(CASE WHEN churn >= 0 THEN churn END), 0)::BIGINT AS churn FROM {ONCE} GROUP BY 1, 2",
    "followed_stream": f"SELECT a.repo, a.file_path, a.activity_id AS first_id, b.activity_id AS then_id FROM {ONCE} a JOIN {ONCE} b ON a.repo = b.repo AND a.file_path = b.file_path AND a.kind = 'change.open' AND b.kind = 'change.close' AND b.happened_at > a.happened_at AND b.happened_at <= a.happened_at + INTERVAL 7 DAY",
}
