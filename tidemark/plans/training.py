"""Queries of the general operators for training data (p5, p7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import known_at_event
from tidemark.operators.wide import column_names, wide_features

VALUES = ["previous_change_count", "historical_cochange_frequency"]


def _known(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{d}/dataset_rows.parquet").select(
        "row_id", "repo", "file_path", "timestamp", *[F.col(f"historical.{v}").alias(v) for v in VALUES])
    facts = spark.read.parquet(f"{d}/file_facts.parquet").select("fact_id", "repo", "file_path", "valid_from", "known_at", *VALUES)
    return rows, facts


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """row_id of the dataset rows that carry other values than were known before their time."""
    rows, facts = _known(spark, d)
    known = known_at_event(rows, facts, ["repo", "file_path"], "row_id", "timestamp", "valid_from", "known_at", "fact_id", VALUES, default=0, carry=VALUES)
    wrong = F.lit(False)
    for v in VALUES:
        wrong = wrong | ~F.col(v).eqNullSafe(F.col(f"known_{v}"))
    return known.where(wrong).select("row_id")


def p5_known(spark: SparkSession, d: str) -> DataFrame:
    """Each dataset row with the values that were known before its time."""
    rows, facts = _known(spark, d)
    return known_at_event(rows, facts, ["repo", "file_path"], "row_id", "timestamp", "valid_from", "known_at", "fact_id", VALUES, default=0)


def p7_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per file with count, last time, time since and churn for every kind of event."""
    return wide_features(spark.read.parquet(f"{d}/file_activity.parquet"), spark.read.parquet(f"{d}/event_kinds.parquet"), ["repo", "file_path"])


P5_KNOWN = """
WITH b AS (
  SELECT r.row_id, max(f.fact_id) IS NOT NULL AS is_known,
    arg_max(f.previous_change_count, (f.valid_from, f.known_at, f.fact_id)) AS p,
    arg_max(f.historical_cochange_frequency, (f.valid_from, f.known_at, f.fact_id)) AS h
  FROM dataset_rows r LEFT JOIN file_facts f ON r.repo = f.repo AND r.file_path = f.file_path
    AND f.valid_from < r.timestamp AND f.known_at < r.timestamp
  GROUP BY r.row_id)
SELECT row_id, coalesce(p, 0) AS known_previous_change_count, coalesce(h, 0) AS known_historical_cochange_frequency, is_known FROM b"""

P5_FOUND = f"""
SELECT r.row_id FROM dataset_rows r JOIN ({P5_KNOWN}) k USING (row_id)
WHERE r.historical.previous_change_count IS DISTINCT FROM k.known_previous_change_count
   OR r.historical.historical_cochange_frequency IS DISTINCT FROM k.known_historical_cochange_frequency"""

# The families and steps whose pairs are the 240 kinds of event_kinds.
FAMILIES = "access audit blame build change coverage deploy docs format issue lint lock merge mirror notify release review scan search test".split()


def p7_sql(kinds: list[str]) -> str:
    names = column_names(kinds)
    parts = []
    for kind, name in zip(kinds, names):
        parts.append(
            f"""sum(CASE WHEN kind = '{kind}' THEN n ELSE 0 END)::BIGINT AS {name}_count,
            max(CASE WHEN kind = '{kind}' THEN timezone('UTC', last_at) END) AS {name}_last_at,
            max(CASE WHEN kind = '{kind}' THEN since END) AS {name}_secs_since,
            sum(CASE WHEN kind = '{kind}' THEN churn ELSE 0 END)::BIGINT AS {name}_churn""")
    return f"""
WITH top AS (SELECT max(received_at) AS t FROM file_activity),
once AS (
  SELECT activity_id, any_value(repo) AS repo, any_value(file_path) AS file_path, any_value(lower(trim(event_kind))) AS kind,
    any_value(happened_at) AS happened_at, any_value(churn) AS churn FROM file_activity GROUP BY activity_id),
sums AS (
  SELECT repo, file_path, kind, count(*) AS n, max(happened_at) AS last_at,
    (floor((epoch_us((SELECT t FROM top)) - epoch_us(max(happened_at))) / 1000000.0))::BIGINT AS since,
    coalesce(sum(CASE WHEN churn >= 0 THEN churn END), 0) AS churn
  FROM once GROUP BY repo, file_path, kind)
SELECT repo, file_path, {', '.join(parts)} FROM sums GROUP BY repo, file_path"""


QUERIES = {"p5_found": p5_found, "p5_known": p5_known, "p7_features": p7_features}

# The steps of the kinds, in the order of their kind_id within a family.
STEPS = "open close edit comment approve reject retry fail pass skip queue assign".split()

ORACLES = {"p5_known": P5_KNOWN, "p5_found": P5_FOUND, "p7_features": p7_sql([f"{f}.{s}" for f in FAMILIES for s in STEPS])}
