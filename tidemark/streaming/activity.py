"""The activity log as a stream: weekly counts, and events that follow each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

SCHEMA = "activity_id bigint, repo string, file_path string, event_kind string, commit_sha string, actor string, churn bigint, happened_at timestamp, received_at timestamp"


def read(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of the log as they come."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once(events: DataFrame, delay: str = "120 days") -> DataFrame:
    """Each activity once; redeliveries are known as long as they come within the delay of the first one's time."""
    return events.where("happened_at is not null").withWatermark("happened_at", delay).dropDuplicatesWithinWatermark(["activity_id"])


def weekly(events: DataFrame) -> DataFrame:
    """(repo, week, events, churn): counts by week from Monday; events later than the watermark are not counted any more."""
    w = F.window("happened_at", "7 days", "7 days", "4 days")
    return events.groupBy("repo", w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(F.when(F.col("churn") >= 0, F.col("churn"))), F.lit(0)).alias("churn")).select("repo", F.unix_seconds("w.start").alias("week"), "events", "churn")


def followed(events: DataFrame, first: str, then: str, within: str = "7 days") -> DataFrame:
    """(repo, file_path, first_id, then_id): an event of one kind followed by one of another at the same file in time.

    A join of the stream with itself; the events carry a watermark on happened_at (as
    those of ``once`` do), and state is let go once it is past the interval.
    """
    kind = F.lower(F.trim("event_kind"))
    a = events.where(kind == first).select(F.col("repo").alias("a_repo"), F.col("file_path").alias("a_path"), F.col("activity_id").alias("first_id"), F.col("happened_at").alias("a_at"))
    b = events.where(kind == then).select(F.col("repo").alias("b_repo"), F.col("file_path").alias("b_path"), F.col("activity_id").alias("then_id"), F.col("happened_at").alias("b_at"))
    on = (F.col("a_repo") == F.col("b_repo")) & (F.col("a_path") == F.col("b_path")) & (F.col("b_at") > F.col("a_at")) & (F.col("b_at") <= F.col("a_at") + F.expr(f"interval {within}"))
    return a.join(b, on).select(F.col("a_repo").alias("repo"), F.col("a_path").alias("file_path"), "first_id", "then_id")


def run_once(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All there is now, as a table in the shared folder: complete results are replaced batch by batch, others appended."""
    import uuid

    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/table")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table")
