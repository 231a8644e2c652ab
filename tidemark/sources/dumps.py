"""Saved answers of a forge, labelled rows and labels, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators.prediction import HISTORICAL, STRUCTURAL, TEMPORAL
from tidemark.sources.git import COMMITS

TREE = "truncated boolean, tree array<struct<path:string,mode:string,type:string,size:bigint,sha:string,url:string>>"
COMMIT = "sha string, html_url string, commit struct<message:string,author:struct<name:string,email:string,date:string>>, stats struct<additions:bigint,deletions:bigint,total:bigint>, files array<struct<filename:string,additions:bigint,deletions:bigint,changes:bigint,status:string>>"
BLOB = "path string, encoding string, content string, size bigint"
REPOSITORY = "id bigint, name string, full_name string, description string, default_branch string, language string, stargazers_count bigint, forks_count bigint, open_issues_count bigint, size bigint, created_at string, updated_at string, pushed_at string"
DATASET = (
    "commit_sha string, timestamp bigint, file_path string, label int"
    f", structural struct<file_path:string,{','.join(c + ':bigint' for c in STRUCTURAL)}>"
    f", historical struct<file_path:string,{','.join(c + (':double' if c == 'recent_change_frequency' else ':bigint') for c in HISTORICAL)}>"
    f", temporal struct<file_path:string,{','.join(c + ':bigint' for c in TEMPORAL)}>, _bad string"
)


class BadInput(ValueError):
    """Input that is not what it has to be."""


def read_repository(spark: SparkSession, path: str) -> DataFrame:
    """Repositories' metadata, one JSON object a line or file."""
    return spark.read.schema(REPOSITORY).option("multiLine", "true").json(path)


def read_tree(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """(repo, path, type, size, sha, url, truncated) of a saved recursive tree."""
    return spark.read.schema(TREE).option("multiLine", "true").json(path).select(F.lit(repo).alias("repo"), F.explode("tree").alias("t"), "truncated").select("repo", "t.path", "t.type", "t.size", "t.sha", "t.url", "truncated")


def read_commits(spark: SparkSession, path: str, repo: str, most: int | None = None) -> DataFrame:
    """Commits of saved pages (an array or an object per file), oldest first by time; only the last ``most`` if given."""
    c = spark.read.schema(COMMIT).option("multiLine", "true").json(path).where("sha is not null").dropDuplicates(["sha"])
    out = c.select(
        F.lit(repo).alias("repo"), "sha", "commit.message", "commit.author", F.unix_timestamp(F.try_to_timestamp("commit.author.date")).alias("timestamp"), F.col("commit.author.date").alias("date"), F.col("html_url").alias("url"), "stats", F.coalesce("files", F.array()).alias("files"))
    if most is not None:
        out = out.orderBy(F.desc_nulls_last("timestamp"), "sha").limit(most)
    return out.to(spark.createDataFrame([], COMMITS).schema)


def read_blobs(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """(repo, path, content, size_bytes) of saved blobs that are source candidates and valid UTF-8 once decoded."""
    b = spark.read.schema(BLOB).json(path).where(paths.is_source_candidate(F.col("path"), F.col("size")))
    raw = F.when(F.col("encoding") == "base64", F.try_to_binary(F.regexp_replace("content", r"\s", ""), F.lit("base64"))).otherwise(F.encode("content", "UTF-8"))
    return b.withColumn("raw", raw).where(F.col("raw").isNotNull() & F.is_valid_utf8(F.col("raw").cast("string"))).select(F.lit(repo).alias("repo"), "path", F.col("raw").cast("string").alias("content"), F.octet_length("raw").cast("bigint").alias("size_bytes"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows, one JSON object a line; blank lines are skipped.

    Raises BadInput where a line is no object, lacks a key or has another label than 0
    or 1, and where there is no row at all.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", DATASET, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("value", "r.*")
    keys = ["commit_sha", "timestamp", "file_path", "label", "structural", "historical", "temporal"]
    wrong = F.col("_bad").isNotNull() | ~F.col("label").isin(0, 1)
    for k in keys:
        wrong = wrong | F.col(k).isNull()
    n, bad, first = rows.agg(F.count(F.lit(1)), F.count_if(F.coalesce(wrong, F.lit(True))), F.min(F.when(F.coalesce(wrong, F.lit(True)), F.col("value")))).collect()[0]
    if not n:
        raise BadInput(f"no rows in {path}")
    if bad:
        raise BadInput(f"{bad} bad rows in {path}, one of them: {first[:200]}")
    return rows.select(*keys)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(previous_sha, current_sha, actual_rework) of a CSV with or without a header; raises BadInput with the line's number.

    A file of reviewed labels is small; its lines are checked on the driver.
    """
    rows = []
    for number, line in enumerate((r["value"] for r in spark.read.text(path, wholetext=False).coalesce(1).toLocalIterator()), 1):
        cells = [c.strip() for c in line.split(",")]
        if not line.strip() or number == 1 and cells[0].lower() == "previous_sha":
            continue
        if len(cells) != 3 or cells[2].lower() not in ("true", "false"):
            raise BadInput(f"line {number}: {line.strip()[:100]}")
        rows.append((cells[0], cells[1], cells[2].lower() == "true"))
    return spark.createDataFrame(rows, "previous_sha string, current_sha string, actual_rework boolean")
