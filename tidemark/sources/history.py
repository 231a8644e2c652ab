"""Commits as one row each and as one row per changed file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import paths


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_commits(commits: DataFrame) -> DataFrame:
    """Each (repo, sha) once, as it was fetched last; ts is the timestamp, t0 the timestamp or 0, who the author's key."""
    last = Window.partitionBy("repo", "sha").orderBy(F.desc("fetched_at"))
    bare = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    return commits.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k").select(
        "*", F.col("timestamp").alias("ts"), F.coalesce("timestamp", F.lit(0)).alias("t0"), F.coalesce(bare("author.email"), bare("author.name")).alias("who"))


def changes(commits: DataFrame) -> DataFrame:
    """(repo, sha, ts, t0, who, message, pos, path, additions, deletions) of the files not ignored."""
    rows = commits.select("repo", "sha", "ts", "t0", "who", "message", F.posexplode("files").alias("pos", "f"))
    return rows.select("repo", "sha", "ts", "t0", "who", "message", "pos", F.col("f.filename").alias("path"), F.col("f.additions").alias("additions"), F.col("f.deletions").alias("deletions")).where(
        F.col("path").isNotNull() & ~paths.is_ignored(F.col("path")))


def commit_files(commits: DataFrame) -> DataFrame:
    """(repo, sha, ts, t0, who, message, files): the distinct files not ignored, sorted; commits without any have an empty array."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("files", F.array()), lambda f: f.filename), lambda p: p.isNotNull() & ~paths.is_ignored(p))))
    return commits.select("repo", "sha", "ts", "t0", "who", "message", names.alias("files"))


def load(spark: SparkSession, folder: str) -> DataFrame:
    return latest_commits(table(spark, folder, "commits"))


# The same in SQL, for the oracles: c commits, ch changes, cf commits with their files.
IGNORED_SQL = "len(list_intersect(string_split(lower({p}), '/'), ['.git', 'target', 'node_modules', 'dist', 'build'])) > 0"
BASE_SQL = f"""
c AS (SELECT *, timestamp AS ts, coalesce(timestamp, 0) AS t0, coalesce(nullif(trim(author.email), ''), nullif(trim(author.name), '')) AS who
  FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY fetched_at DESC) AS k FROM commits) WHERE k = 1),
ch AS (SELECT repo, sha, ts, t0, who, message, (i - 1)::INTEGER AS pos, f.filename AS path, f.additions AS additions, f.deletions AS deletions
  FROM (SELECT repo, sha, ts, t0, who, message, unnest(files) AS f, generate_subscripts(files, 1) AS i FROM c)
  WHERE f.filename IS NOT NULL AND NOT ({IGNORED_SQL.format(p='f.filename')})),
cf AS (SELECT c.repo, c.sha, c.ts, c.t0, c.who, c.message, coalesce(x.files, []) AS files FROM c
  LEFT JOIN (SELECT repo, sha, list_sort(list_distinct(list(path))) AS files FROM ch GROUP BY repo, sha) x ON x.repo = c.repo AND x.sha = c.sha)"""
