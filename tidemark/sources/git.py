"""A local git repository as tables: its log, its tree and its texts."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import paths

RECORD, FIELD = "\x1e", "\x1f"
LOG_FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f{date}%x1f{message}%x1f"
COMMITS = "repo string, sha string, message string, author struct<name:string,email:string,date:string>, timestamp bigint, date string, url string, stats struct<additions:bigint,deletions:bigint,total:bigint>, files array<struct<filename:string,additions:bigint,deletions:bigint,changes:bigint,status:string>>"


class RepositoryError(ValueError):
    """A path that is no readable git repository."""


def check(path: str) -> Path:
    """The path, if it is a directory with a git repository."""
    p = Path(path)
    if not p.exists():
        raise RepositoryError(f"not found: {path}")
    if not p.is_dir():
        raise RepositoryError(f"not a directory: {path}")
    try:
        run(p, "rev-parse", "--git-dir")
    except (subprocess.CalledProcessError, PermissionError) as e:
        raise RepositoryError(f"not a git repository: {path}") from e
    return p


def run(path: Path, *args: str) -> str:
    return subprocess.run(["git", "-c", "core.quotePath=false", "-C", str(path), *args], check=True, capture_output=True, timeout=600).stdout.decode("utf-8", "replace")


def log_text(path: str, most: int = 1000, committer_date: bool = False, subject: bool = False) -> tuple[str, str]:
    """The last commits' log with line counts and with status letters: git keeps only one of the two at a time."""
    form = LOG_FORMAT.format(date="%cI" if committer_date else "%aI", message="%s" if subject else "%B")
    p = check(path)
    base = ["log", f"-n{most}", "--reverse", "-M", "-C", f"--format={form}"]
    return run(p, *base, "--numstat"), run(p, *base, "--name-status")


def _records(text: DataFrame) -> DataFrame:
    """(repo, sha, name, email, date, message, lines) out of a column ``value`` of one record each."""
    f = F.split("value", FIELD)
    at = lambda i: F.get(f, F.lit(i))
    return text.where(F.size(f) >= 6).select(
        "repo", F.trim(at(0)).alias("sha"), at(1).alias("name"), at(2).alias("email"), at(3).alias("date"), F.regexp_replace(at(4), r"\s+\z", "").alias("message"), F.filter(F.split(at(5), "\n"), lambda x: x != "").alias("lines"))


def parse(numstat: DataFrame, status: DataFrame) -> DataFrame:
    """Commits from two logs of (repo, value), one record a row: line counts, and status letters with paths.

    A rename or copy is known by its new path; a file without a letter is modified;
    binary files have no lines. Timestamps that are no dates are null.
    """
    counts = _records(numstat)
    part: Column = F.split("x", "\t")
    n = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))
    files = counts.select("repo", "sha", F.posexplode("lines").alias("pos", "x")).select("repo", "sha", "pos", n(part[0]).alias("additions"), n(part[1]).alias("deletions"), paths.renamed(part[2]).alias("filename"))
    letters = _records(status).select("repo", "sha", F.explode("lines").alias("x")).select("repo", "sha", paths.status(part[0]).alias("status"), F.element_at(part, -1).alias("filename")).dropDuplicates(["repo", "sha", "filename"])
    f = files.join(letters, ["repo", "sha", "filename"], "left").groupBy("repo", "sha").agg(F.array_sort(F.collect_list(F.struct("pos", "filename", "additions", "deletions", (F.col("additions") + F.col("deletions")).alias("changes"), F.coalesce("status", F.lit("modified")).alias("status")))).alias("f"))
    total = lambda name: F.aggregate("files", F.lit(0).cast("bigint"), lambda a, x: a + x[name])
    out = counts.join(f, ["repo", "sha"], "left").withColumn("files", F.coalesce(F.transform("f", lambda x: F.struct(x.filename.alias("filename"), x.additions.alias("additions"), x.deletions.alias("deletions"), x.changes.alias("changes"), x.status.alias("status"))), F.array().cast("array<struct<filename:string,additions:bigint,deletions:bigint,changes:bigint,status:string>>")))
    return out.select(
        "repo", "sha", "message", F.struct("name", "email", "date").alias("author"), F.unix_timestamp(F.try_to_timestamp("date")).alias("timestamp"), "date", F.lit(None).cast("string").alias("url"),
        F.struct(total("additions").alias("additions"), total("deletions").alias("deletions"), (total("additions") + total("deletions")).alias("total")).alias("stats"), "files")


def read_log_files(spark: SparkSession, numstat: str, status: str, repo: str) -> DataFrame:
    """Commits from log files written with LOG_FORMAT, read in parallel by record."""
    read = lambda p: spark.read.text(p, lineSep=RECORD).select(F.lit(repo).alias("repo"), "value")
    return parse(read(numstat), read(status))


def read_commits(spark: SparkSession, path: str, repo: str | None = None, most: int = 1000, **options: bool) -> DataFrame:
    """The last commits of a local repository (at most ``most``, which the driver holds)."""
    repo = repo or Path(path).name
    rows = [[(repo, r) for r in text.split(RECORD) if r.strip()] for text in log_text(path, most, **options)]
    return parse(*[spark.createDataFrame(r, "repo string, value string") for r in rows])


def read_tree(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """(repo, path, type, size, sha) of the files of HEAD, by path."""
    rows = []
    for line in run(check(path), "ls-tree", "-r", "-l", "HEAD").splitlines():
        meta, name = line.split("\t", 1)
        _, kind, sha, size = meta.split()
        rows.append((repo or Path(path).name, name.strip('"'), kind, int(size) if size.isdigit() else None, sha))
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "repo string, path string, type string, size bigint, sha string")


def read_sources(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """(repo, path, content, size_bytes) of the working tree's source candidates that are valid UTF-8."""
    root = str(check(path).resolve())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{root}/", "")
    f = files.select(F.lit(repo or Path(path).name).alias("repo"), name.alias("path"), "content", F.col("length").alias("size_bytes"))
    return f.where(paths.is_source_candidate(F.col("path"), F.col("size_bytes")) & F.is_valid_utf8(F.col("content").cast("string"))).withColumn("content", F.col("content").cast("string"))
