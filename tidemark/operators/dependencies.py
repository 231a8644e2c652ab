"""References between source files, resolved to paths, and what they say about coupling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import paths

# How a reference is written in each language, and the order in which extensions are tried.
SCRIPT_PATTERNS = [r"(?m)^\s*(?:import|export)\b[^;'\"\n]*?\bfrom\s*['\"]([^'\"\n]+)['\"]", r"(?m)^\s*import\s*['\"]([^'\"\n]+)['\"]", r"\brequire\(\s*'([^'\n]+)'\s*\)"]
RUST_PATTERNS = [r"(?m)^\s*(?:pub(?:\([a-z]+\))?\s+)?use\s+([^;]+);", r"(?m)^\s*(?:pub(?:\([a-z]+\))?\s+)?mod\s+(\w+)\s*;", r"(?m)^\s*(extern crate\s+[^;]+);"]
PYTHON_PATTERNS = [r"(?m)^\s*((?:import|from)\s+[^\n#;]+)"]
EXTENSIONS = ["py", "rs", "js", "ts", "tsx", "jsx", "mjs", "cjs"]


def latest_sources(sources: DataFrame) -> DataFrame:
    """Each (repo, path) once, as fetched last; files without content are left out."""
    last = Window.partitionBy("repo", "path").orderBy(F.desc("fetched_at"), F.desc("file_id"))
    return sources.where("content is not null").withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def references(sources: DataFrame) -> DataFrame:
    """(repo, source, reference): the distinct references of each file, as written."""
    found = lambda patterns: F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns])
    lang = paths.language(F.col("path"))
    refs = F.when(lang == "Rust", found(RUST_PATTERNS)).when(lang == "Python", found(PYTHON_PATTERNS)).when(lang.isNotNull(), found(SCRIPT_PATTERNS))
    return sources.select("repo", F.col("path").alias("source"), F.explode(F.array_distinct(F.transform(refs, lambda x: F.trim(x)))).alias("reference")).where("reference <> ''").distinct()


def resolve(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Add target to references: the first candidate path that is a file of the repo, else $ and the reference.

    Candidates in order: the reference as a path, with a leading crate/ or src/ taken
    off; the same below the source's directory; the same there with each extension.
    One equi-join on (repo, path).
    """
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim("reference"), r"^(?:use )+|^(?:import)+", "")), ";", ""))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, "::", "/"), r"\.", "/"), r"^/+|/+$", "")
    variants = F.when(F.instr(plain, "/") > 0, F.array(plain, F.regexp_replace(plain, "^crate/", ""), F.regexp_replace(plain, "^src/", ""))).otherwise(F.array(plain))
    here = F.concat(paths.parent(F.col("source")), F.lit("/"))
    with_extension = F.flatten(F.transform("v", lambda x: F.array(*[F.concat(F.col("here"), x, F.lit("." + e)) for e in EXTENSIONS])))
    tried = refs.withColumn("v", variants).withColumn("here", here).select(
        "repo", "source", "reference", F.posexplode(F.concat("v", F.transform("v", lambda x: F.concat(F.col("here"), x)), with_extension)).alias("priority", "path"))
    hit = tried.join(files.select("repo", "path").distinct(), ["repo", "path"]).groupBy("repo", "source", "reference").agg(F.min_by("path", "priority").alias("hit"))
    return refs.join(hit, ["repo", "source", "reference"], "left").select("repo", "source", "reference", F.coalesce("hit", F.concat(F.lit("$"), F.col("reference"))).alias("target"))


def edges(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, source, target), one row per reference."""
    return resolve(references(sources), files).select("repo", "source", "target")


def metrics(edges: DataFrame) -> DataFrame:
    """(repo, path, outgoing, incoming, coupling): distinct neighbours of every file in an edge; loops left out."""
    e = edges.where("source <> target").select("repo", "source", "target").distinct()
    ends = e.select("repo", F.col("source").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select("repo", F.col("target").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("repo", "path").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.count(F.lit(1)).alias("coupling"))


def above_spread(values: DataFrame, column: str) -> DataFrame:
    """(repo, n, mean, high): rows, their mean and how many lie above mean + population deviation."""
    s = values.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"))
    high = values.join(s, "repo").groupBy("repo").agg(F.count_if(F.col(column) > F.col("mean") + F.col("sd")).alias("high"))
    return s.join(high, "repo").select("repo", "n", "mean", "high")


def totals(edges: DataFrame) -> DataFrame:
    """Per repo: dependencies, files in one, highly connected files, coupled files whose name is resolved."""
    m = metrics(edges)
    n = m.groupBy("repo").agg(
        F.sum("outgoing").alias("total_dependencies"), F.count(F.lit(1)).alias("connected_files"), F.count_if(~F.startswith("path", F.lit("$"))).alias("resolved_dependencies"))
    return n.join(above_spread(m, "coupling").select("repo", F.col("high").alias("highly_connected_files")), "repo")
