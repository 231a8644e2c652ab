"""Relative scores of files: percentiles, hotspots and how difficult a repository is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the signals and what each is called.
WEIGHTS = {"complexity": 0.35, "churn": 0.30, "coupling": 0.20, "nesting": 0.15}
REASONS = {"complexity": "high relative complexity", "churn": "high relative churn", "coupling": "high dependency coupling", "nesting": "deep nesting"}


def percentile(files: DataFrame, column: str, name: str) -> DataFrame:
    """Add name: how many of the repo's rows are not above this one, less 1, per cent of the others; 0 where all are equal.

    Ranks are counted over the distinct values, so a repo's files are not one partition.
    """
    values = files.groupBy("repo", column).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("repo").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("repo")
    v = values.select("repo", column, F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(whole).alias("_all"), F.count(F.lit(1)).over(whole).alias("_values"))
    score = F.when(F.col("_values") > 1, (F.col("_upto") - 1) / (F.col("_all") - 1) * 100.0).otherwise(F.lit(0.0))
    return files.join(v.select("repo", column, score.alias(name)), ["repo", column])


def clamp(score: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(score, F.lit(low)), F.lit(high))


def hotspots(files: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(repo, path, score, reasons) of files with complexity, churn, coupling and nesting; scores of 0 left out.

    reasons: the signals of 75 and more, highest first, else the highest one.
    """
    weights = weights or WEIGHTS
    total = sum(weights.values()) or 1.0
    f = files
    for name in WEIGHTS:
        f = percentile(f, name, f"p_{name}")
    score = sum((F.col(f"p_{n}") * (weights.get(n, 0.0) / total) for n in WEIGHTS), F.lit(0.0))
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"p_{n}")).alias("v"), F.lit(i).alias("i"), F.lit(REASONS[n]).alias("r")) for i, n in enumerate(WEIGHTS)]))
    high = F.filter(ranked, lambda x: x.v <= -75.0)
    reasons = F.transform(F.when(F.size(high) > 0, high).otherwise(F.slice(ranked, 1, 1)), lambda x: x.r)
    return f.select("repo", "path", clamp(score).alias("score"), reasons.alias("reasons")).where("score > 0")


def level(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").when(score >= 25, "moderate").otherwise("low")


def difficulty(files: DataFrame, spots: DataFrame) -> DataFrame:
    """(repo, score, level): the mean of the hotspots' scores; low without any hotspot."""
    s = spots.groupBy("repo").agg(F.avg("score").alias("s"))
    score = clamp(F.coalesce("s", F.lit(0.0)))
    return files.select("repo").distinct().join(s, "repo", "left").select("repo", score.alias("score"), level(score).alias("level"))


def severity(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")
