"""Which files tend to follow a change: edges of four signals, ranked candidates, paths, and how well they predict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.history import MONTH, WEEK, change_counts, numbered, top, within

# Weights of the signals.
WEIGHTS = {"dependency": 0.20, "cochange": 0.30, "temporal": 0.35, "recent": 0.15}


def weights_without(group: str | None = None, weights: dict[str, float] | None = None) -> dict[str, float]:
    """Weights that add up to 1, without a group (structural means dependency); co-change alone where nothing is left."""
    w = dict(weights or WEIGHTS)
    if group:
        w[{"structural": "dependency"}.get(group, group)] = 0.0
    total = sum(w.values())
    if total <= 0:
        return {**dict.fromkeys(w, 0.0), "cochange": 1.0}
    return {k: v / total for k, v in w.items()}


def follows(commits: DataFrame, window: int = WEEK, recent: int = MONTH) -> DataFrame:
    """(repo, source, target, follow_count, median and mean delay, recent_count) over pairs of commits in the window.

    Every later commit with the target counts, also several; recent are those of the
    last ``recent`` seconds before the repository's last commit. The median is the upper
    one, the mean has no fraction.
    """
    c = commits.where((F.col("ts").isNotNull()) & (F.size("files") > 0)).select("repo", "sha", "ts", "files")
    ref = c.groupBy("repo").agg(F.max("ts").alias("ref"))
    p = within(c, c, window).select(F.col("l_repo").alias("repo"), "delay", "r_ts", "l_files", "r_files").join(ref, "repo").withColumn("late", (F.col("r_ts") >= F.col("ref") - recent).cast("int"))
    p = p.select("repo", "delay", "late", F.explode("l_files").alias("source"), "r_files").select("repo", "delay", "late", "source", F.explode("r_files").alias("target")).where("source <> target")
    # one row for each delay of an edge, in the order of delays: the median is where half the occurrences are passed
    edge = ["repo", "source", "target"]
    each = p.repartition(*edge).groupBy(*edge, "delay").agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("late"))
    line = Window.partitionBy(*edge).orderBy("delay")
    each = each.withColumn("upto", F.sum("n").over(line)).withColumn("half", F.floor(F.sum("n").over(Window.partitionBy(*edge)) / 2))
    return each.groupBy(*edge).agg(
        F.sum("n").alias("follow_count"), F.min(F.when(F.col("upto") > F.col("half"), F.col("delay"))).alias("median_follow_delay_seconds"), F.expr("sum(delay * n) div sum(n)").alias("avg_follow_delay_seconds"), F.sum("late").alias("recent_count"))


def edges(commits: DataFrame, changed: DataFrame, pairs: DataFrame, dependencies: DataFrame, weights: dict[str, float] | None = None, window: int = WEEK, recent: int = MONTH) -> DataFrame:
    """One row for every source and target with any signal: counts, probabilities per change of the source, combined score."""
    w = weights_without(weights=weights)
    n = change_counts(changed).withColumnRenamed("path", "source")
    both = lambda d, a, b, x: d.select("repo", F.col(a).alias("source"), F.col(b).alias("target"), x).unionByName(d.select("repo", F.col(b).alias("source"), F.col(a).alias("target"), x)).where("source <> target")
    co = both(pairs, "file_a", "file_b", F.col("count").alias("cochange_count"))
    uses = both(dependencies, "source", "target", F.lit(1.0).alias("dependency_score")).distinct()
    key = ["repo", "source", "target"]
    e = co.join(follows(commits, window, recent), key, "full").join(uses, key, "full").join(n, ["repo", "source"], "left")
    zero = lambda c, t="bigint": F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    e = e.select(*key, zero("dependency_score", "double"), zero("cochange_count"), zero("follow_count"), "median_follow_delay_seconds", "avg_follow_delay_seconds", zero("recent_count"), zero("changes"))
    per = lambda c: F.when(F.col("changes") > 0, F.col(c) / F.col("changes")).otherwise(F.lit(0.0))
    e = e.select("*", per("cochange_count").alias("cochange_probability"), per("follow_count").alias("follow_probability"), per("recent_count").alias("recent_follow_probability"))
    one = lambda c: F.least(F.col(c), F.lit(1.0))
    score = w["dependency"] * F.col("dependency_score") + w["cochange"] * one("cochange_probability") + w["temporal"] * one("follow_probability") + w["recent"] * one("recent_follow_probability")
    return e.withColumn("combined_score", F.least(score, F.lit(1.0))).drop("recent_count", "changes")


# The wording of the reasons.
def reasons(e: DataFrame):
    many = lambda c: F.when(F.col(c) == 1, "").otherwise("s")
    return F.array_compact(F.array(
        F.when(F.col("dependency_score") > 0, F.lit("Strong dependency relationship.")),
        F.when(F.col("cochange_count") > 0, F.format_string("Changed together in %d historical commit%s.", "cochange_count", many("cochange_count"))),
        F.when(F.col("follow_count") > 0, F.format_string("Followed in %d comparable change%s.", "follow_count", many("follow_count"))),
        F.when(F.col("median_follow_delay_seconds").isNotNull(), F.format_string("Median historical delay: %ds.", "median_follow_delay_seconds")),
        F.when(F.col("recent_follow_probability") > 0, F.lit("Recent coupling increased."))))


def candidates(edges: DataFrame, n: int = 10, least: float = 0.2) -> DataFrame:
    """(repo, source, target, rank, combined_score, reasons): each source's n best targets from a confidence on."""
    w = Window.partitionBy("repo", "source").orderBy(F.desc(F.round("combined_score", 12)), "target")
    e = edges.where(F.col("combined_score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return e.select("repo", "source", "target", "rank", "combined_score", reasons(e).alias("reasons"))


def missing(candidates: DataFrame, changed: DataFrame) -> DataFrame:
    """Candidates that are not among the changed (repo, path)."""
    return candidates.join(changed.select("repo", F.col("path").alias("target")).distinct(), ["repo", "target"], "left_anti")


def paths(edges: DataFrame, starts: DataFrame, depth: int = 5, least: float = 0.2) -> DataFrame:
    """(repo, source, nodes, scores, confidence): from each start always on to the best target not yet visited.

    Only each node's depth + 1 best edges matter, as at most depth of them lead back;
    they are kept, and every hop is one join.
    """
    w = Window.partitionBy("repo", "source").orderBy(F.desc(F.round("combined_score", 12)), "target")
    best = edges.where((F.col("combined_score") >= least) & (F.col("source") != F.col("target"))).withColumn("k", F.row_number().over(w)).where(F.col("k") <= depth + 1)
    nexts = best.groupBy("repo", F.col("source").alias("at")).agg(F.array_sort(F.collect_list(F.struct("k", "target", "combined_score"))).alias("nexts"))
    walk = starts.select("repo", F.col("path").alias("source"), F.array("path").alias("nodes"), F.array().cast("array<double>").alias("scores"), F.col("path").alias("at"))
    for _ in range(depth):
        step = F.get(F.filter("nexts", lambda x: ~F.array_contains(F.col("nodes"), x.target)), F.lit(0))
        walk = walk.join(nexts, ["repo", "at"], "left").select("repo", "source", "nodes", "scores", "at", step.alias("s")).select(
            "repo", "source", F.when(F.col("s").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array("s.target"))).alias("nodes"),
            F.when(F.col("s").isNull(), F.col("scores")).otherwise(F.concat("scores", F.array("s.combined_score"))).alias("scores"), F.col("s.target").alias("at"))
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return walk.where(F.size("scores") > 0).select("repo", "source", "nodes", "scores", (total / F.size("scores")).alias("confidence"))


def ranking_metrics(ranked: DataFrame, truth: DataFrame, query: list[str], k: int) -> DataFrame:
    """One row: precision and recall at k, reciprocal rank and average precision, meaned over queries with any ranked row.

    ranked (query..., item, rank from 1), truth (query..., item).
    """
    n = truth.groupBy(*query).agg(F.count(F.lit(1)).alias("n_truth"))
    r = ranked.where(F.col("rank") <= k).join(truth.select(*query, "item", F.lit(1).alias("hit")), [*query, "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = Window.partitionBy(*query).orderBy("rank")
    r = r.withColumn("seen", F.sum("hit").over(w))
    per = r.groupBy(*query).agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(F.lit(0.0))).alias("ap")).join(n, query)
    return per.agg(
        F.avg(F.col("hits") / F.col("n")).alias("precision_at_k"), F.avg(F.col("hits") / F.col("n_truth")).alias("recall_at_k"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.col("ap") / F.col("n_truth")).alias("map"), F.count(F.lit(1)).alias("evaluated"))


def evaluate(commits: DataFrame, k: int = 5) -> DataFrame:
    """Co-change ranking by earlier history only, tested on the last 30 % of each repository's commits.

    The query is the first file of a commit of several, the truth its other files; a
    target's score is its co-changes with the query strictly before, ties by name.
    """
    c = numbered(commits.where("ts is not null"), "ts", "sha").withColumn("_i", F.col("_i") - 1)
    test = c.where((F.col("_i") >= F.floor(F.col("_n") * 7 / 10)) & (F.size("files") > 1) & (F.col("_n") >= 3)).select("repo", "sha", "ts", F.col("files")[0].alias("source"), F.slice("files", 2, 1 << 30).alias("rest"))
    truth = test.select("repo", "sha", F.explode("rest").alias("item"))
    held = c.select("repo", F.col("ts").alias("t"), F.explode("files").alias("source"), "files").where(F.size("files") > 1)
    seen = test.join(held, ["repo", "source"]).where("t < ts").select("repo", "sha", "source", F.explode("files").alias("item")).where("item <> source").groupBy("repo", "sha", "item").agg(F.count(F.lit(1)).alias("score"))
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy("repo", "sha").orderBy(F.desc("score"), "item"))).where(F.col("rank") <= k)
    return ranking_metrics(ranked, truth, ["repo", "sha"], k)


__all__ = ["WEIGHTS", "candidates", "edges", "evaluate", "follows", "missing", "paths", "ranking_metrics", "top", "weights_without"]
