"""How well rules and rankings do against what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators.history import WEEK, numbered, within
from tidemark.operators.impact import STOPWORDS, path_matches
from tidemark.operators.ripple import ranking_metrics


def rework_metrics(labels: DataFrame, events: DataFrame) -> DataFrame:
    """One row of tp, fp, tn, fn and rates for reviewed (previous_sha, current_sha, actual_rework) against rework events.

    A pair without an event is predicted as none; rates without a denominator are null.
    """
    hit = events.select(F.col("initial_sha").alias("previous_sha"), F.col("rework_sha").alias("current_sha")).distinct().withColumn("p", F.lit(True))
    x = labels.join(hit, ["previous_sha", "current_sha"], "left").select(F.col("actual_rework").alias("a"), F.coalesce("p", F.lit(False)).alias("p"))
    n = x.agg(F.count_if(F.col("a") & F.col("p")).alias("tp"), F.count_if(~F.col("a") & F.col("p")).alias("fp"), F.count_if(~F.col("a") & ~F.col("p")).alias("tn"), F.count_if(F.col("a") & ~F.col("p")).alias("fn"))
    return n.select("*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide("fp", F.col("fp") + F.col("tn")).alias("false_positive_rate"))


def follow_probability(commits: DataFrame, window: int = WEEK) -> DataFrame:
    """(repo, source, target, probability): the share of a source's commits followed, later but in the window, by one with the target and without the source.

    The stricter of the two definitions: equal times do not follow, and the earlier
    commit has to hold the source, the later one must not.
    """
    c = commits.where(F.col("ts").isNotNull() & (F.size("files") > 0)).select("repo", "sha", "ts", "files")
    n = c.select("repo", F.explode("files").alias("source")).groupBy("repo", "source").agg(F.count(F.lit(1)).alias("n"))
    p = within(c, c, window, strict=True).select(F.col("l_repo").alias("repo"), "l_sha", F.explode("l_files").alias("source"), "r_files").where(~F.array_contains(F.col("r_files"), F.col("source")))
    hits = p.select("repo", "l_sha", "source", F.explode("r_files").alias("target")).groupBy("repo", "source", "target").agg(F.count_distinct("l_sha").alias("hits"))
    return hits.join(n, ["repo", "source"]).select("repo", "source", "target", (F.col("hits") / F.col("n")).alias("probability"))


def message_terms(message):
    """Distinct words of a message as ``impact`` takes them, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(message), "[^a-z0-9]+"), lambda x: (F.length(x) > 2) & ~x.isin(STOPWORDS))))


def impact_ranking(commits: DataFrame, baseline: str = "keyword", k: int = 5, most_files: int = 15) -> DataFrame:
    """(repo, sha, item, rank): for the last fifth of each repository's commits (of 1 to most_files files, in repositories of 5 and more) the files ranked first by a baseline.

    keyword: the share of the message's words a known path holds; cochange: how often
    a file changed, strictly before, with the file that matches the message best. Only
    files seen strictly before are ranked; files without a score are not.
    """
    c = numbered(commits.where(F.col("ts").isNotNull() & (F.trim("message") != "")), "ts", "sha").withColumn("_i", F.col("_i") - 1)
    test = c.where((F.col("_n") >= 5) & (F.col("_i") >= F.col("_n") - F.floor(F.col("_n") / 5)) & F.size("files").between(1, most_files)).select("repo", "sha", "ts", message_terms(F.col("message")).alias("terms"))
    seen = commits.where("ts is not null").select("repo", "ts", F.explode("files").alias("item")).groupBy("repo", "item").agg(F.min("ts").alias("first_ts"))
    # which words a path holds is asked once for each path and word, not for each commit
    vocabulary = test.select("repo", F.explode("terms").alias("term")).distinct().groupBy("repo").agg(F.collect_set("term").alias("words"))
    holds = seen.join(vocabulary, "repo").select("repo", "item", "first_ts", F.explode(path_matches(F.col("item"), F.col("words"))).alias("term"))
    words = test.select("repo", "sha", "ts", F.explode("terms").alias("term"), F.size("terms").alias("n"))
    score = words.join(holds, ["repo", "term"]).where("first_ts < ts").groupBy("repo", "sha", "ts", "item", "n").agg(F.count(F.lit(1)).alias("m")).withColumn("score", F.least(F.col("m") / F.least("n", F.lit(4)), F.lit(1.0)))
    w = Window.partitionBy("repo", "sha").orderBy(F.desc("score"), "item")
    if baseline == "cochange":
        peer = score.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("repo", "sha", "ts", F.col("item").alias("peer"))
        held = commits.where("ts is not null").select("repo", F.col("ts").alias("t"), F.explode("files").alias("peer"), "files")
        score = peer.join(held, ["repo", "peer"]).where("t < ts").select("repo", "sha", "peer", F.explode("files").alias("item")).where("item <> peer").groupBy("repo", "sha", "item").agg(F.count(F.lit(1)).alias("score"))
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("repo", "sha", "item", "rank")


def impact_metrics(commits: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """One row: precision, recall and the like at k, and the share of queries whose ranked files include a right directory."""
    truth = commits.select("repo", "sha", F.explode("files").alias("item"))
    m = ranking_metrics(ranked, truth, ["repo", "sha"], k)
    d = lambda df: df.select("repo", "sha", paths.directory(F.col("item")).alias("d")).distinct()
    right = d(ranked).join(d(truth), ["repo", "sha", "d"]).select("repo", "sha").distinct().withColumn("ok", F.lit(1))
    share = ranked.select("repo", "sha").distinct().join(right, ["repo", "sha"], "left").agg(F.avg(F.coalesce("ok", F.lit(0))).alias("directory_accuracy"))
    return m.crossJoin(F.broadcast(share))
