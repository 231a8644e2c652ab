"""Commits that show why a file is expected to change: examples behind pairs, sequences, forecasts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.history import WEEK, in_slots, within


def first_n(df: DataFrame, n: int, by: list[str], *order) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def supporting_triples(commits: DataFrame, wanted: DataFrame, window: int = WEEK) -> DataFrame:
    """(repo, files, shas): for each wanted triple of files the first three consecutive commits that hold it in order, in the window."""
    c = in_slots(commits.select("repo", "sha", "ts", "t0", "files"), window, ["t0", "sha"], {"s1": ("sha", 1), "f1": ("files", 1), "s2": ("sha", 2), "f2": ("files", 2), "t2": ("ts", 2)})
    c = c.where(F.col("ts").isNotNull() & (F.col("t2") - F.col("ts")).between(0, window))
    w = wanted.select("repo", "files").distinct().withColumn("a", F.col("files")[0]).withColumnRenamed("files", "triple")
    hit = c.withColumn("a", F.explode("files")).join(w, ["repo", "a"]).where(F.array_contains(F.col("f1"), F.col("triple")[1]) & F.array_contains(F.col("f2"), F.col("triple")[2]))
    one = first_n(hit.select("repo", F.col("triple").alias("files"), "t0", "sha", "s1", "s2"), 1, ["repo", "files"], F.col("t0"), F.col("sha"))
    return one.select("repo", "files", F.array_sort(F.array_distinct(F.array("sha", "s1", "s2"))).alias("shas"))


def ripple_examples(commits: DataFrame, pairs: DataFrame, window: int = WEEK, n: int = 5) -> DataFrame:
    """(repo, source, target, commit_sha, ts, event_type): the n newest commits behind each (source, target).

    co_change: both files in a commit; follow_up: the first commit with the target in
    the window after one with the source alone.
    """
    p = pairs.select("repo", "source", "target").distinct()
    files = commits.where(F.size("files") > 0).select("repo", "sha", "ts", "t0", F.explode("files").alias("source"), "files")
    at = files.join(p, ["repo", "source"])
    both = at.where(F.array_contains(F.col("files"), F.col("target"))).select("repo", "source", "target", F.col("sha").alias("commit_sha"), "ts", F.lit("co_change").alias("event_type"))
    alone = at.where(F.col("ts").isNotNull() & ~F.array_contains(F.col("files"), F.col("target"))).select("repo", "sha", "ts", "source", "target")
    later = commits.where(F.col("ts").isNotNull()).select("repo", "sha", "ts", F.explode("files").alias("path"))
    hit = within(alone, later, window).where(F.col("l_target") == F.col("r_path"))
    first = hit.groupBy("l_repo", "l_source", "l_target", "l_sha").agg(F.min(F.struct("r_ts", "r_sha")).alias("r"))
    follow = first.select(F.col("l_repo").alias("repo"), F.col("l_source").alias("source"), F.col("l_target").alias("target"), F.col("r.r_sha").alias("commit_sha"), F.col("r.r_ts").alias("ts"), F.lit("follow_up").alias("event_type")).distinct()
    return first_n(both.unionByName(follow), n, ["repo", "source", "target"], F.desc(F.coalesce("ts", F.lit(0))), F.col("commit_sha"), F.col("event_type"))


def prediction_examples(commits: DataFrame, n: int = 5) -> DataFrame:
    """(repo, path, commit_sha, ts, event_type): the newest commits of every file, as prior_change and, if of several files, co_change.

    Files are taken as listed, ignored ones included. commits have the nested files.
    """
    names = F.array_distinct(F.coalesce(F.col("files.filename"), F.array().cast("array<string>")))
    c = commits.select("repo", "sha", "ts", "t0", names.alias("f"))
    kinds = F.when(F.size("f") > 1, F.array(F.lit("prior_change"), F.lit("co_change"))).otherwise(F.array(F.lit("prior_change")))
    rows = c.select("repo", "sha", "ts", "t0", F.explode("f").alias("path"), kinds.alias("kinds")).select("repo", "path", F.col("sha").alias("commit_sha"), "ts", "t0", F.explode("kinds").alias("event_type"))
    return first_n(rows, n, ["repo", "path"], F.desc("t0"), F.col("commit_sha"), F.col("event_type")).drop("t0")


def row_examples(rows: DataFrame, n: int = 5) -> DataFrame:
    """(row_id, commit_sha, t): the n newest earlier commits that changed the row's file, from labelled rows."""
    past = rows.where("label = 1").select("repo", "file_path", F.col("commit_sha").alias("past_sha"), F.col("timestamp").alias("past")).distinct()
    line = Window.partitionBy("repo", "file_path").orderBy("t", "kind", "sha").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # each file's changes on one line of time; a row takes the last n of those before it, carried along as an array
    both = past.select("repo", "file_path", F.col("past").alias("t"), F.lit(1).alias("kind"), F.col("past_sha").alias("sha"), F.lit(None).cast("bigint").alias("row_id")).unionByName(
        rows.select("repo", "file_path", F.col("timestamp").alias("t"), F.lit(0).alias("kind"), F.lit("").alias("sha"), "row_id"))
    place = F.sum("kind").over(line)
    asked = both.withColumn("i", place)
    ask = asked.where("kind = 0").select("repo", "file_path", "row_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("back"), (F.col("i") - F.col("back")).alias("i"))
    return ask.join(asked.where("kind = 1").select("repo", "file_path", "i", F.col("sha").alias("commit_sha"), "t"), ["repo", "file_path", "i"]).select("row_id", "commit_sha", "t")


def examples(temporal: DataFrame, sequences: DataFrame, pairs: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """(repo, id, source_file, target_file, sequence, occurrences, avg_delay_seconds, signals): ten pairs and ten sequences of each repository, by occurrences.

    temporal and sequences are already ranked lists; signals tell whether co-change or a
    dependency speaks for them too.
    """
    co = pairs.select("repo", F.col("file_a").alias("a"), F.col("file_b").alias("b")).distinct().withColumn("co", F.lit(True))
    dep = edges.select("repo", F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select("repo", F.col("target").alias("a"), F.col("source").alias("b"))).distinct().withColumn("dep", F.lit(True))
    w = lambda *order: Window.partitionBy("repo").orderBy(*order)
    t = temporal.withColumn("i", F.row_number().over(w(F.desc("occurrences"), F.col("source"), F.col("target")))).where("i <= 10").select(
        "repo", F.concat(F.lit("temporal-"), "i").alias("id"), F.array("source", "target").alias("sequence"), "occurrences", "avg_delay_seconds", F.lit("temporal").alias("kind"))
    s = sequences.withColumn("i", F.row_number().over(w(F.desc("occurrences"), F.col("avg_delay_seconds"), F.col("files")))).where("i <= 10").select(
        "repo", F.concat(F.lit("sequence-"), "i").alias("id"), F.col("files").alias("sequence"), "occurrences", "avg_delay_seconds", F.lit("sequence").alias("kind"))
    x = t.unionByName(s)
    steps = x.select("repo", "id", "sequence", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("sequence") - 1), lambda i: F.struct(F.get("sequence", i - 1).alias("a"), F.get("sequence", i).alias("b")))).alias("k", "st")).select("repo", "id", F.col("st.a").alias("a"), F.col("st.b").alias("b"), F.size("sequence").alias("n"))
    near = steps.where("n = 2").withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")).join(co.withColumnsRenamed({"a": "x", "b": "y"}), ["repo", "x", "y"]).select("repo", "id", "co").distinct()
    uses = steps.join(dep, ["repo", "a", "b"]).select("repo", "id", "dep").distinct()
    x = x.join(near, ["repo", "id"], "left").join(uses, ["repo", "id"], "left")
    signals = F.array_compact(F.array(F.col("kind"), F.when(F.col("co"), "co-change"), F.when(F.col("dep"), "dependency")))
    out = first_n(x, n, ["repo"], F.desc("occurrences"), F.col("avg_delay_seconds"), F.col("id"))
    return out.select("repo", "id", F.col("sequence")[0].alias("source_file"), F.element_at("sequence", -1).alias("target_file"), "sequence", "occurrences", "avg_delay_seconds", signals.alias("signals"))
