"""How well forecasts of touched files do: the simulator asked at each of the last commits, with only what came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators.history import numbered
from tidemark.operators.impact import DIRECT, FLOOR, LEAST, WEIGHTS, content_matches, intent, path_matches
from tidemark.operators.prefix import cochange_at
from tidemark.session import cut

# The weights of each baseline; "paths" is the model that knows no contents and no dependencies.
BASELINES = {
    "combined": WEIGHTS,
    "keyword-only": {"semantic": 1.0, "dependency": 0.0, "historical": 0.0, "kind": 0.0},
    "dependency-only": {"semantic": 0.0, "dependency": 1.0, "historical": 0.0, "kind": 0.0},
    "cochange-only": {"semantic": 0.0, "dependency": 0.0, "historical": 1.0, "kind": 0.0},
    "paths": {"semantic": 0.45, "dependency": 0.0, "historical": 0.35, "kind": 0.20},
}
#: Terms of a repository that one row of its vocabulary holds.
WORDS_A_ROW = 1000


def targets(commits: DataFrame, most_files: int = 15) -> DataFrame:
    """(repo, sha, ts, terms, files): the last fifth of each repository's commits with a time and a message, of 1 to most_files files.

    Only repositories of 5 commits and more, and commits after their first time. commits
    have their message and distinct files.
    """
    c = commits.where("ts is not null and trim(message) <> ''").select("repo", "sha", "ts", "message", "files")
    first = c.groupBy("repo").agg(F.min("ts").alias("_first"))
    c = numbered(c, "ts", "sha").withColumn("_i", F.col("_i") - 1).join(first, "repo")
    c = c.where((F.col("_n") >= 5) & (F.col("_i") >= F.expr("_n * 4 div 5")) & F.size("files").between(1, most_files) & (F.col("ts") > F.col("_first")))
    return intent(c, "message").select("repo", "sha", "ts", "terms", "files")


def signals(files: DataFrame, asked: DataFrame, changed: DataFrame, edges: DataFrame, contents: bool = True) -> DataFrame:
    """(repo, sha, path, semantic, dependency, historical): what speaks for each file at each commit asked for; files without any signal have no row.

    files (repo, path, content); asked (repo, sha, ts, terms); changed are the changes of commits
    with a message. Which terms a file holds is asked once for each file and term.
    """
    terms = asked.select("repo", F.explode("terms").alias("term")).distinct()
    n_terms = terms.groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / WORDS_A_ROW).cast("int").alias("rows"))
    vocabulary = terms.join(n_terms, "repo").groupBy("repo", F.pmod(F.xxhash64("term"), F.col("rows")).alias("part")).agg(F.collect_set("term").alias("words")).drop("part")
    by_path = path_matches(F.col("path"), F.col("words"))
    by_text = F.coalesce(content_matches(F.col("content"), F.col("words")), F.array().cast("array<string>")) if contents else F.array().cast("array<string>")
    held = files.select("repo", "path", "content").join(vocabulary, "repo").select("repo", "path", by_path.alias("p"), by_text.alias("c")).select("repo", "path", "p", "c", F.explode(F.array_union("p", "c")).alias("term"))
    held = held.select("repo", "path", "term", F.array_contains("p", F.col("term")).cast("int").alias("p"), F.array_contains("c", F.col("term")).cast("int").alias("c"))
    words = asked.select("repo", "sha", "ts", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    share = F.least(F.greatest(F.sum("p"), F.sum("c")) / F.least("n", F.lit(4)), F.lit(1.0))
    semantic = words.join(held, ["repo", "term"]).groupBy("repo", "sha", "ts", "path", "n").agg(share.alias("semantic")).drop("n")
    direct = semantic.where(F.col("semantic") >= DIRECT).select("repo", "sha", "ts", F.col("path").alias("hit"))
    both = edges.select("repo", F.col("source").alias("path"), F.col("target").alias("hit")).unionByName(edges.select("repo", F.col("target").alias("path"), F.col("source").alias("hit"))).distinct()
    dependent = direct.join(both, ["repo", "hit"]).select("repo", "sha", "path").distinct()
    own = changed.where("ts is not null").select("repo", F.col("path").alias("hit"), F.col("sha").alias("c"), F.col("ts").alias("at")).distinct()
    n = direct.join(own, ["repo", "hit"]).where("at < ts").groupBy("repo", "sha", "hit").agg(F.count(F.lit(1)).alias("changes"))
    pairs = cochange_at(changed).where("source <> target")
    pairs = pairs.select("repo", "at", F.col("source").alias("hit"), F.col("target").alias("path"), "n").unionByName(pairs.select("repo", "at", F.col("target").alias("hit"), F.col("source").alias("path"), "n"))
    together = direct.join(pairs, ["repo", "hit"]).where("at < ts").groupBy("repo", "sha", "hit", "path").agg(F.sum("n").alias("together"))
    historical = together.join(n, ["repo", "sha", "hit"]).groupBy("repo", "sha", "path").agg(F.least(F.max(F.col("together") / F.col("changes")), F.lit(1.0)).alias("historical"))
    none = F.lit(0.0)
    row = lambda df, name: df.select("repo", "sha", "path", *[(F.col(c) if c == name else none).cast("double").alias(c) for c in ("semantic", "dependency", "historical")])
    every = row(semantic, "semantic").unionByName(row(dependent.withColumn("dependency", F.lit(1.0)), "dependency")).unionByName(row(historical, "historical"))
    every = every.groupBy("repo", "sha", "path").agg(F.max("semantic").alias("semantic"), F.max("dependency").alias("dependency"), F.max("historical").alias("historical"))
    return every.join(files.select("repo", "path").distinct(), ["repo", "path"], "left_semi")


def ranked(spoken: DataFrame, weights: dict[str, float], k: int = 5) -> DataFrame:
    """(repo, sha, path, rank): each commit's k files of the highest score, as the simulator scores them."""
    total = sum(weights.values()) or 1.0
    kind = F.when((paths.kind(F.col("path")) != "source") & (F.col("semantic") > 0), 1.0).otherwise(0.0)
    raw = sum(((kind if c == "kind" else F.col(c)) * (w / total) for c, w in weights.items()), F.lit(0.0))
    score = F.least(F.when(F.col("semantic") >= DIRECT, F.greatest(raw, F.lit(FLOOR))).otherwise(raw), F.lit(1.0))
    best = Window.partitionBy("repo", "sha").orderBy(F.desc(F.round("score", 12)), "path")
    return spoken.withColumn("score", score).where(F.col("score") >= LEAST).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("repo", "sha", "path", "rank")


def scores(found: DataFrame, asked: DataFrame) -> DataFrame:
    """One row of means over the commits with any ranked file: precision, recall, F1 of both, directories, tests and configuration found."""
    truth = asked.select("repo", "sha", F.size("files").alias("n_true"), F.explode("files").alias("path"))
    kind = paths.kind(F.col("path"))
    key = ["repo", "sha"]
    given = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    hit = truth.join(found.select(*key, "path", F.lit(1).alias("hit")), [*key, "path"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    part = lambda name: F.avg(F.when(kind == name, F.col("hit")))
    per = hit.groupBy(*key).agg(F.first("n_true").alias("n_true"), F.sum("hit").alias("hits"), part("test").alias("tests"), part("config").alias("configs"))
    parent = lambda df: df.select(*key, paths.directory(F.col("path")).alias("d")).distinct()
    dirs = parent(truth).join(parent(found).withColumn("ok", F.lit(1)), [*key, "d"], "left").groupBy(*key).agg(F.avg(F.coalesce("ok", F.lit(0))).alias("dirs"))
    m = given.join(per, key).join(dirs, key).agg(
        F.avg(F.col("hits") / F.col("n")).alias("precision_at_k"), F.avg(F.col("hits") / F.col("n_true")).alias("recall_at_k"), F.avg("dirs").alias("directory_accuracy"),
        F.avg("tests").alias("test_discovery_rate"), F.avg("configs").alias("config_discovery_rate"), F.count(F.lit(1)).alias("evaluated_targets"))
    both = F.col("precision_at_k") + F.col("recall_at_k")
    return m.withColumn("f1_at_k", F.when(both > 0, 2 * F.col("precision_at_k") * F.col("recall_at_k") / both))


def evaluate(commits: DataFrame, changed: DataFrame, files: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(baseline, seven scores, evaluated_targets): every baseline of the simulator at the last fifth of each repository's commits."""
    asked, files, edges = cut(targets(commits)), cut(files), cut(edges)
    spoken = changed.where("trim(message) <> ''")
    with_texts, by_path = cut(signals(files, asked, spoken, edges)), cut(signals(files, asked, spoken, edges, contents=False))
    out = None
    for name, weights in BASELINES.items():
        row = scores(ranked(by_path if name == "paths" else with_texts, weights, k), asked).withColumn("baseline", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
