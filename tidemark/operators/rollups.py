"""What lists and charts of a history show: directories, weeks, trends, filters and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators.history import top

DAY, MOST_BUCKETS = 86_400, 26


def directory_stats(changed: DataFrame, structural: DataFrame) -> DataFrame:
    """(repo, directory, files, lines, changes, contributors, test_files) over files changed or analysed."""
    n = changed.groupBy("repo", "path").agg(F.count_distinct("sha").alias("changes"))
    files = n.join(structural.select("repo", "path", F.col("lines_of_code").alias("lines")), ["repo", "path"], "full")
    d = paths.directory(F.col("path")).alias("directory")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    stats = files.groupBy("repo", d).agg(F.count(F.lit(1)).alias("files"), zero("lines"), zero("changes"), F.count_if(paths.kind_shown(F.col("path")) == "test").alias("test_files"))
    who = changed.where("who is not null").groupBy("repo", d).agg(F.count_distinct("who").alias("contributors"))
    return stats.join(who, ["repo", "directory"], "left").withColumn("contributors", F.coalesce("contributors", F.lit(0)))


def tree(files: DataFrame) -> DataFrame:
    """(repo, node, kind, files): every directory and file of the paths, with the files below."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("node"), F.when(i == F.size(parts), "file").otherwise("dir").alias("kind")))
    return files.select("repo", "path").distinct().select("repo", F.explode(up).alias("x")).groupBy("repo", F.col("x.node").alias("node"), F.col("x.kind").alias("kind")).agg(F.count(F.lit(1)).alias("files"))


def week(ts: Column) -> Column:
    """Whole weeks from Monday, 5 January 1970, in UTC."""
    return F.floor((ts - 4 * DAY) / (7 * DAY))


def weekly(commits: DataFrame) -> DataFrame:
    """(repo, bucket, week_start, commits, files, additions, deletions): weeks from Monday without gaps, joined in pairs until 26 at most are left."""
    c = commits.where("ts is not null").select("repo", week(F.col("ts")).alias("w"), F.size("files").alias("n_files"), "additions", "deletions")
    w = c.groupBy("repo", "w").agg(F.count(F.lit(1)).alias("commits"), F.sum("n_files").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    span = w.groupBy("repo").agg(F.min("w").alias("w0"), F.max("w").alias("w1"))
    halvings = F.greatest(F.lit(0), F.ceil(F.log2((F.col("w1") - F.col("w0") + 1) / F.lit(float(MOST_BUCKETS))))).cast("int")
    span = span.withColumn("h", halvings)
    every = span.select("repo", "w0", "h", F.explode(F.sequence("w0", "w1")).alias("w"))
    each = every.join(w, ["repo", "w"], "left").withColumn("bucket", F.expr("cast(shiftright(w - w0, h) as bigint)"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return each.groupBy("repo", "bucket").agg(((F.min("w") * 7 + 4) * DAY).alias("week_start"), zero("commits"), zero("files"), zero("additions"), zero("deletions"))


def pair_trend(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(repo, file_a, file_b, recent, older, trend): hits of a pair in the last third of the repository's commits and before."""
    line, all_ = Window.partitionBy("repo").orderBy("t0", "sha"), Window.partitionBy("repo")
    c = commits.withColumn("i", F.row_number().over(line) - 1).withColumn("split", F.floor(F.count(F.lit(1)).over(all_) * 2 / 3))
    p = pairs.select("repo", "file_a", "file_b").where("file_a <> file_b")
    a = c.select("repo", "sha", (F.col("i") >= F.col("split")).alias("late"), F.explode("files").alias("file_a"), "files").join(p, ["repo", "file_a"]).where(F.array_contains(F.col("files"), F.col("file_b")))
    n = a.groupBy("repo", "file_a", "file_b").agg(F.count_if("late").alias("recent"), F.count_if(~F.col("late")).alias("older"))
    n = p.join(n, ["repo", "file_a", "file_b"], "left")
    trend = F.when(F.col("recent").isNull(), "unknown").when(F.col("recent") > F.col("older"), "increasing").when(F.col("recent") < F.col("older"), "decreasing").otherwise("stable")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return n.select("repo", "file_a", "file_b", trend.alias("trend"), zero("recent"), zero("older"))


def against_peak(df: DataFrame, column: str, name: str, high: float, medium: float, words: tuple[str, str, str]) -> DataFrame:
    """Add name: the column's share of the repository's highest value, as one of three words."""
    peak = df.groupBy("repo").agg(F.max(column).alias("_peak"))
    ratio = F.col(column) / F.col("_peak")
    word = F.when((F.col("_peak") <= 0) | (F.col(column) <= 0), words[2]).when(ratio >= high, words[0]).when(ratio >= medium, words[1]).otherwise(words[2])
    return df.join(peak, "repo").withColumn(name, word).drop("_peak")


def commits_per_month(totals: DataFrame) -> DataFrame:
    """(repo, per_month): commits by 30 days between the first and last one, by a day at least; null without a span."""
    months = F.greatest((F.col("last_ts") - F.col("first_ts")) / (30.0 * DAY), F.lit(1 / 30))
    return totals.select("repo", F.when(F.col("last_ts") > F.col("first_ts"), F.col("total_commits") / months).alias("per_month"))


def signals(e: str = "") -> Column:
    return F.array_compact(F.array(F.when(F.col("dependency"), "dependency"), F.when(F.col("temporal"), "temporal"), F.when(F.col("cochange"), "co-change")))


def edge_filter(edges: DataFrame, which: str, predicted: DataFrame | None = None) -> DataFrame:
    """Edges with a signal (dependency, temporal, cochange), between tests or configuration, at predicted (repo, path), or all."""
    if which in ("dependency", "temporal", "cochange"):
        return edges.where(F.col(which))
    if which in ("tests", "config"):
        kind = {"tests": "test", "config": "config"}[which]
        return edges.where((paths.kind_shown(F.col("source")) == kind) | (paths.kind_shown(F.col("target")) == kind))
    if which == "prediction":
        p = predicted.select("repo", "path").distinct()
        at = lambda c: edges.join(p.withColumnRenamed("path", c), ["repo", c], "left_semi")
        return at("source").unionByName(at("target").select(*at("source").columns)).distinct()
    return edges


def node_counts(edges: DataFrame) -> DataFrame:
    """(repo, node, out, in, cochange, temporal, neighbours): the signals at every node."""
    i = lambda c: F.when(F.col(c), 1).otherwise(0)
    ends = edges.select("repo", F.col("source").alias("node"), F.col("target").alias("other"), F.lit("out").alias("way"), i("dependency").alias("o"), F.lit(0).alias("i"), i("cochange").alias("c"), i("temporal").alias("t")).unionByName(
        edges.where("source <> target").select("repo", F.col("target").alias("node"), F.col("source").alias("other"), F.lit("in").alias("way"), F.lit(0).alias("o"), i("dependency").alias("i"), i("cochange").alias("c"), i("temporal").alias("t")))
    return ends.groupBy("repo", "node").agg(F.sum("o").alias("dependencies_out"), F.sum("i").alias("dependents_in"), F.sum("c").alias("cochange"), F.sum("t").alias("temporal"), F.count_distinct("other", "way").alias("neighbours"))


def degrees(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(repo, node, degree) over edges between different nodes; the n highest of each repository."""
    d = edges.where("source <> target").select("repo", F.explode(F.array("source", "target")).alias("node")).groupBy("repo", "node").agg(F.count(F.lit(1)).alias("degree"))
    return d if n is None else top(d, n, F.desc("degree"), F.col("node"))


def neighbourhood(edges: DataFrame, focus: DataFrame, depth: int = 2, most: int = 24) -> DataFrame:
    """(repo, focus, node, hop): nodes reached from each (repo, path) by at most depth edges, the strongest first, at most ``most``.

    Nodes are taken hop by hop, within a hop in the order of the nodes they hang on and by
    strength, then name.
    """
    both = edges.where("source <> target").select("repo", F.col("source").alias("at"), F.col("target").alias("to"), "strength").unionByName(edges.where("source <> target").select("repo", F.col("target").alias("at"), F.col("source").alias("to"), "strength"))
    both = both.groupBy("repo", "at", "to").agg(F.max("strength").alias("strength"))
    near = top(both.withColumn("key", F.concat_ws("\x1f", "repo", "at")), most, F.desc("strength"), F.col("to"), by="key").drop("key") if depth == 1 else both
    seen = focus.select("repo", F.col("path").alias("focus"), F.col("path").alias("node"), F.lit(0).alias("hop"), F.lit(1).cast("bigint").alias("place"))
    for hop in range(1, depth + 1):
        new = seen.where(F.col("hop") == hop - 1).join(near.withColumnRenamed("at", "node"), ["repo", "node"]).select("repo", "focus", F.col("to").alias("node"), "place", "strength")
        new = new.join(seen.select("repo", "focus", "node"), ["repo", "focus", "node"], "left_anti").groupBy("repo", "focus", "node").agg(F.min(F.struct("place", (-F.col("strength")).alias("s"))).alias("b"))
        new = new.withColumn("i", F.row_number().over(Window.partitionBy("repo", "focus").orderBy("b.place", "b.s", "node")))
        size = seen.groupBy("repo", "focus").agg(F.count(F.lit(1)).alias("n"))
        seen = seen.unionByName(new.join(size, ["repo", "focus"]).where(F.col("i") + F.col("n") <= most).select("repo", "focus", "node", F.lit(hop).alias("hop"), (F.col("i") + F.col("n")).cast("bigint").alias("place")))
    return seen.drop("place")


def partners(pairs: DataFrame, n: int = 5) -> DataFrame:
    """(repo, path, partner, count): each file's n most frequent co-changes."""
    both = pairs.where("file_a <> file_b").select("repo", F.col("file_a").alias("path"), F.col("file_b").alias("partner"), "count").unionByName(pairs.where("file_a <> file_b").select("repo", F.col("file_b").alias("path"), F.col("file_a").alias("partner"), "count"))
    w = Window.partitionBy("repo", "path").orderBy(F.desc("count"), "partner")
    return both.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def timeline_filter(commits: DataFrame, days: int | None = None, author: str | None = None, directory: str = "", file: str = "", kind: str = "all") -> DataFrame:
    """Commits of the last days of each repository, by author, with a matching file, of a kind (additions, deletions, mixed)."""
    out = commits
    if days is not None:
        newest = commits.groupBy("repo").agg(F.max("ts").alias("_newest"))
        out = out.join(newest, "repo").where(F.col("ts") >= F.col("_newest") - days * DAY).drop("_newest")
    if author:
        out = out.where(F.col("who") == author)
    if directory:
        out = out.where(F.exists("files", lambda f: F.lower(paths.parent(f)).contains(directory.lower())))
    if file:
        out = out.where(F.exists("files", lambda f: F.lower(f).contains(file.lower())))
    if kind == "additions":
        out = out.where(F.col("additions") > F.col("deletions"))
    elif kind == "deletions":
        out = out.where(F.col("deletions") > F.col("additions"))
    elif kind == "mixed":
        out = out.where((F.col("additions") > 0) & (F.col("deletions") > 0))
    return out


def search(commits: DataFrame, files: DataFrame, text: str, most: int = 10) -> DataFrame:
    """(repo, kind, hit, place): up to 6 files that contain a text, then the latest 6 commits with it in message or at the start of the sha."""
    t = text.strip().lower()
    f = top(files.where(F.lower("path").contains(t)).select("repo", F.lit("file").alias("kind"), F.col("path").alias("hit")).distinct(), 6, F.col("hit"))
    c = top(commits.where(F.lower("message").contains(t) | F.lower("sha").startswith(t)).select("repo", F.lit("commit").alias("kind"), F.col("sha").alias("hit"), "t0"), 6, F.desc("t0"), F.col("hit"))
    both = f.withColumn("o", F.lit(0).cast("bigint")).unionByName(c.select("repo", "kind", "hit", (-F.col("t0")).alias("o")))
    w = Window.partitionBy("repo").orderBy(F.desc("kind"), "o", "hit")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("o")


def coupling_filter(pairs: DataFrame, edges: DataFrame | None = None, least: int = 2, directory: str = "", dependent: bool | None = None) -> DataFrame:
    """Pairs of at least a number of co-changes, in a directory, with or without a dependency either way."""
    out = pairs.where((F.col("count") >= least) & (F.col("file_a") != F.col("file_b")))
    if directory:
        out = out.where(paths.parent(F.col("file_a")).contains(directory) | paths.parent(F.col("file_b")).contains(directory))
    if dependent is not None:
        both = edges.select("repo", F.least("source", "target").alias("file_a"), F.greatest("source", "target").alias("file_b")).distinct()
        out = out.join(both, ["repo", "file_a", "file_b"], "left_semi" if dependent else "left_anti")
    return out


def prediction_filter(scored: DataFrame, label: int | None = None, band: str | None = None, text: str = "") -> DataFrame:
    """Scored files by predicted label, confidence and a text within the path."""
    out = scored
    if label is not None:
        out = out.where(F.col("predicted") == label)
    if band:
        out = out.where(F.col("confidence") == band)
    return out.where(F.lower("file_path").contains(text.strip().lower())) if text.strip() else out


def stamps(commits: DataFrame) -> DataFrame:
    """(repo, path, stamps): the sorted times of every file's commits, in milliseconds."""
    return commits.where("ts is not null").select("repo", F.explode("files").alias("path"), (F.col("ts") * 1000).alias("t")).groupBy("repo", "path").agg(F.array_sort(F.collect_list("t")).alias("stamps"))


def readiness(structural: DataFrame, historical: DataFrame, temporal: DataFrame) -> DataFrame:
    """(repo, structural, historical, temporal): how many files have each kind of features."""
    n = lambda df, name: df.groupBy("repo").agg(F.count(F.lit(1)).alias(name))
    return n(structural, "structural").join(n(historical, "historical"), "repo", "full").join(n(temporal, "temporal"), "repo", "full").fillna(0)


def drivers(files: DataFrame, spots: DataFrame, connected: DataFrame, complex_from: float = 10.0, flagged_from: float = 40.0) -> DataFrame:
    """(repo, complex_share, hotspot_share, flagged, connected_share) of a repository's files."""
    n = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("complexity") >= complex_from).alias("c"))
    s = spots.groupBy("repo").agg(F.count(F.lit(1)).alias("s"), F.count_if(F.col("score") >= flagged_from).alias("flagged"))
    k = files.join(connected.select("repo", "path").distinct(), ["repo", "path"], "left_semi").groupBy("repo").agg(F.count(F.lit(1)).alias("k"))
    share = lambda c: F.least(F.coalesce(F.col(c), F.lit(0)) / F.col("n"), F.lit(1.0))
    return n.join(s, "repo", "left").join(k, "repo", "left").select("repo", share("c").alias("complex_share"), share("s").alias("hotspot_share"), F.coalesce("flagged", F.lit(0)).alias("flagged"), share("k").alias("connected_share"))
