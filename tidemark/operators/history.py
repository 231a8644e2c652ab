"""Totals and files of a history, files that change together, and files that change after each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.session import cut

WEEK = 604_800
TWO_WEEKS = 1_209_600
MONTH = 2_592_000


def top(df: DataFrame, n: int, *order: Column, by: str = "repo") -> DataFrame:
    """The first n rows of each repo in a total order; ranked before the shuffle, so few rows move."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def numbered(df: DataFrame, time: str, *order: str) -> DataFrame:
    """Rows with their number (_i, from 1) in their repo's order of time and the further columns, and how many it has (_n).

    Counted by spans of four weeks first, so that no repo is a single partition; rows without a time come first.
    """
    span = F.coalesce(F.floor(F.col(time) / (4 * WEEK)), F.lit(-(2**40)))
    d = df.withColumn("_span", span)
    spans, every = Window.partitionBy("repo").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("repo")
    per = d.groupBy("repo", "_span").agg(F.count(F.lit(1)).alias("_c")).select("repo", "_span", F.coalesce(F.sum("_c").over(spans), F.lit(0)).alias("_before"), F.sum("_c").over(every).alias("_n"))
    own = F.row_number().over(Window.partitionBy("repo", "_span").orderBy(time, *order))
    return d.withColumn("_own", own).join(per, ["repo", "_span"]).withColumn("_i", F.col("_before") + F.col("_own")).drop("_span", "_own", "_before")


def repo_totals(commits: DataFrame, changed: DataFrame) -> DataFrame:
    """Per repo: commits, contributors, changed files, added, deleted and churned lines, first and last time."""
    c = commits.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_commits"), F.count_distinct("who").alias("contributors"),
        F.coalesce(F.sum("stats.additions"), F.lit(0)).alias("additions"), F.coalesce(F.sum("stats.deletions"), F.lit(0)).alias("deletions"),
        F.coalesce(F.sum(F.col("stats.additions") + F.col("stats.deletions")), F.lit(0)).alias("churn"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    f = changed.groupBy("repo").agg(F.count_distinct("path").alias("changed_files"))
    return c.join(f, "repo", "left").withColumn("changed_files", F.coalesce("changed_files", F.lit(0)))


def file_history(changed: DataFrame) -> DataFrame:
    """Per file: changes, added, deleted and churned lines; a file listed twice in a commit counts twice."""
    return changed.groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("change_count"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.sum(F.col("additions") + F.col("deletions")).alias("churn"))


def cochange(changed: DataFrame) -> DataFrame:
    """(repo, file_a, file_b, count), file_a <= file_b: how many pairs of places in commits hold the two files.

    One equi-join on the commit; pairs are counted map side. A file listed twice makes
    a pair with itself.
    """
    a = changed.select("repo", "sha", F.col("pos").alias("pa"), F.col("path").alias("a"))
    b = changed.select("repo", "sha", F.col("pos").alias("pb"), F.col("path").alias("b"))
    return a.join(b, ["repo", "sha"]).where("pa < pb").groupBy("repo", F.least("a", "b").alias("file_a"), F.greatest("a", "b").alias("file_b")).agg(F.count(F.lit(1)).alias("count"))


def change_counts(changed: DataFrame) -> DataFrame:
    """(repo, path, changes): commits that changed each file."""
    return changed.groupBy("repo", "path").agg(F.count_distinct("sha").alias("changes"))


def within(left: DataFrame, right: DataFrame, window: int, strict: bool = False, on: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Pairs (l_..., r_...) of one repo (or equal in all of ``on``) with r after l by at most ``window`` seconds.

    Both carry repo, ts, sha. "After" is the order of (ts, sha); with strict the time
    has to differ. Times fall into slots of one window, a right row is offered to its
    own slot and the next earlier one: an equi-join, so no row meets rows of other
    times. delay is r.ts - l.ts.
    """
    l = left.where("ts is not null").select(*[F.col(c).alias(f"l_{c}") for c in left.columns], F.floor(F.col("ts") / window).alias("slot"))
    r = right.where("ts is not null").select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.floor(F.col("ts") / window).alias("s"))
    r = r.select("*", F.explode(F.array(F.col("s"), F.col("s") - 1)).alias("slot")).drop("s")
    after = F.col("r_ts") > F.col("l_ts")
    if not strict:
        after = after | (F.col("r_ts") == F.col("l_ts")) & (F.col("r_sha") > F.col("l_sha"))
    near = (l["slot"] == r["slot"]) & after & (F.col("r_ts") - F.col("l_ts") <= window)
    for c in on:
        near = (F.col(f"l_{c}") == F.col(f"r_{c}")) & near
    return l.join(r, near).drop("slot").withColumn("delay", F.col("r_ts") - F.col("l_ts"))


def temporal_pairs(commits: DataFrame, window: int = WEEK) -> DataFrame:
    """(repo, source, target, occurrences, avg_delay_seconds): target changed within a window after source.

    Every pair of commits in order and in the window counts once for each two different
    files; the delay is averaged without its fraction. commits have files (arrays).
    """
    c = commits.where((F.col("ts").isNotNull()) & (F.size("files") > 0)).select("repo", "sha", "ts", "files")
    pairs = within(c, c, window).select(F.col("l_repo").alias("repo"), "delay", F.explode("l_files").alias("source"), F.col("r_files")).select(
        "repo", "delay", "source", F.explode("r_files").alias("target")).where("source <> target")
    return pairs.groupBy("repo", "source", "target").agg(F.count(F.lit(1)).alias("occurrences"), F.expr("sum(delay) div count(1)").alias("avg_delay_seconds"))


def propagation(pairs: DataFrame, temporal: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, source, target, dependency, temporal, cochange, strength): the three signals of every edge, strengths added.

    pairs (file_a, file_b, count), temporal (source, target, occurrences), edges (source,
    target, one row per reference; unresolved $ targets and loops are left out).
    """
    no, yes = F.lit(False), F.lit(True)
    d = edges.where("source <> target and not startswith(target, '$')").select("repo", "source", "target", yes.alias("d"), no.alias("t"), no.alias("c"), F.lit(1).cast("bigint").alias("n"))
    t = temporal.select("repo", "source", "target", no.alias("d"), yes.alias("t"), no.alias("c"), F.col("occurrences").alias("n"))
    c = pairs.select("repo", F.col("file_a").alias("source"), F.col("file_b").alias("target"), no.alias("d"), no.alias("t"), yes.alias("c"), F.col("count").alias("n"))
    return d.unionByName(t).unionByName(c).groupBy("repo", "source", "target").agg(
        F.max("d").alias("dependency"), F.max("t").alias("temporal"), F.max("c").alias("cochange"), F.sum("n").alias("strength"))


def in_slots(commits: DataFrame, window: int, order: list[str], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Add columns of the next rows of the repo: name -> (column, how many rows on), null beyond two windows.

    A lead by slots of time: rows are also offered to the slot before theirs, so a
    repo's history is no single partition.
    """
    slot = F.floor(F.col("t0") / window)
    both = commits.select("*", slot.alias("_own"), F.explode(F.array(slot, slot - 1)).alias("_slot"))
    w = Window.partitionBy("repo", "_slot").orderBy(*order)
    for name, (column, n) in columns.items():
        both = both.withColumn(name, F.lead(column, n).over(w))
    return both.where("_own = _slot").drop("_own", "_slot")


def sequences(commits: DataFrame, window: int = WEEK, files: int = 8) -> DataFrame:
    """(repo, files, length, occurrences, avg_delay_seconds): ordered pairs and triples of files of consecutive commits.

    The first ``files`` names of each commit; neighbours differ; the first and last
    commit lie at most a window apart. Commits without a time stand at 0 and take part
    in no sequence.
    """
    c = commits.select("repo", "sha", "ts", "t0", F.slice("files", 1, files).alias("f"))
    c = in_slots(c, window, ["t0", "sha"], {"f1": ("f", 1), "t1": ("ts", 1), "f2": ("f", 2), "t2": ("ts", 2)}).where("ts is not null")
    pair = c.where((F.col("t1") - F.col("ts")).between(0, window)).select("repo", (F.col("t1") - F.col("ts")).alias("delay"), F.explode("f").alias("a"), "f1").select(
        "repo", "delay", "a", F.explode("f1").alias("b")).where("a <> b").select("repo", "delay", F.array("a", "b").alias("files"))
    triple = c.where((F.col("t2") - F.col("ts")).between(0, window) & F.col("t1").isNotNull()).select("repo", (F.col("t2") - F.col("ts")).alias("delay"), F.explode("f").alias("a"), "f1", "f2").select(
        "repo", "delay", "a", F.explode("f1").alias("b"), "f2").where("a <> b").select("repo", "delay", "a", "b", F.explode("f2").alias("c")).where("b <> c").select("repo", "delay", F.array("a", "b", "c").alias("files"))
    return pair.unionByName(triple).groupBy("repo", "files").agg(F.count(F.lit(1)).alias("occurrences"), F.expr("sum(delay) div count(1)").alias("avg_delay_seconds")).select(
        "repo", "files", F.size("files").alias("length"), "occurrences", "avg_delay_seconds")


def links(pairs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both directions of co-change and of resolved dependencies, (repo, a, b) each once."""
    both = lambda d, a, b: d.select("repo", F.col(a).alias("a"), F.col(b).alias("b")).unionByName(d.select("repo", F.col(b).alias("a"), F.col(a).alias("b"))).distinct()
    return both(pairs, "file_a", "file_b"), both(edges, "source", "target")


def files_of(commits: DataFrame, *more: str) -> DataFrame:
    """(repo, sha, ts, path, more) of the commits with a time, a row for each file."""
    return commits.where("ts is not null").select("repo", "sha", "ts", F.explode("files").alias("path"), *more)


def same_file_pairs(commits: DataFrame, window: int, *more: str) -> DataFrame:
    """(repo, file, l_sha, r_sha, r_ts, delay, r_more): a row for each file that two commits in order and in the window share."""
    c = commits.select("repo", "sha", "ts", "files", *more)
    p = within(files_of(c), files_of(c, *more), window, on=("repo", "path"))
    return p.select(F.col("l_repo").alias("repo"), F.col("l_path").alias("file"), "l_sha", "r_sha", "r_ts", "delay", *[f"r_{m}" for m in more])


def _seed(names: DataFrame) -> int:
    """A seed with which no two (repo, name) have one 64-bit hash."""
    names = names.distinct()
    for seed in range(16):
        n, hashes = names.agg(F.count(F.lit(1)), F.count_distinct(F.xxhash64(F.lit(seed), "repo", "name"))).first()
        if n == hashes:
            return seed
    raise ValueError("names collide with every seed")


def linked_pairs(commits: DataFrame, linked: DataFrame, marks: dict, window: int, later: DataFrame | None = None) -> DataFrame:
    """(repo, l_sha, r_sha, r_ts, delay, marks): commits in order and in the window that share no file but have linked ones.

    linked (repo, a, b, marks); marks are joined by the aggregates given; ``later`` are the later commits
    asked for. Commits and files go by checked 64-bit hashes while their pairs meet the links, so a pair of
    files is four numbers to move, and commits are counted once for each pair before that.
    """
    linked = cut(linked)
    names = files_of(commits).select("repo", F.explode(F.array("sha", "path")).alias("name")).unionByName(linked.select("repo", F.col("a").alias("name")))
    seed = F.lit(_seed(names))
    number = lambda c: F.xxhash64(seed, "repo", c)
    numbered = lambda c: c.where("ts is not null").select("repo", "sha", "ts", number("sha").alias("id"), F.transform("files", lambda f: F.xxhash64(seed, "repo", f)).alias("f"))
    c = numbered(commits)
    pairs = within(c, c if later is None else numbered(later), window).where(~F.arrays_overlap("l_f", "r_f"))
    flat = pairs.select("l_id", "r_id", F.explode("l_f").alias("a"), "r_f").select("l_id", "r_id", "a", F.explode("r_f").alias("b"))
    hits = flat.join(linked.select(number("a").alias("a"), number("b").alias("b"), *marks), ["a", "b"]).groupBy("l_id", "r_id").agg(*[f(m).alias(m) for m, f in marks.items()])
    own = c.select("repo", "sha", "ts", "id")
    return hits.join(own.select("repo", F.col("id").alias("l_id"), F.col("sha").alias("l_sha"), F.col("ts").alias("l_ts")), "l_id").join(own.select(F.col("id").alias("r_id"), F.col("sha").alias("r_sha"), F.col("ts").alias("r_ts")), "r_id").select(
        "repo", "l_sha", "r_sha", "r_ts", (F.col("r_ts") - F.col("l_ts")).alias("delay"), *marks)


def with_flags(commits: DataFrame) -> DataFrame:
    """Commits with a time and files, and whether their message speaks of a fix or a revert."""
    return commits.where(F.col("ts").isNotNull() & (F.size("files") > 0)).select("repo", "sha", "ts", "files", text.is_fix(F.col("message")).alias("fix"), text.is_revert(F.col("message")).alias("revert"))


def fix_pairs(flagged: DataFrame, window: int) -> DataFrame:
    """(repo, l_sha, r_sha, r_ts, delay): commits in order and in the window of which the later one is a fix."""
    c = flagged.select("repo", "sha", "ts")
    return within(c, flagged.where("fix").select("repo", "sha", "ts"), window).select(F.col("l_repo").alias("repo"), "l_sha", "r_sha", "r_ts", "delay")


def both_links(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, a, b, co, dep): files that changed together and files that depend on each other, both ways."""
    near, uses = links(pairs, edges)
    no, yes = F.lit(False), F.lit(True)
    return near.select("repo", "a", "b", yes.alias("co"), no.alias("dep")).unionByName(uses.select("repo", "a", "b", no.alias("co"), yes.alias("dep"))).groupBy("repo", "a", "b").agg(F.max("co").alias("co"), F.max("dep").alias("dep"))


def followups(commits: DataFrame, pairs: DataFrame, edges: DataFrame, window: int = WEEK, files: bool = True) -> DataFrame:
    """(repo, source_sha, followup_sha, delay_seconds, reason, evidence_type, source_files, followup_files): later commits in the window that follow an earlier one up.

    reason, the first that holds: same-file-fix, same-file, co-change-history,
    dependency, fix-message; other pairs give no row. Pairs come from what makes them a
    row - a common file, a link, a fix - so commits without any never meet. Without
    ``files`` the last two columns are left out.
    """
    c = with_flags(commits)
    no, yes = F.lit(False), F.lit(True)
    key = ["repo", "l_sha", "r_sha", "delay"]
    flags = lambda **on: [on.get(f, no).alias(f) for f in ("overlap", "co", "dep", "fix")]
    every = same_file_pairs(c, window).select(*key, *flags(overlap=yes))
    every = every.unionByName(linked_pairs(c, both_links(pairs, edges), {"co": F.max, "dep": F.max}, window).select(*key, *flags(co=F.col("co"), dep=F.col("dep"))))
    every = every.unionByName(fix_pairs(c, window).select(*key, *flags(fix=yes)))
    p = every.groupBy(*key).agg(*[F.max(f).alias(f) for f in ("overlap", "co", "dep", "fix")])
    reason = (
        F.when(F.col("overlap") & F.col("fix"), "same-file-fix").when(F.col("overlap"), "same-file").when(F.col("co"), "co-change-history")
        .when(F.col("dep"), "dependency").when(F.col("fix"), "fix-message"))
    out = p.select("repo", F.col("l_sha").alias("source_sha"), F.col("r_sha").alias("followup_sha"), F.col("delay").alias("delay_seconds"), reason.alias("reason"), F.when(F.col("overlap"), "observed").otherwise("derived").alias("evidence_type"))
    return with_files(out, commits, source_sha="source_files", followup_sha="followup_files") if files else out


def with_files(pairs: DataFrame, commits: DataFrame, **names: str) -> DataFrame:
    """Pairs with the files of the commits that their columns name."""
    for sha, name in names.items():
        pairs = pairs.join(commits.select("repo", F.col("sha").alias(sha), F.col("files").alias(name)), ["repo", sha])
    return pairs


def rework(commits: DataFrame, pairs: DataFrame, edges: DataFrame, window: int = TWO_WEEKS) -> DataFrame:
    """(repo, file, initial_sha, rework_sha, delay_seconds, rule, evidence): files changed again within the window.

    rule: revert, else fix-message, else repeated-touch for a file of both commits;
    related-fix (once, for the later commit's first file) where a fix shares no file
    but a link.
    """
    c = with_flags(commits)
    rule = F.when(F.col("r_revert"), "revert").when(F.col("r_fix"), "fix-message").otherwise("repeated-touch")
    again = same_file_pairs(c, window, "fix", "revert")
    same = again.select("repo", "file", "l_sha", "r_sha", "delay", rule.alias("rule"), F.lit("").alias("near"))
    linked = linked_pairs(c, both_links(pairs, edges), {"dep": F.max}, window, c.where("fix"))
    related = with_files(linked, c, l_sha="l_files", r_sha="r_files").select("repo", F.col("r_files")[0].alias("file"), "l_sha", "r_sha", "delay", F.lit("related-fix").alias("rule"), text.first_sorted(F.col("l_files")).alias("near"))
    # The wording of the evidence.
    evidence = F.when(F.col("rule") == "related-fix", F.format_string("candidate rework: %s (related to %s) changed with a fix message after %ds (%s -> %s) [rule: related-fix]", "file", "near", "delay", text.short_sha(F.col("l_sha")), text.short_sha(F.col("r_sha")))).otherwise(
        F.format_string("candidate rework: %s changed again after %ds (%s -> %s) [rule: %s]", "file", "delay", text.short_sha(F.col("l_sha")), text.short_sha(F.col("r_sha")), "rule"))
    return same.unionByName(related).select("repo", "file", F.col("l_sha").alias("initial_sha"), F.col("r_sha").alias("rework_sha"), F.col("delay").alias("delay_seconds"), "rule", evidence.alias("evidence"))


def file_frequency(events: DataFrame, files: Column) -> DataFrame:
    """(repo, path, frequency): in how many events a file takes part."""
    return events.select("repo", F.explode(F.array_distinct(files)).alias("path")).groupBy("repo", "path").agg(F.count(F.lit(1)).alias("frequency"))


def timeline(commits: DataFrame, n: int = 300) -> DataFrame:
    """The last n commits of each repo in order, with their place in it (1 the oldest of all)."""
    last = Window.partitionBy("repo").orderBy(F.desc("t0"), F.desc("sha"))
    return commits.withColumn("from_end", F.row_number().over(last)).where(F.col("from_end") <= n)


def supporting_pairs(commits: DataFrame, wanted: DataFrame, window: int = WEEK) -> DataFrame:
    """(repo, source, target, shas): for each wanted (source, target) the first two times it happened.

    The first commits with the target that have one with the source at most a window
    before, each with the latest of those; at most four shas, sorted.
    """
    files = commits.where("ts is not null").select("repo", "sha", "ts", F.explode("files").alias("path"))
    s = files.join(wanted.select("repo", "source").distinct().withColumnRenamed("source", "path"), ["repo", "path"], "left_semi")
    t = files.join(wanted.select("repo", "target").distinct().withColumnRenamed("target", "path"), ["repo", "path"], "left_semi")
    p = within(s, t, window).select(F.col("l_repo").alias("repo"), F.col("l_path").alias("source"), F.col("r_path").alias("target"), "l_sha", "l_ts", "r_sha", "r_ts").join(wanted.select("repo", "source", "target"), ["repo", "source", "target"], "left_semi")
    latest = p.groupBy("repo", "source", "target", "r_sha", "r_ts").agg(F.max(F.struct("l_ts", "l_sha")).alias("l"))
    first = latest.withColumn("_k", F.row_number().over(Window.partitionBy("repo", "source", "target").orderBy("r_ts", "r_sha"))).where("_k <= 2")
    shas = first.groupBy("repo", "source", "target").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("l.l_sha", "r_sha"))))).alias("shas"))
    return shas.withColumn("shas", F.slice("shas", 1, 4))
