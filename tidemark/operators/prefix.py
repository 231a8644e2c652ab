"""What a history looked like strictly before each of its commits: lists of the best so far, and features from them.

Plan. A repository whose pairs fit a task is one group of rows, and its lists come from memory
(``replay``): only its commits, references and times move. For all others nothing is
replayed. What can be in a list is a step: an item with a key, seen by
the times after ``at`` up to ``until``. Keys of an item only get better, so the k-th
best key of the steps of one span of time bounds all later lists: a step behind the bound
when it starts, or from a later span on, is dropped before it meets any time. The few
steps left meet the times of their own span in an equi-join, and are ranked there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import features, replay
from tidemark.operators.history import MONTH, TWO_WEEKS, WEEK, fix_pairs, linked_pairs, links, numbered, same_file_pairs, with_files, with_flags, within
from tidemark.session import cut, ship, tasks

#: Pairs of files that a task goes through for one repository, of all commits and of one commit, and pairs of files that one repository's commits hold.
MOST_PAIRS, MOST_OF_ONE, MOST_TOGETHER = 2**31, 2**22, 2**22
#: Seconds of a span, and the time before all others.
SPAN, EVER = 28 * 86_400, -(2**62)


def _span(time: str):
    return F.floor(F.col(time) / SPAN)


def best_before(steps: DataFrame, times: DataFrame, k: int, key: list, names: list[str]) -> DataFrame:
    """(repo, t, columns of steps): the k first steps by ``key`` that each time (repo, t) sees.

    steps have repo, at, until (null: for ever) and the names that tell items apart; an
    item is seen once by a time, and its key never gets worse.
    """
    columns = [c for c in steps.columns if c not in ("repo", "at", "until")]
    times = times.select("repo", "t").distinct().withColumn("span", _span("t"))
    ends = times.groupBy("repo").agg(F.min("span").alias("lo"), F.max("span").alias("hi"))
    s = steps.join(ends, "repo").withColumn("key", F.struct(*key)).withColumn("span", F.greatest(_span("at"), "lo")).withColumn("to", F.least(F.coalesce(_span("until"), "hi"), "hi")).where("span <= to").drop("lo", "hi")
    newest = s.groupBy("repo", "span", *names).agg(F.min("key").alias("key"))
    ranked = newest.withColumn("_r", F.row_number().over(Window.partitionBy("repo", "span").orderBy("key"))).where(F.col("_r") <= k)
    kth = ranked.groupBy("repo", "span").agg(F.max("key").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")
    before = Window.partitionBy("repo").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # spans of a repository: a few hundred
    bounds = ends.select("repo", F.explode(F.sequence("lo", "hi")).alias("span")).join(kth, ["repo", "span"], "left").select("repo", "span", F.min("kth").over(before).alias("bound"))
    held = F.col("bound").isNull() | (F.col("key") <= F.col("bound"))
    s = s.join(bounds, ["repo", "span"]).where(held).drop("bound").withColumn("span", F.explode(F.sequence("span", "to"))).join(bounds, ["repo", "span"]).where(held)
    seen = s.join(times, ["repo", "span"]).where((F.col("t") > F.col("at")) & (F.col("until").isNull() | (F.col("t") <= F.col("until"))))
    return seen.withColumn("_r", F.row_number().over(Window.partitionBy("repo", "t").orderBy("key"))).where(F.col("_r") <= k).select("repo", "t", *columns)


def running(counts: DataFrame, names: list[str]) -> DataFrame:
    """Steps of (repo, at, names, n): each item's running total, from each time it grows to the next."""
    own = Window.partitionBy("repo", *names).orderBy("at")
    c = counts.groupBy("repo", "at", *names).agg(F.sum("n").alias("n"))
    return c.select("repo", "at", F.lead("at").over(own).alias("until"), *names, F.sum("n").over(own).alias("total"))


def temporal_before(commits: DataFrame, times: DataFrame, k: int = 50, window: int = WEEK) -> DataFrame:
    """(repo, t, source, target, total): the k most frequent temporal pairs of the commits before each time."""
    c = commits.where(F.col("ts").isNotNull() & (F.size("files") > 0)).select("repo", "sha", "ts", "files")
    p = within(c, c, window).select(F.col("l_repo").alias("repo"), F.col("r_ts").alias("at"), F.explode("l_files").alias("source"), "r_files").select("repo", "at", "source", F.explode("r_files").alias("target")).where("source <> target")
    steps = running(p.groupBy("repo", "at", "source", "target").agg(F.count(F.lit(1)).alias("n")), ["source", "target"])
    return best_before(steps, times, k, [-F.col("total"), F.col("source"), F.col("target")], ["source", "target"])


def cochange_at(changed: DataFrame) -> DataFrame:
    """(repo, at, source, target, n): pairs of places that the commits of each time hold of two files, source <= target."""
    c = changed.where("ts is not null")
    a = c.select("repo", "sha", F.col("ts").alias("at"), F.col("pos").alias("pa"), F.col("path").alias("a"))
    b = c.select("repo", "sha", F.col("pos").alias("pb"), F.col("path").alias("b"))
    return a.join(b, ["repo", "sha"]).where("pa < pb").groupBy("repo", "at", F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(F.count(F.lit(1)).alias("n"))


def propagation_before(cochanged: DataFrame, edges: DataFrame, temporal: DataFrame, times: DataFrame, k: int = 100) -> DataFrame:
    """(repo, t, source, target, strength): the k strongest edges of each time; temporal are its temporal pairs.

    Dependencies hold at all times and co-changes only add up, so what the temporal pairs add
    can lift only those pairs themselves over the k best without them.
    """
    always = edges.where("source <> target and not startswith(target, '$')").groupBy("repo", F.lit(EVER).alias("at"), "source", "target").agg(F.count(F.lit(1)).alias("n"))
    steps = cut(running(cochanged.unionByName(always), ["source", "target"]))
    best = best_before(steps, times, k, [-F.col("total"), F.col("source"), F.col("target")], ["source", "target"])
    own = steps.select("repo", "source", "target", "at", "until", F.col("total").alias("steady"))
    lifted = temporal.join(own, ["repo", "source", "target"]).where((F.col("t") > F.col("at")) & (F.col("until").isNull() | (F.col("t") <= F.col("until")))).select("repo", "t", "source", "target", "steady")
    zero = F.lit(0).cast("bigint")
    edge = ["repo", "t", "source", "target"]
    every = best.select(*edge, F.col("total").alias("steady"), zero.alias("more")).unionByName(temporal.select(*edge, zero.alias("steady"), F.col("total").alias("more"))).unionByName(lifted.select(*edge, "steady", zero.alias("more")))
    every = every.groupBy(*edge).agg((F.max("steady") + F.max("more")).alias("strength"))
    return every.withColumn("_r", F.row_number().over(Window.partitionBy("repo", "t").orderBy(F.desc("strength"), "source", "target"))).where(F.col("_r") <= k).drop("_r")


def followups_before(commits: DataFrame, cochanged: DataFrame, edges: DataFrame, times: DataFrame, k: int = 100, window: int = WEEK, again: int = TWO_WEEKS) -> tuple[DataFrame, DataFrame]:
    """The k quickest follow-ups (repo, t, files) and reworks (repo, t, file) that each time sees.

    A pair of commits is one from the later commit on if they share a file, the later one
    is a fix, or a dependency links them; else from when two of their files first changed together.
    """
    first = cochanged.groupBy("repo", "source", "target").agg(F.min("at").alias("since"))
    near = first.select("repo", F.col("source").alias("a"), F.col("target").alias("b"), "since").unionByName(first.select("repo", F.col("target").alias("a"), F.col("source").alias("b"), "since"))
    uses = links(first.select("repo", F.col("source").alias("file_a"), F.col("target").alias("file_b")), edges)[1].withColumn("since", F.lit(EVER))
    linked = near.unionByName(uses).groupBy("repo", "a", "b").agg(F.min("since").alias("since"))
    c = with_flags(commits)
    never = F.lit(None).cast("bigint").alias("until")
    pair = ["repo", "l_sha", "r_sha", "delay"]
    shared = cut(same_file_pairs(c, again))
    over_links = cut(linked_pairs(c, linked, {"since": F.min}, again).withColumn("at", F.greatest("r_ts", "since")))
    seen = shared.select(*pair, F.col("r_ts").alias("at")).unionByName(over_links.select(*pair, "at")).unionByName(fix_pairs(c, window).select(*pair, F.col("r_ts").alias("at"))).where(F.col("delay") <= window)
    follow = best_before(seen.groupBy(*pair).agg(F.min("at").alias("at")).withColumn("until", never), times, k, ["delay", "l_sha", "r_sha"], ["l_sha", "r_sha"])
    files = with_files(follow, c, l_sha="l_files", r_sha="r_files").select("repo", "t", F.array_distinct(F.concat("l_files", "r_files")).alias("files"))
    same = shared.select("repo", F.col("r_ts").alias("at"), never, "delay", "file", "l_sha", "r_sha")
    fixes = c.where("fix").select("repo", F.col("sha").alias("r_sha"), F.col("files")[0].alias("file"))
    related = over_links.join(fixes, ["repo", "r_sha"]).select("repo", "at", never, "delay", "file", "l_sha", "r_sha")
    return files, best_before(same.unionByName(related), times, k, ["delay", "file", "l_sha", "r_sha"], ["file", "l_sha", "r_sha"]).select("repo", "t", "file")


def known_files(changed: DataFrame, times: DataFrame) -> DataFrame:
    """(repo, t, n_files): the files changed strictly before each time."""
    first = changed.where("ts is not null").groupBy("repo", "path").agg(F.min("ts").alias("ts")).groupBy("repo", "ts").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(None).cast("bigint"))
    both = first.unionByName(times.select("repo", F.col("t").alias("ts"), F.lit(0).cast("bigint").alias("n"), "t")).withColumn("span", _span("ts"))
    before = Window.partitionBy("repo").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    start = both.groupBy("repo", "span").agg(F.sum("n").alias("n")).select("repo", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("repo", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return both.withColumn("own", own).where("t is not null").join(start, ["repo", "span"]).select("repo", "t", (F.col("start") + F.col("own")).cast("bigint").alias("n_files"))


def _rows(commits: DataFrame, changed: DataFrame, edges: DataFrame, times: DataFrame) -> DataFrame:
    """The rows of ``replay.INPUT``: a repository's commits with a time and files, their changes if several, references and times."""
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in replay.INPUT.split(", ")}
    row = lambda df, kind, **have: df.select(*[(F.lit(kind).cast("tinyint") if c == "kind" else have.get(c, n)).alias(c) for c, n in (none | {"repo": F.col("repo")}).items()])
    c = with_flags(commits)
    together = changed.where("ts is not null").groupBy("repo", "sha", "ts").agg(F.collect_list("path").alias("paths")).where(F.size("paths") > 1)
    return (
        row(c, replay.COMMIT, ts=F.col("ts"), sha=F.col("sha"), fix=F.col("fix"), files=F.col("files")).unionByName(row(together, replay.CHANGE, ts=F.col("ts"), files=F.col("paths")))
        .unionByName(row(edges, replay.EDGE, sha=F.col("source"), path=F.col("target"))).unionByName(row(times.where("t is not null"), replay.TIME, ts=F.col("t")))).where("repo is not null")


def _large(rows: DataFrame, most: tuple[int, int, int]) -> DataFrame:
    """Repositories of which a task does not go through the pairs: bounds of their number from sums by slots of two weeks."""
    slot = F.floor(F.col("ts") / TWO_WEEKS).alias("slot")
    size = rows.where(F.col("kind") == replay.COMMIT).select("repo", slot, F.size("files").cast("bigint").alias("n"))
    own = size.groupBy("repo", "slot").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    last = Window.partitionBy("repo").orderBy("slot")
    met = own.withColumn("met", F.col("all") + F.when(F.lag("slot").over(last) == F.col("slot") - 1, F.lag("all").over(last)).otherwise(0))
    pairs = met.groupBy("repo").agg(F.sum(F.col("all") * F.col("met")).alias("pairs"), F.max(F.col("most") * F.col("met")).alias("one"))
    held = rows.where(F.col("kind") == replay.CHANGE).select("repo", F.size("files").cast("bigint").alias("n")).groupBy("repo").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("together"))
    return pairs.join(held, "repo", "full").where((F.col("pairs") > most[0]) | (F.col("one") > most[1]) | (F.col("together") > most[2])).select("repo")


def temporal_features(commits: DataFrame, changed: DataFrame, edges: DataFrame, times: DataFrame, most: tuple[int, int, int] = (MOST_PAIRS, MOST_OF_ONE, MOST_TOGETHER)) -> DataFrame:
    """(repo, t, path, four frequencies) of the files that the lists of each time (repo, t) hold.

    The frequencies are those of ``features.temporal``, from what came strictly before t. Repositories
    beyond one of the bounds ``most`` go by joins, all others each in a task.
    """
    ship(commits.sparkSession)
    rows = cut(_rows(commits, changed, edges, times))
    large = _large(rows, most)
    some = not large.isEmpty()
    large = cut(large) if some else large
    small = rows.join(large, "repo", "left_anti") if some else rows
    lists = small.repartition(2 * tasks(commits.sparkSession), "repo").groupBy("repo").applyInArrow(replay.replayed(50, 100, WEEK, TWO_WEEKS), replay.SPANS).withColumn("t", F.explode("t"))
    return lists.unionByName(joined_features(*[d.join(large, "repo", "left_semi") for d in (commits, changed, edges, times)])) if some else lists


def joined_features(commits: DataFrame, changed: DataFrame, edges: DataFrame, times: DataFrame) -> DataFrame:
    """What ``temporal_features`` gives, by joins: no repository has to fit a task."""
    edges, times, cochanged = cut(edges), cut(times), cut(cochange_at(changed))
    pairs = cut(temporal_before(commits, times))
    strong = propagation_before(cochanged, edges, pairs, times)
    follow, rework = followups_before(commits, cochanged, edges, times)
    zero = F.lit(0).cast("bigint")
    names = ["recent_change_sequence_count", "propagation_frequency", "followup_frequency", "historical_rework_frequency"]

    def part(df: DataFrame, path, name: str | None, n=F.lit(1)) -> DataFrame:
        return df.select("repo", "t", path.alias("path"), *[(n if c == name else zero).cast("bigint").alias(c) for c in names])

    every = part(pairs, F.col("source"), names[0], F.col("total")).unionByName(part(pairs, F.col("target"), None))
    for end in ("source", "target"):
        every = every.unionByName(part(strong, F.col(end), names[1], F.col("strength")))
    every = every.unionByName(part(follow, F.explode("files"), names[2])).unionByName(part(rework, F.col("file"), names[3]))
    return every.groupBy("repo", "t", "path").agg(*[F.sum(c).alias(c) for c in names])


def full_dataset(commits: DataFrame, changed: DataFrame, edges: DataFrame, structural: DataFrame, window: int = MONTH) -> DataFrame:
    """(repo, sha, ts, path, label, 23 features): every commit's changed files (1) and known files left alone (0), with structural features.

    All but the structural features are the state strictly before the commit's time:
    commits of one time do not see each other. A file that none of the lists of a time
    holds has zeros, and no mean delay, for its temporal features.
    """
    times = changed.where("ts is not null").select("repo", F.col("ts").alias("t")).distinct()
    lists = cut(temporal_features(commits, changed, edges, times))
    order = numbered(times, "t").select("repo", F.col("t").alias("last_ts"), F.col("_i").cast("bigint").alias("place"))
    moments = cut(known_files(changed, times).join(order.withColumnRenamed("last_ts", "t"), ["repo", "t"]).withColumnRenamed("t", "ts"))
    rows = features.dataset(changed, structural, window, times=True, moments=moments)
    rows = rows.join(lists.withColumnRenamed("t", "ts").withColumn("listed", F.lit(True)), ["repo", "ts", "path"], "left")
    n = F.col("previous_change_count")
    zero = lambda c: F.coalesce(F.when(F.col("listed"), c), F.lit(0)).cast("bigint")
    same = [c for c in structural.columns if c not in ("repo", "path")]
    return rows.select(
        "repo", "sha", "ts", "path", "label", *same, "previous_change_count", "historical_churn", "contributor_count", "time_since_last_change_secs", "recent_change_frequency", "historical_cochange_frequency",
        zero(F.col("recent_change_sequence_count")).alias("recent_change_sequence_count"),
        zero(F.col("n_files") - F.col("last_ts").isNotNull().cast("int")).alias("previous_files_changed_count"),
        zero(F.col("week_changes")).alias("change_window_count"),
        F.when(F.col("listed") & (n > 1), F.expr("(last_ts - first_ts) div (previous_change_count - 1)")).alias("avg_change_delay_seconds"),
        zero(F.col("place")).alias("change_order_count"), zero(F.col("propagation_frequency")).alias("propagation_frequency"),
        zero(F.col("followup_frequency")).alias("followup_frequency"), zero(F.col("historical_rework_frequency")).alias("historical_rework_frequency"))
