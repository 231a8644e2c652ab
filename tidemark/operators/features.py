"""Features of files as of a time: snapshots over a whole history and states strictly before each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.history import MONTH, WEEK, change_counts, cochange, numbered
from tidemark.session import cut


def snapshot(changed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Six historical features of every file over the whole history of its repo.

    contributor_count is the repository's; recent frequency is changes of the last 30
    days before the repository's last commit, per day.
    """
    ref = changed.groupBy("repo").agg(F.max("ts").alias("ref"), F.count_distinct("who").alias("contributor_count"))
    f = changed.join(ref, "repo").groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("previous_change_count"), F.sum(F.col("additions") + F.col("deletions")).alias("historical_churn"), F.first("contributor_count").alias("contributor_count"),
        (F.first("ref") - F.max("ts")).alias("time_since_last_change_secs"), (F.count_if(F.col("ts") >= F.col("ref") - MONTH) / 30.0).alias("recent_change_frequency"))
    return f.join(_pair_total(pairs), ["repo", "path"], "left").withColumn("historical_cochange_frequency", F.coalesce("historical_cochange_frequency", F.lit(0)))


def _pair_total(pairs: DataFrame) -> DataFrame:
    ends = pairs.select("repo", F.explode(F.array("file_a", "file_b")).alias("path"), "count")
    return ends.groupBy("repo", "path").agg(F.sum("count").alias("historical_cochange_frequency"))


def prefix(changed: DataFrame, window: int = MONTH) -> DataFrame:
    """Six historical features of each (repo, path, ts) where the file changed, from strictly earlier changes only.

    Changes at one time do not see each other. Per-time sums are aggregated first; frames
    by range then end one second before each time, so a file with very many changes at
    few times costs few rows. Contributors are counted as first sightings.
    """
    c = changed.where("ts is not null")
    size = c.groupBy("repo", "sha").agg(F.count(F.lit(1)).alias("n"))
    at = c.join(size, ["repo", "sha"]).groupBy("repo", "path", "ts").agg(
        F.count(F.lit(1)).alias("n_changes"), F.sum(F.col("additions") + F.col("deletions")).alias("n_churn"), F.sum(F.col("n") - 1).alias("n_pairs"))
    seen = c.where("who is not null").groupBy("repo", "path", "who").agg(F.min("ts").alias("ts")).groupBy("repo", "path", "ts").agg(F.count(F.lit(1)).alias("n_who"))
    at = at.join(seen, ["repo", "path", "ts"], "left")
    line = Window.partitionBy("repo", "path").orderBy("ts")
    before, recent = line.rangeBetween(Window.unboundedPreceding, -1), line.rangeBetween(-window, -1)
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    return at.select(
        "repo", "path", "ts", zero(F.sum("n_changes").over(before)).alias("previous_change_count"), zero(F.sum("n_churn").over(before)).alias("historical_churn"),
        zero(F.sum("n_who").over(before)).alias("contributor_count"), (F.col("ts") - F.max("ts").over(before)).alias("time_since_last_change_secs"),
        (zero(F.sum("n_changes").over(recent)) / float(window)).alias("recent_change_frequency"), zero(F.sum("n_pairs").over(before)).alias("historical_cochange_frequency"))


def file_times(changed: DataFrame, window: int = WEEK) -> DataFrame:
    """(repo, path, change_window_count, avg_change_delay_seconds, change_order_count) over the whole history.

    Changes in the last window before the repository's last time; the mean gap between
    changes without its fraction (null below two); how many of the repository's
    times are not after the file's last one.
    """
    c = changed.where("ts is not null")
    ref = c.groupBy("repo").agg(F.max("ts").alias("ref"))
    times = numbered(c.select("repo", "ts").distinct(), "ts").select("repo", "ts", F.col("_i").cast("bigint").alias("change_order_count"))
    f = c.join(ref, "repo").groupBy("repo", "path").agg(
        F.count_if(F.col("ts") >= F.col("ref") - window).alias("change_window_count"), F.when(F.count(F.lit(1)) > 1, F.expr("(max(ts) - min(ts)) div (count(1) - 1)")).alias("avg_change_delay_seconds"), F.max("ts").alias("ts"))
    return f.join(times, ["repo", "ts"]).drop("ts")


def temporal(changed: DataFrame, pairs: DataFrame, edges: DataFrame, follow: DataFrame, rework: DataFrame, window: int = WEEK) -> DataFrame:
    """Eight temporal features of every file that appears in the given pairs, edges or frequencies.

    pairs (source, occurrences), edges (source, target, strength); follow and rework
    (path, frequency).
    """
    s = pairs.groupBy("repo", F.col("source").alias("path")).agg(F.sum("occurrences").alias("recent_change_sequence_count"))
    p = edges.select("repo", F.explode(F.array("source", "target")).alias("path"), "strength").groupBy("repo", "path").agg(F.sum("strength").alias("propagation_frequency"))
    keys = pairs.select("repo", F.explode(F.array("source", "target")).alias("path")).unionByName(p.select("repo", "path")).unionByName(follow.select("repo", "path")).unionByName(rework.select("repo", "path")).distinct()
    files = changed.where("ts is not null").groupBy("repo").agg(F.count_distinct("path").alias("n_files"))
    t = file_times(changed, window).withColumn("known", F.lit(1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    on = ["repo", "path"]
    out = keys.join(s, on, "left").join(p, on, "left").join(follow.withColumnRenamed("frequency", "followup_frequency"), on, "left").join(rework.withColumnRenamed("frequency", "historical_rework_frequency"), on, "left").join(t, on, "left").join(files, "repo", "left")
    return out.select(
        "repo", "path", zero("recent_change_sequence_count"), (F.coalesce("n_files", F.lit(0)) - F.coalesce("known", F.lit(0))).cast("bigint").alias("previous_files_changed_count"), zero("change_window_count"), "avg_change_delay_seconds",
        zero("change_order_count"), zero("propagation_frequency"), zero("followup_frequency"), zero("historical_rework_frequency"))


#: Commits of a repository that meet its files' states in one slot of time, on average.
SLOT_COMMITS = 256


def states_until(changed: DataFrame, windows: dict[str, int]) -> DataFrame:
    """(repo, path, at, until, changed, running state, counts): each file's states, each seen by the times after ``at`` up to ``until`` (null: for ever).

    windows name counts of the changes at most so many seconds before; a count falls when a
    change leaves its window, so there is a state from then on too. changed: the file changes at ``until``.
    """
    a = after(changed).withColumn("s", F.struct("ts", *STATE)).select("repo", "path", F.col("ts").alias("at"), "n_changes", "s")
    none = F.lit(0).cast("bigint")
    events = a.select("repo", "path", "at", "s", *[F.col("n_changes").alias(w) for w in windows])
    for name, secs in windows.items():
        events = events.unionByName(a.select("repo", "path", (F.col("at") + secs).alias("at"), F.lit(None).cast(a.schema["s"].dataType).alias("s"), *[(-F.col("n_changes") if w == name else none).alias(w) for w in windows]))
    events = events.groupBy("repo", "path", "at").agg(F.max("s").alias("s"), *[F.sum(w).alias(w) for w in windows])
    line = Window.partitionBy("repo", "path").orderBy("at")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.select("repo", "path", "at", F.lead("at").over(line).alias("until"), F.coalesce(F.lead(F.col("s").isNotNull()).over(line), F.lit(False)).alias("changed"), F.max("s").over(upto).alias("s"), *[F.sum(w).over(upto).alias(w) for w in windows])


def dataset(changed: DataFrame, known: DataFrame, window: int = MONTH, times: bool = False, moments: DataFrame | None = None) -> DataFrame:
    """(repo, sha, ts, path, label, six features): every commit's changed files (1) and the known files it left alone (0).

    known (repo, path) are the files with structural features. A file is known at a
    commit if it changed strictly before. Features are the state strictly before the
    commit's time: a file's states are spans of time, which meet the repository's commits
    by slots of time, and the rows are made where they meet and move no more. Only commits at a time at
    which the file changes are asked whether they changed it. With times also
    first_ts, last_ts and week_changes, of the changes before and of those at most a week before.
    Further columns of known are the rows' too. moments (repo, ts, n_files, place), one for each
    time: rows have n_files of their time and the place of last_ts.
    """
    carried = [c for c in known.columns if c not in ("repo", "path")]
    files = known.distinct().select("repo", "path", F.struct(*carried).alias("file")) if carried else known.select("repo", "path").distinct()
    windows = {"recent": window} | ({"week_changes": WEEK} if times else {})
    timed = changed.where("ts is not null")
    steps = states_until(timed, windows).join(files, ["repo", "path"])
    commits = timed.select("repo", "sha", "ts").distinct()
    own = timed.select("repo", "sha", "ts", "path").distinct().join(files.withColumnRenamed("file", "own_file"), ["repo", "path"])
    if moments is not None:
        steps = steps.withColumn("last_ts", F.col("s.last_ts")).join(moments.select("repo", F.col("ts").alias("last_ts"), "place"), ["repo", "last_ts"], "left").drop("last_ts")
        commits = commits.join(moments.select("repo", "ts", "n_files"), ["repo", "ts"], "left")
        own = own.join(moments.select("repo", "ts", F.col("n_files").alias("own_files")), ["repo", "ts"], "left")
    steps, of_time = cut(steps), [c for c in commits.columns if c == "n_files"]
    ends = commits.groupBy("repo").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n"))
    ends = ends.select("repo", "lo", "hi", F.ceil((F.col("hi") - F.col("lo") + 1).cast("double") / F.col("n") * SLOT_COMMITS).alias("width"))
    slot = lambda t: F.floor((t - F.col("lo")) / F.col("width"))
    got = ["s", *windows, *(["file"] if carried else []), *(["place"] if moments is not None else [])]
    last = F.least(F.coalesce(F.col("until") - F.col("changed").cast("int"), F.col("hi")), F.col("hi"))
    spans = steps.join(ends, "repo").withColumn("last", last).where("at < last").select("repo", "path", "at", "last", *got, F.explode(F.sequence(slot(F.col("at") + 1), slot(F.col("last")))).alias("slot"))
    placed = commits.join(ends, "repo").select("repo", "sha", "ts", *of_time, slot(F.col("ts")).alias("slot"))
    between = spans.join(placed, ["repo", "slot"]).where("ts > at and ts <= last").select("repo", "sha", "ts", "path", F.lit(0).alias("label"), *got, *of_time)
    border = steps.where("changed").select("repo", "path", F.col("until").alias("ts"), *got).join(commits, ["repo", "ts"])
    border = border.join(own.withColumn("own", F.lit(1)), ["repo", "sha", "ts", "path"], "full")
    filled = {"file": F.coalesce("file", "own_file"), "n_files": F.coalesce("n_files", "own_files")}
    border = border.select("repo", "sha", "ts", "path", F.coalesce("own", F.lit(0)).alias("label"), *[filled[c].alias(c) if c in filled else c for c in [*got, *of_time]])
    rows = between.unionByName(border)
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).alias(n)
    more = ["s.first_ts", "s.last_ts", zero("week_changes", "week_changes")] if times else []
    more += [*[f"file.{c}" for c in carried], *of_time, *(["place"] if moments is not None else [])]
    return rows.select("repo", "sha", "ts", "path", "label", *[zero(f"s.{n}", n) for n in STATE if n not in ("first_ts", "last_ts")], (F.col("ts") - F.col("s.last_ts")).alias("time_since_last_change_secs"), (zero("recent", "recent") / float(window)).alias("recent_change_frequency"), *more)


STATE = ["previous_change_count", "historical_churn", "contributor_count", "first_ts", "last_ts", "historical_cochange_frequency"]


def after(changed: DataFrame) -> DataFrame:
    """(repo, path, ts, n_changes, running state): each file's state once the changes of a time are in."""
    c = changed.where("ts is not null")
    size = c.groupBy("repo", "sha").agg(F.count(F.lit(1)).alias("n"))
    at = c.join(size, ["repo", "sha"]).groupBy("repo", "path", "ts").agg(
        F.count(F.lit(1)).alias("n_changes"), F.sum(F.col("additions") + F.col("deletions")).alias("n_churn"), F.sum(F.col("n") - 1).alias("n_pairs"))
    seen = c.where("who is not null").groupBy("repo", "path", "who").agg(F.min("ts").alias("ts")).groupBy("repo", "path", "ts").agg(F.count(F.lit(1)).alias("n_who"))
    line = Window.partitionBy("repo", "path").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda x: F.coalesce(F.sum(x).over(line), F.lit(0)).cast("bigint")
    return at.join(seen, ["repo", "path", "ts"], "left").select(
        "repo", "path", "ts", "n_changes", total("n_changes").alias("previous_change_count"), total("n_churn").alias("historical_churn"), total("n_who").alias("contributor_count"), F.min("ts").over(line).alias("first_ts"), F.col("ts").alias("last_ts"), total("n_pairs").alias("historical_cochange_frequency"))


__all__ = ["after", "change_counts", "cochange", "dataset", "file_times", "prefix", "snapshot", "states_until", "temporal"]
