import random

from pyspark.sql import functions as F

from tidemark.operators import features, prefix
from tidemark.session import cut

CHANGES = "repo string, sha string, ts bigint, who string, pos int, path string, additions bigint, deletions bigint"


def moved(spark, run):
    """What run gives, and the records that its shuffles wrote."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s := stages.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    got = run()
    return got, sum(n for stage, n in written().items() if stage not in before)


def brute(rows, window, week):
    commits = {(r, s): t for r, s, t, *_ in rows}
    out = set()
    for (repo, sha), ts in commits.items():
        for path in {x[5] for x in rows if x[0] == repo}:
            past = [x for x in rows if x[0] == repo and x[5] == path and x[2] < ts]
            here = any(x[:2] == (repo, sha) and x[5] == path for x in rows)
            if here or past:
                times = [x[2] for x in past]
                out.add((sha, path, int(here), len(past), len({x[3] for x in past}), ts - max(times) if times else None,
                         sum(t >= ts - window for t in times), sum(t >= ts - week for t in times), min(times, default=None)))
    return out


def test_like_brute_force_with_equal_times_and_edges_of_windows(spark):
    rng = random.Random(5)
    month, week = features.MONTH, features.WEEK
    times = [0, 0, 5, week, week + 5, week + 6, month, month, month + 1, month + 5, month + 6, 3 * month]
    rows = [(repo, f"{repo}{i:02}", t, rng.choice("xy"), p, f"f{f}", 2, 1) for repo in "ab" for i, t in enumerate(times) for p, f in enumerate(rng.sample(range(6), 3))]
    df = spark.createDataFrame(rows, CHANGES)
    got = features.dataset(df, df.select("repo", "path"), times=True).select("sha", "path", "label", "previous_change_count", "contributor_count", "time_since_last_change_secs", F.round(F.col("recent_change_frequency") * month).cast("int"), "week_changes", "first_ts")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, month, week), key=str)


def test_rows_are_not_moved(spark):
    rows = [("r", f"s{i:03}", i * 10_000, "x", p, f"f{(i + 60 * p) % 240}", 1, 1) for i in range(480) for p in range(4)]
    df = cut(spark.createDataFrame(rows, CHANGES))
    got = features.dataset(df, df.select("repo", "path"))
    _, records = moved(spark, lambda: got.write.format("noop").mode("overwrite").save())
    n = got.count()
    assert n > 80_000 and records < n / 2, (n, records)


def test_rows_move_once_to_meet_their_lists(spark, monkeypatch):
    rows = [("r", f"s{i:03}", i * 10_000, "x", p, f"f{(i + 60 * p) % 240}", 1, 1) for i in range(480) for p in range(4)]
    df = cut(spark.createDataFrame(rows, CHANGES))
    names = ["recent_change_sequence_count", "propagation_frequency", "followup_frequency", "historical_rework_frequency"]
    listed = spark.createDataFrame([("r", 4_000_000, "f1", 1, 2, 3, 4)], "repo string, t bigint, path string, " + ", ".join(f"{n} bigint" for n in names))
    monkeypatch.setattr(prefix, "temporal_features", lambda *_: listed)
    monkeypatch.setattr(prefix, "cut", lambda d: d)
    structural = df.select("repo", "path", F.lit(7).alias("lines_of_code")).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = prefix.full_dataset(None, df, None, structural)
        _, records = moved(spark, lambda: got.write.format("noop").mode("overwrite").save())
        got = cut(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    n = got.count()
    assert n > 80_000 and got.where("lines_of_code is null").count() == 0 and records < 2 * n, (n, records)
    assert [(r["path"], r["propagation_frequency"], r["change_order_count"] > 0) for r in got.where("propagation_frequency > 0").collect()] == [("f1", 2, True)]
