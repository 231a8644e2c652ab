import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import explanations, history, prefix
from tidemark.operators.prediction import FEATURES

STEPS = "repo string, at bigint, until bigint, item string, total bigint"


def steps_of(rows):
    """Running totals of (repo, at, item, n) as steps."""
    out, seen = [], {}
    for repo, at, item, n in sorted(rows):
        seen.setdefault((repo, item), []).append((at, n))
    for (repo, item), events in seen.items():
        total, by_time = 0, {}
        for at, n in events:
            by_time[at] = by_time.get(at, 0) + n
        times = sorted(by_time)
        for i, at in enumerate(times):
            total += by_time[at]
            out.append((repo, at, times[i + 1] if i + 1 < len(times) else None, item, total))
    return out


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 3), (3, 50)])
def test_best_before_is_the_best_of_all_before(spark, seed, k):
    rng = random.Random(seed)
    span = prefix.SPAN
    counts = [(f"r{rng.randrange(2)}", rng.randrange(12 * span // 1000) * 1000, f"i{min(int(rng.expovariate(0.2)), 30)}", rng.randrange(1, 4)) for _ in range(400)]
    times = [(r, t) for r in ("r0", "r1", "none") for t in sorted({rng.randrange(-span, 13 * span) for _ in range(40)} | {a for _, a, _, _ in counts[:30]})]
    got = prefix.best_before(
        spark.createDataFrame(steps_of(counts), STEPS), spark.createDataFrame(times, "repo string, t bigint"), k, [-F.col("total"), F.col("item")], ["item"])
    want = set()
    for repo, t in times:
        total = {}
        for r, at, item, n in counts:
            if r == repo and at < t:
                total[item] = total.get(item, 0) + n
        want |= {(repo, t, item, n) for n, item in sorted(((-n, i) for i, n in total.items()))[:k] for n, item in [(-n, item)]}
    assert {(r["repo"], r["t"], r["item"], r["total"]) for r in got.collect()} == want
    running = prefix.running(spark.createDataFrame(counts, "repo string, at bigint, item string, n bigint"), ["item"])
    assert sorted(map(tuple, running.select("repo", "at", "until", "item", "total").collect()), key=str) == sorted(steps_of(counts), key=str)


def test_nothing_before(spark):
    none = spark.createDataFrame([], STEPS)
    times = spark.createDataFrame([("r", 5)], "repo string, t bigint")
    assert prefix.best_before(none, times, 3, ["item"], ["item"]).count() == 0
    assert prefix.known_files(spark.createDataFrame([], "repo string, path string, ts bigint"), times).collect()[0]["n_files"] == 0


def test_numbers_go_on_over_spans(spark):
    rng = random.Random(4)
    rows = [(f"r{rng.randrange(2)}", rng.choice([None, 0, rng.randrange(10**8)]), f"s{i:03}") for i in range(200)]
    got = {r["sha"]: (r["_i"], r["_n"]) for r in history.numbered(spark.createDataFrame(rows, "repo string, ts bigint, sha string"), "ts", "sha").collect()}
    for repo in ("r0", "r1"):
        own = sorted((r for r in rows if r[0] == repo), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == [(i + 1, len(own)) for i in range(len(own))]


def test_explanations_of_missing_and_nan_values(spark):
    values = {f: float("nan") if f == "coupling" else None if f == "historical_churn" else 3.0 for f in FEATURES}
    rows = spark.createDataFrame([(1, "r", "a.py", *values.values())], "row_id bigint, repo string, file_path string, " + ", ".join(f"{f} double" for f in FEATURES))
    got = explanations.evidence_by_direction(rows, ["row_id"]).collect()
    assert {r["feature"]: r["value"] for r in got if r["feature"] in ("coupling", "historical_churn")} == {"coupling": None, "historical_churn": None}
    for side in ("supports", "contradicts"):
        weights = [abs(r["contribution"]) for r in sorted((r for r in got if r["direction"] == side), key=lambda r: r["rank"])]
        assert weights == sorted(weights, reverse=True)
    related = spark.createDataFrame([("r", "a.py", "b.py")], "repo string, path string, related string")
    said = [r["recommendation"] for r in explanations.recommendations(rows, related, ["row_id"]).orderBy("rank").collect()]
    assert any("b.py" in x for x in said) and len(said) <= explanations.MOST and not any("coupled files" in x for x in said)
    assert explanations.recommendations(rows.limit(0), related, ["row_id"]).count() == 0
