import numpy as np
import pandas as pd
import pytest

from tidemark.llm.mixing import LEAVES, deal, mix_report, mix_sources, plan_mix, shard_report, split_counts

DOCS = "doc_id bigint, source string, n_tokens bigint, shard int, copies bigint"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for s, n in (("big", 4000), ("mid", 300), ("small", 12), ("single", 1)):
        for _ in range(n):
            rows.append((i, s, int(rng.integers(1, 60)), 0, 0))
            i += 1
    rows += [(i, None, 5, 0, 0), (i + 1, "big", None, 0, 0), (i + 2, "big", 0, 0, 0), (None, "big", 9, 0, 0)]
    return spark.createDataFrame(rows, DOCS)


def report(docs, targets, **kw):
    mixed = mix_sources(docs, targets, **kw)
    return {(r["mix_name"], r["source"]): r for r in mix_report(mixed, targets).collect()}, mixed


def test_shares_and_caps(spark, docs):
    targets = spark.createDataFrame(
        [("a", "big", 0.5, 2), ("a", "mid", 0.3, 2), ("a", "small", 0.2, 4), ("a", "small", 0.2, 4), ("b", "big", 0.5, 1), ("b", "none", 0.5, None), ("c", "single", 0.5, None), ("c", "mid", 0.5, 1), ("d", "none", 1.0, 3), (None, "big", 1.0, 1), ("e", None, 1.0, 1)], TARGETS)
    got, mixed = report(docs, targets, shard_tokens=500)
    total = {s: n for s, n in docs.where("source is not null and doc_id is not null").groupBy("source").sum("n_tokens").collect()}
    whole = 4 * total["small"] / 0.2
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(got["a", s]["tokens"] - whole * share) <= 31
        assert got["a", s]["most_copies"] <= 4
    assert got["a", "small"]["most_copies"] == 4 and got["a", "small"]["documents"] == 12
    assert got["b", "big"]["actual_share"] == 1.0 and got["b", "none"]["tokens"] == 0 and got["b", "big"]["tokens"] == total["big"]
    assert abs(got["c", "single"]["actual_share"] - 0.5) < 0.05 and got["c", "single"]["most_copies"] > 1
    assert got["d", "none"]["tokens"] == 0 and got["d", "none"]["actual_share"] is None
    n = mixed.where("mix_name = 'a'").groupBy("shard").sum("n_tokens").count()
    assert n > 3
    assert mixed.groupBy("mix_name", "doc_id", "shard").count().where("count > 1").count() == 0


def test_total_and_same_seed(spark, docs):
    targets = spark.createDataFrame([("a", "big", 0.6, 1), ("a", "mid", 0.4, 1)], TARGETS)
    got, mixed = report(docs, targets, total_tokens=5000)
    assert abs(got["a", "big"]["tokens"] - 3000) <= 31 and abs(got["a", "mid"]["tokens"] - 2000) <= 31
    again = mix_sources(docs.repartition(3), targets, total_tokens=5000)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))
    other = mix_sources(docs, targets, total_tokens=5000, seed=1)
    assert sorted(map(tuple, mixed.collect())) != sorted(map(tuple, other.collect()))


def test_nothing(spark, docs):
    targets = spark.createDataFrame([("a", "big", 1.0, 1)], TARGETS)
    assert mix_sources(docs.limit(0), targets).count() == 0
    assert mix_sources(docs, targets.limit(0)).count() == 0
    assert mix_report(mix_sources(docs.limit(0), targets), targets).collect()[0]["tokens"] == 0


def leaves(n, shards, key):
    return {a: (f.tolist(), x) for a, f, x in split_counts(np.array(n), shards, key)}


def test_split_is_exact():
    n = np.array([1000, 37, 0, 1])
    got = leaves(n, 13, ("x",))
    parts = np.stack([got[i][1] for i in range(13)])
    assert (parts.sum(0) == n).all() and (parts >= 0).all() and parts.sum(1).max() - parts.sum(1).min() <= 4
    assert [got[i][0] for i in range(13)] == [parts[:i].sum(0).tolist() for i in range(13)]


def test_parts_of_the_tree_are_the_tree():
    whole = leaves([700, 300, 5], 37, ("x",))
    for depth in (1, 3, 6, 7):
        got = {a: (f.tolist(), x) for node in range(1 << depth) for a, f, x in split_counts(np.array([700, 300, 5]), 37, ("x",), depth, node)}
        assert {a: (f, x.tolist()) for a, (f, x) in got.items()} == {a: (f, x.tolist()) for a, (f, x) in whole.items()}


def test_draws_are_hypergeometric():
    # the first of four shards of 8 + 24 slots gets 8 of them: mean 2 and variance 8 * 1/4 * 3/4 * 24/31
    x = np.array([next(split_counts(np.array([8, 24]), 4, (k,)))[2][0] for k in range(4000)])
    assert abs(x.mean() - 2) < 0.08 and abs(x.var() - 1.1613) < 0.12


def test_plan_counts_copies():
    targets = pd.DataFrame({"source": ["s", "t"], "share": [0.5, 0.5], "cap": [None, 1]})
    runs, whole = plan_mix(targets, {"s": 60, "t": 600}, None, 10)
    assert whole == 1200 and [(r.blocks, r.passes, r.rest, r.slots) for r in runs] == [(6, 10, 0, 60), (60, 1, 0, 60)]
    for shards in (1, 7):
        plan = deal("m", runs, shards, 0)
        assert plan["upto"].isna().all()
        assert plan[plan.source == "s"].groupby("block")["copies"].sum().tolist() == [10] * 6
        assert plan[plan.source == "t"].groupby("block")["copies"].sum().tolist() == [1] * 60
        assert plan["shard"].nunique() == shards
    runs, whole = plan_mix(targets, {"s": 3, "t": 605}, None, 10)
    assert whole == 1210 and runs[0].each == 3 and runs[0].slots == 68 and runs[0].rest == 2
    plan = deal("m", runs, 1, 0)
    own = plan[plan.source == "s"]
    assert own[own.upto.isna()]["copies"].sum() == 201 and own[own.upto == 2]["copies"].sum() == 1


def test_many_shards_of_equal_size(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[int(rng.random() < 0.3)], int(rng.integers(5, 40)), 0, 0) for i in range(60_000)]
    targets = spark.createDataFrame([("m", "a", 0.7, 2), ("m", "b", 0.3, 3)], TARGETS)
    mixed = mix_sources(spark.createDataFrame(rows, DOCS), targets, shard_tokens=2_000).cache()
    sizes = np.array([r["tokens"] for r in shard_report(mixed).collect()])
    assert len(sizes) > LEAVES and (np.abs(sizes / sizes.mean() - 1) < 0.1).mean() > 0.99 and 0.9 < sizes.mean() / 2_000 <= 1.0
    shares = np.array([r[1] for r in mixed.groupBy("shard").agg({"source": "count"}).collect()])
    assert shares.min() > 0 and mixed.groupBy("doc_id").sum("copies").where("`sum(copies)` > 3").count() == 0
    per = mixed.where("source = 'b'").groupBy("shard").sum("n_tokens").collect()
    assert np.std([r[1] for r in per]) > 20  # drawn, not dealt evenly


def test_too_many_shards_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a", 2**40, 0, 0)], DOCS)
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    with pytest.raises(ValueError):
        mix_sources(docs, targets, shard_tokens=1000)
