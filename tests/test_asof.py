import random

import numpy as np
import pytest

from tidemark.operators.asof import PersistentTree, _in_blocks, known_at_event, latest_known

FACTS = "fact_id bigint, e string, f string, valid bigint, known bigint, v bigint, w bigint, row_id bigint"
EVENTS = "row_id bigint, e string, f string, t bigint, v bigint"


def brute(facts, events):
    out = {}
    for i, e, f, t, *_ in events:
        best = None
        for k, fe, ff, valid, known, v, w, *_ in facts:
            if None in (e, f, t, valid, known) or (fe, ff) != (e, f) or not (valid < t and known < t):
                continue
            key = (valid, known, -(2**63) if k is None else k)
            if best is None or key > best[0]:
                best = (key, v, w)
        out[i] = (best[1], best[2], True) if best else (0, 0, False)
    return out


def run(spark, facts, events, **kw):
    got = known_at_event(spark.createDataFrame(events, EVENTS), spark.createDataFrame(facts, FACTS), ["e", "f"], "row_id", "t", "valid", "known", "fact_id", ["v", "w"], default=0, **kw)
    return {r["row_id"]: (r["known_v"], r["known_w"], r["is_known"]) for r in got.collect()}


def data(seed, n_facts, n_events, entities):
    rng = random.Random(seed)
    entity = lambda: (f"e{min(int(rng.expovariate(0.5)), entities)}", "f\x1f" if rng.random() < 0.2 else "f")
    facts = [(i, *entity(), rng.randrange(60), rng.randrange(60), rng.choice([None, rng.randrange(9)]), rng.randrange(9), 0) for i in range(n_facts)]
    events = [(i, *entity(), rng.randrange(65), 0) for i in range(n_events)]
    return facts, events


@pytest.mark.parametrize("block_rows,batch_rows", [(200_000, 400_000), (10, 7), (40, 30)])
def test_like_brute_force(spark, block_rows, batch_rows):
    facts, events = data(1, 300, 400, 6)
    assert run(spark, facts, events, block_rows=block_rows, batch_rows=batch_rows) == brute(facts, events)


@pytest.mark.parametrize("block_rows", [3, 50])
def test_one_entity_holds_nearly_all_and_one_time_most_of_it(spark, block_rows):
    rng = random.Random(5)
    time = lambda: 30 if rng.random() < 0.7 else rng.choice([29, 31, rng.randrange(60)])
    facts = [(i, "hot" if rng.random() < 0.95 else "e1", "f", time(), time(), rng.randrange(9), i, 0) for i in range(250)]
    events = [(i, "hot", "f", time(), 0) for i in range(250)] + [(900, "e1", "f", 31, 0)]
    assert run(spark, facts, events, block_rows=block_rows) == brute(facts, events)


def test_blocks_are_bounded(spark):
    rows = spark.range(30_000).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('e', id % 977) end as _e0", "id % 2 = 0 as _fact", "case when id % 7 < 4 then 1000 else cast(pow(id % 1013, 3) as bigint) end as _at", "id as _tie").selectExpr("*", "_at as _valid", "_at as _known")
    sizes = _in_blocks(rows, ["_e0"], [], [], 500).groupBy("_e0", "_lo", "_sub").count().collect()
    assert max(r["count"] for r in sizes) < 700 and sum(r["_e0"] == "hot" for r in sizes) > 20


def test_nulls_ties_and_repeats(spark):
    facts = [(1, "a", "b", 5, 5, 1, 1, 0), (2, "a", "b", 5, 5, 2, 2, 0), (2, "a", "b", 5, 5, 2, 2, 0), (None, "a", "b", 5, 6, 3, None, 0), (4, None, "b", 1, 1, 9, 9, 0), (5, "a", "b", None, 1, 9, 9, 0), (6, "a", "b", 9, 1, 7, 7, 0)]
    events = [(1, "a", "b", 6, 0), (2, "a", "b", 7, 0), (3, "a", "b", 5, 0), (4, None, "b", 9, 0), (5, "a", None, 9, 0), (6, "a", "b", None, 0), (7, "a", "b", 9, 0), (8, "a", "b", 10, 0), (9, "x" * 50_000, "", 10, 0)]
    got = run(spark, facts, events)
    assert got == {**brute(facts, events), 2: (3, None, True)} and got[1] == (2, 2, True) and got[8] == (7, 7, True) and got[9] == (0, 0, False)


def test_nothing(spark):
    facts, events = data(2, 5, 5, 2)
    assert run(spark, facts, events[:0]) == {}
    assert run(spark, facts[:0], events) == {i: (0, 0, False) for i, *_ in events}


def test_carried_columns_and_no_default(spark):
    got = known_at_event(
        spark.createDataFrame([(1, "a", "b", 9, 42)], EVENTS), spark.createDataFrame([(1, "x", "b", 1, 1, 1, 1, 0)], FACTS), ["e", "f"], "row_id", "t", "valid", "known", "fact_id", ["v"], carry=["v"])
    assert [tuple(r) for r in got.collect()] == [(1, 42, None, False)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 33])
def test_every_version_of_a_tree(n):
    order = np.random.default_rng(n).permutation(n)
    tree = PersistentTree(order)
    for version in range(n + 1):
        held = sorted(order[:version].tolist())
        v = np.full(n + 1, version)
        assert tree.count_below(v, np.arange(n + 1)).tolist() == [sum(x < b for x in held) for b in range(n + 1)]
        if held:
            assert tree.select(np.full(len(held), version), np.arange(len(held))).tolist() == held


def test_latest_known_without_facts():
    none = np.zeros(0, np.int64)
    assert latest_known(none, none, none, none, np.array([0]), np.array([5])).tolist() == [-1]
