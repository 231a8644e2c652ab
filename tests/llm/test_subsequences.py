import random
import time
from collections import Counter
from itertools import groupby, product

import numpy as np
import pytest

from tidemark.llm.subsequences import PatternTree, count_patterns, frequent_subsequences

ROWS = "repo string, series bigint, t bigint, path string, pattern string"


def holds(events, pattern):
    at = None
    for x in pattern:
        later = [t for t, y in events if y == x and (at is None or t > at)]
        if not later:
            return False
        at = min(later)
    return True


def brute(rows, least, share, shortest, longest, repeats):
    series = {}
    for repo, s, t, p, *_ in rows:
        if None not in (repo, s, t, p):
            series.setdefault(repo, {}).setdefault(s, set()).add((t, p))
    out = {}
    for repo, by in series.items():
        items = sorted({p for e in by.values() for _, p in e})
        for n in range(shortest, longest + 1):
            for pattern in product(items, repeat=n):
                if not repeats and len(set(pattern)) < n:
                    continue
                k = sum(holds(e, pattern) for e in by.values())
                if k >= max(least, 1) and k >= share * len(by) - 1e-9:
                    out[repo, pattern] = (k, len(by))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, ROWS)
    return {(r["repo"], tuple(r["pattern"])): (r["support"], r["n"]) for r in frequent_subsequences(df, "repo", "series", "t", "path", **kw).collect()}


def data(seed, repos=2, series=40, items=6, length=7, times=5):
    rng = random.Random(seed)
    return [(f"r{r}", s, rng.randrange(times), f"p{rng.randrange(items)}", "x") for r in range(repos) for s in range(series) for _ in range(rng.randrange(length))]


@pytest.mark.parametrize("repeats,longest,block", [(False, 3, 4096), (True, 3, 4096), (False, 3, 7), (True, 2, 5)])
def test_like_brute_force(spark, repeats, longest, block):
    rows = data(1) + data(1)[:30]
    got = run(spark, rows, min_count=4, min_share=0.1, shortest=1, longest=longest, repeats=repeats, block_size=block)
    assert got == brute(rows, 4, 0.1, 1, longest, repeats)


@pytest.mark.parametrize("long,least,block", [(4, 12, 4096), (5, 8, 6), (3, 40, 4096), (1, 1, 4096)])
def test_long_sequences(spark, long, least, block):
    rows = data(2)
    got = run(spark, rows, min_count=least, min_share=0.1, shortest=1, longest=3, repeats=False, block_size=block, long=long)
    assert got == brute(rows, least, 0.1, 1, 3, False)


def test_nulls_ties_and_nothing(spark):
    rows = [("r", 1, 5, "a", ""), ("r", 1, 5, "b", ""), ("r", None, 5, "c", ""), (None, 1, 5, "a", ""), ("r", 2, None, "a", ""), ("r", 2, 6, None, ""), ("r", 3, 1, "", ""), ("r", 3, 2, "b" * 50_000, "")]
    got = run(spark, rows, min_count=1, shortest=2, longest=2)
    assert got == {("r", ("", "b" * 50_000)): (1, 2)}
    assert run(spark, rows[:0], min_count=1) == {}


def test_tree_positions():
    tree = PatternTree(np.array([0, 0, 0, 1, 1, 2, 2, 2]), np.array([0, 1, 2, 0, 1, 0, 0, 1]), np.array([0, 1, 2, 0, 1, 0, 1, 2]), 3)
    assert tree.support(tree.first(0)) == 3 and tree.support(tree.below(tree.first(0), 1)) == 2 and tree.support(tree.below(tree.first(0), 2)) == 2
    code = {"a": 0, "b": 1, "c": 2}
    assert count_patterns(tree, code, [["a", "b", "c"], ["b", "c"], ["a", "x"], ["a", "c"]]).tolist() == [1, 2, 0, 2]
    assert Counter(tree.count.tolist())[1] >= 1


@pytest.mark.parametrize("seed", range(5))
def test_tree_is_the_sequences(seed):
    rng = random.Random(seed)
    rows = sorted({(s, rng.randrange(4), rng.randrange(3)) for s in range(30) for _ in range(rng.randrange(1, 6))})
    tree = PatternTree(*(np.array(c) for c in zip(*rows)), 3)
    item = np.empty(len(tree.count), np.int64)
    for i, nodes in enumerate(tree.header):
        item[nodes] = i
    own = Counter(tuple((t, i) for _, t, i in g) for _, g in groupby(rows, key=lambda r: r[0]))
    prefixes = Counter()
    for q, k in own.items():
        for m in range(1, len(q) + 1):
            prefixes[q[:m]] += k
    got, above = Counter(), []
    for node in range(len(tree.count)):
        while above and tree.last[above[-1]] < node:
            above.pop()
        above.append(node)
        got[tuple((int(tree.step[x]), int(item[x])) for x in above)] += int(tree.count[node])
    assert got == prefixes


def test_blocks_by_events(spark):
    rows = data(6)
    got = run(spark, rows, min_count=4, min_share=0.1, shortest=1, longest=3, repeats=False, block_events=40)
    assert got == brute(rows, 4, 0.1, 1, 3, False)


def test_tree_of_many_events_is_quick():
    n, each = 400, 5_000
    rng = np.random.default_rng(0)
    began = time.time()
    tree = PatternTree(np.repeat(np.arange(n), each), np.tile(np.arange(each), n), rng.integers(0, 50, n * each), 50)
    assert time.time() - began < 20 and tree.support(tree.first(7)) == n
