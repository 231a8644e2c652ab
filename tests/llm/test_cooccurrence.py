import math
import os
import random
import subprocess
import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import cooccurrence as module
from tidemark.llm.cooccurrence import cooccurrence

ROWS = "repo string, sha string, path string, n bigint, scope string"


def brute(rows, least, lift):
    baskets = {}
    for repo, sha, path, *_ in rows:
        if None not in (repo, sha, path):
            baskets.setdefault((repo, sha), set()).add(path)
    out = {}
    for repo in {r for r, _ in baskets}:
        own = [b for (r, _), b in baskets.items() if r == repo]
        n = len(own)
        for a, b in combinations(sorted({x for y in own for x in y}), 2):
            na, nb, nab = (sum(x <= y for y in own) for x in ({a}, {b}, {a, b}))
            if nab and nab >= least and nab * n >= lift * na * nb:
                g = 0.0
                for k, r, c in ((nab, na, nb), (na - nab, na, n - nb), (nb - nab, n - na, nb), (n - na - nb + nab, n - na, n - nb)):
                    g += k * math.log(k * n / (r * c)) if k else 0.0
                out[repo, a, b] = (n, na, nb, nab, round(nab * n / (na * nb), 9), round(2 * g, 6))
    return out


def run(spark, rows, **kw):
    got = cooccurrence(spark.createDataFrame(rows, ROWS), "repo", "sha", "path", **kw).collect()
    return {(r["repo"], r["item_a"], r["item_b"]): (r["n"], r["n_a"], r["n_b"], r["n_ab"], round(r["lift"], 9), r["llr"]) for r in got}


def data(seed):
    rng = random.Random(seed)
    return [(f"r{r}", f"c{c}", f"é{rng.randrange(9)}" if rng.random() < 0.3 else f"p{min(int(rng.expovariate(0.4)), 9)}", 1, "s") for r in range(2) for c in range(80) for _ in range(rng.randrange(1, 6))]


@pytest.mark.parametrize("least,lift", [(1, 0.0), (4, 0.0), (3, 1.5), (8, 4.0)])
def test_like_brute_force(spark, least, lift):
    rows = data(7) + data(7)[:40]
    got, want = run(spark, rows, min_count=least, min_lift=lift), brute(rows, least, lift)
    assert {k: v[:5] for k, v in got.items()} == {k: v[:5] for k, v in want.items()}
    assert all(abs(got[k][5] - want[k][5]) < 2e-6 for k in want)


@pytest.mark.parametrize("least,chunk", [(1, 3), (2, 3), (5, 2), (9, 4), (60, 2)])
def test_baskets_of_many_chunks(spark, least, chunk):
    rows = data(9)
    got, want = run(spark, rows, min_count=least, chunk=chunk), brute(rows, least, 0.0)
    assert {k: v[:5] for k, v in got.items()} == {k: v[:5] for k, v in want.items()}


def test_significance(spark):
    rows = data(7)
    every = brute(rows, 1, 0.0)
    got = run(spark, rows, min_llr=module.SIGNIFICANT)
    assert set(got) == {k for k, v in every.items() if v[5] >= module.SIGNIFICANT} and 0 < len(got) < len(every)


def units(rows):
    return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in rows], pa.string()), pa.array([i for _, i, _ in rows], pa.list_(pa.string())), pa.array([o for _, _, o in rows], pa.list_(pa.string()))], names=["scope", "items", "others"])


def summed(batches):
    total = {}
    for out in module._stripes(iter(batches)):
        for row in out.to_pylist():
            for other, n in zip(row["neighbours"], row["counts"]):
                total[row["scope"], row["item"], other] = total.get((row["scope"], row["item"], other), 0) + n
    return total


@pytest.mark.parametrize("pairs,places", [(1, 1), (3, 5), (10**6, 10**6)])
def test_stripes_of_any_cut(monkeypatch, pairs, places):
    monkeypatch.setattr(module, "PAIRS_HELD", pairs)
    monkeypatch.setattr(module, "PLACES_HELD", places)
    batches = [units([("r", ["c", "a", "b"], []), ("r", ["a", "b"], [])]), units([("s", ["a", "b"], []), ("r", ["c", "d"], ["a", "é"]), ("r", ["x"], [])]), units([])]
    assert summed(batches) == {
        ("r", "a", "b"): 2, ("r", "a", "c"): 2, ("r", "b", "c"): 1, ("s", "a", "b"): 1, ("r", "a", "d"): 1, ("r", "c", "é"): 1, ("r", "d", "é"): 1}


def test_many_scopes_and_items_are_told_apart():
    n = 1_400_000
    both = pa.array([f"i{k}" for k in range(2 * n)])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2, dtype=np.int32)), both)
    none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(n)]), lists, none], names=["scope", "items", "others"])
    seen = np.zeros(n, bool)
    for out in module._stripes(iter([batch])):
        scope, left = (out.column(i).cast(pa.string()).to_pylist() for i in (0, 1))
        right, count = out.column(3).flatten().to_pylist(), out.column(4).flatten().to_pylist()
        assert len(right) == len(left) and set(count) == {1}
        for s, a, b in zip(scope, left, right):
            assert {int(a[1:]), int(b[1:])} == {2 * int(s), 2 * int(s) + 1}
            seen[int(s)] = True
    assert seen.all()


PEAK = """
import numpy as np, pyarrow as pa, resource, sys
from tidemark.llm import cooccurrence as module
rng = np.random.default_rng(0)
words = pa.array([f"src/module_{i:05}.py" for i in range(20_000)])
start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = int(sys.argv[1])
picks = np.concatenate([rng.choice(20_000, 2_000, replace=False) for _ in range(n)])
lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2_000 * n + 1, 2_000, dtype=np.int32)), words.take(pa.array(picks)))
none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
batch = pa.RecordBatch.from_arrays([pa.array(["r"] * n), lists, none], names=["scope", "items", "others"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
total = sum(int(np.sum(out.column(4).flatten().to_numpy())) for out in module._stripes(iter([batch])))
assert total == n * 1_999_000, total
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_memory_of_large_baskets():
    at = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    few, many = (int(subprocess.run([sys.executable, "-c", PEAK, str(n)], cwd=at, capture_output=True, text=True, check=True).stdout) for n in (8, 32))
    assert many < 1000 and many < few + 200


def test_nulls_large_basket_and_nothing(spark):
    rows = [("r", "c", f"{i:04}", 1, "") for i in range(300)] + [("r", "d", "0001", 1, ""), ("r", None, "x", 1, ""), (None, "c", "x", 1, ""), ("r", "c", None, 1, ""), ("r", "c", "", 1, "")]
    got = run(spark, rows)
    assert len(got) == 301 * 300 // 2 and got["r", "", "0001"][:4] == (2, 1, 2, 1)
    assert run(spark, rows[:0]) == {}
