import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.components import commit_links, components, grouped_split, keyed_components, related_commits

COMMITS = "repo string, sha string, message string, author struct<name:string,email:string,date:string>, extra string"
ALIASES = "alias_key string, canonical_key string"
ROWS = "commit_sha string, series_id bigint"


def find(edges, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed,n,m", [(1, 60, 40), (2, 200, 150), (3, 30, 100)])
def test_like_union_find(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == find(edges, {x for e in edges for x in e})


def test_chain_star_loops_and_repeats(spark):
    chain = [(i, i + 1) for i in range(70)]
    star = [(1000, 1000 + i) for i in range(1, 300)] * 2
    loops = [(5000, 5000), (5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*chain, *star, *loops, (None, 7)], "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(71)} == {0} and {got[1000 + i] for i in range(300)} == {1000} and got[5000] == 5000
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keys(spark):
    got = {r["key"]: r["root"] for r in keyed_components(spark.createDataFrame([("x", "y"), ("y", "z"), ("p", "q"), ("p", "p")], "a string, b string")).collect()}
    assert len({got[k] for k in "xyz"}) == 1 and got["p"] == got["q"] != got["x"]


def commit(sha, message="m", name=None, email=None):
    return ("r", sha, message, (name, email, None), "e")


def test_related_commits(spark):
    a, b, c, d, e, f, g = [x * 40 for x in "abcdef1"]
    commits = spark.createDataFrame(
        [
            commit(a, name="Ann", email=" ANN@x "), commit(b, name="other", email="ann@X"), commit(b, name="other", email="ann@X"),
            commit(c, "Revert " + "D" * 12 + " now", email="", name="Bob"), commit(d, None), commit(e, "see " + "a" * 11, name="Eve"),
            commit(f, name=" bob", email=None), commit(g, email="nobody"), ("r", None, None, None, None), ("r", "9" * 40, "", None, "x"),
        ], COMMITS)
    aliases = spark.createDataFrame([("BOB ", "robert"), ("robert", "bobby@y"), ("", "eve"), (None, "ann@x"), ("BOB ", "robert")], ALIASES)
    rows = spark.createDataFrame([(a, 1), (b, None), (c, 2), (d, None), (e, 3), (f, None), (g, 3), (None, 3), ("9" * 40, None), (a, 1)], ROWS)
    got = {r["commit_sha"]: r["root"] for r in related_commits(commits, aliases, rows).collect()}
    groups = {}
    for k, v in got.items():
        groups.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [{a, b}, {c, d, f}, {e, g}, {"9" * 40}]))


def test_no_rows(spark):
    none = lambda s: spark.createDataFrame([], s)
    assert related_commits(none(COMMITS), none(ALIASES), none(ROWS)).count() == 0
    assert commit_links(none(COMMITS), none(ALIASES), none(ROWS)).count() == 0


def test_very_long_message(spark):
    a, b = "ab" * 20, "cd" * 20
    commits = spark.createDataFrame([commit(a, "x" * 200_000 + " " + "0" * 5000 + b[:14], email="p"), commit(b, email="q")], COMMITS)
    got = related_commits(commits, spark.createDataFrame([], ALIASES), spark.createDataFrame([(a, None), (b, None)], ROWS)).collect()
    assert len({r["root"] for r in got}) == 1


def test_split_keeps_groups_and_shares(spark):
    rng = random.Random(5)
    rows = [(i, f"g{min(int(rng.expovariate(0.002)), 3000)}") for i in range(20_000)] + [(100_000 + i, "giant") for i in range(9_000)] + [(200_000, None), (200_001, None)]
    df = spark.createDataFrame(rows, "row_id bigint, g string").withColumn("split", F.lit("clash"))
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    got = {r["row_id"]: r["split"] for r in grouped_split(df, "row_id", "g", shares).collect()}
    assert len(got) == len(rows)
    by = {}
    for i, g in rows:
        by.setdefault(g if g else i, set()).add(got[i])
    assert all(len(v) == 1 for v in by.values())
    for k, v in shares.items():
        assert abs(sum(s == k for s in got.values()) / len(got) - v) < 0.03
    assert grouped_split(df.limit(0), "row_id", "g", shares).count() == 0


def test_split_shares_with_uneven_groups(spark):
    df = spark.range(40_000).selectExpr("id as row_id", "concat('g', cast(pow(id % 5000, 0.62) as bigint) * (1 + id % 3)) as g")
    got = {r["split"]: r["count"] / 40_000 for r in grouped_split(df, "row_id", "g", {"train": 0.7, "validation": 0.15, "test": 0.15}).groupBy("split").count().collect()}
    assert all(abs(got[k] - v) < 0.01 for k, v in {"train": 0.7, "validation": 0.15, "test": 0.15}.items()), got
