"""Hand-made histories with the values they must have."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths, text
from tidemark.operators import dependencies as dep
from tidemark.operators import features, impact, prediction, ripple, rollups, scoring, structure
from tidemark.operators import history as h
from tidemark.sources.history import changes, commit_files, latest_commits

SCHEMA = "repo string, sha string, message string, author struct<name:string,email:string,date:string>, timestamp bigint, date string, url string, stats struct<additions:bigint,deletions:bigint,total:bigint>, files array<struct<filename:string,additions:bigint,deletions:bigint,changes:bigint,status:string>>, fetched_at timestamp"
EDGES = "repo string, source string, target string"


def commit(sha, ts, files, message="m", who="ann"):
    return ("r", sha, message, (who, None, None), ts, None, None, (len(files), 0, len(files)), [(f, 1, 1, 2, "modified") for f in files], None)


def world(spark, *commits):
    c = latest_commits(spark.createDataFrame(list(commits), SCHEMA))
    return c, changes(c), commit_files(c)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_cochange_is_symmetric(spark):
    _, ch, _ = world(spark, commit("1", 1, ["a", "b"]), commit("2", 2, ["b", "a"]), commit("3", 3, ["c", "d"]), commit("3", 3, ["c", "d"]))
    assert rows(h.cochange(ch), "file_a", "file_b", "count") == [("a", "b", 2), ("c", "d", 1)]


def test_a_file_twice_pairs_with_itself(spark):
    _, ch, _ = world(spark, commit("1", 1, ["k", "k"]))
    assert rows(h.cochange(ch), "file_a", "file_b", "count") == [("k", "k", 1)]


def test_temporal_window_is_inclusive(spark):
    _, _, cf = world(spark, commit("1", 100, ["a"]), commit("2", 100 + h.WEEK, ["b"]), commit("3", 101 + h.WEEK, ["c"]), commit("4", None, ["a"]), commit("5", 100, ["z", "target/x"]))
    assert rows(h.temporal_pairs(cf), "source", "target", "occurrences", "avg_delay_seconds") == [("a", "b", 1, h.WEEK), ("a", "z", 1, 0), ("b", "c", 1, 1), ("z", "b", 1, h.WEEK)]


def test_propagation_adds_signals(spark):
    _, ch, cf = world(spark, commit("1", 1, ["a", "b"]), commit("2", 5, ["b"]))
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "a", "b"), ("r", "a", "a"), ("r", "a", "$x")], EDGES)
    got = rows(h.propagation(h.cochange(ch), h.temporal_pairs(cf), edges), "source", "target", "dependency", "temporal", "cochange", "strength")
    assert got == [("a", "b", True, True, True, 4)]


def test_sequences(spark):
    _, _, cf = world(spark, commit("1", 1, ["a"]), commit("2", 2, ["b"]), commit("3", 3, ["c"]), commit("4", 3 + 9 * h.WEEK, ["d"]))
    got = {tuple(r["files"]): (r["occurrences"], r["avg_delay_seconds"]) for r in h.sequences(cf).collect()}
    assert got == {("a", "b"): (1, 1), ("b", "c"): (1, 1), ("a", "b", "c"): (1, 2)}


def test_followups_and_rework(spark):
    _, ch, cf = world(
        spark, commit("1", 10, ["a"]), commit("2", 20, ["a"], "Fixes #42"), commit("3", 30, ["b"], 'Revert "x"'), commit("4", 40, ["e"], "add prefix handling"), commit("5", 50, ["f"]), commit("6", 50 + h.TWO_WEEKS, ["f"], "Revert all"))
    edges = spark.createDataFrame([("r", "b", "e")], EDGES)
    f = {(r["source_sha"], r["followup_sha"]): (r["reason"], r["evidence_type"]) for r in h.followups(cf, h.cochange(ch), edges).collect()}
    assert f[("1", "2")] == ("same-file-fix", "observed") and f[("1", "3")] == ("fix-message", "derived") and f[("3", "4")] == ("dependency", "derived") and ("4", "5") not in f
    r = rows(h.rework(cf, h.cochange(ch), edges), "file", "initial_sha", "rework_sha", "rule")
    assert r == [("a", "1", "2", "fix-message"), ("f", "5", "6", "revert")]


def test_messages(spark):
    df = spark.createDataFrame([("add prefix handling",), ("Fixes #42",), ('Revert "x"',), ("  reverting",), (None,), ("",)], "m string")
    assert [tuple(r) for r in df.select(text.is_fix(F.col("m")), text.is_revert(F.col("m"))).collect()] == [(False, False), (True, False), (True, True), (True, True), (False, False), (False, False)]


def test_paths(spark):
    p = F.col("p")
    df = spark.createDataFrame([("a/Node_Modules/x.js",), ("src/{old => new}/a.rs",), ("a.rs => b/c.rs",), ('"q.py"',), ("Makefile",), ("tests/test_a.py",)], "p string")
    got = [tuple(r) for r in df.select(paths.is_ignored(p), paths.renamed(p), paths.extension(p), paths.kind(p)).collect()]
    assert [g[0] for g in got] == [True] + [False] * 5
    assert [g[1] for g in got][1:4] == ["src/new/a.rs", "b/c.rs", "q.py"] and got[4][2] == "" and got[5][3] == "test"


def test_line_count(spark):
    df = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\n\n",), ("\n",)], "t string")
    assert [r[0] for r in df.select(text.line_count(F.col("t"))).collect()] == [0, 1, 1, 2, 1]


def test_upper_median(spark):
    df = spark.createDataFrame([([1, 2, 3, 10],), ([5],), ([],), ([3, 1],)], "v array<int>")
    assert [r[0] for r in df.select(text.upper_median(F.col("v"))).collect()] == [3, 5, None, 3]


def test_prefix_features_see_earlier_times_only(spark):
    _, ch, _ = world(spark, commit("1", 100, ["a", "b"], who="x"), commit("2", 100, ["a"], who="y"), commit("3", 200, ["a", "a"], who="x"), commit("4", 400, ["a"], who="z"), commit("5", None, ["a"]))
    got = {(r["path"], r["ts"]): r for r in features.prefix(ch, window=150).collect()}
    assert got["a", 100]["previous_change_count"] == 0 and got["a", 100]["time_since_last_change_secs"] is None
    assert got["a", 200]["previous_change_count"] == 2 and got["a", 200]["contributor_count"] == 2 and got["a", 200]["historical_cochange_frequency"] == 1 and got["a", 200]["recent_change_frequency"] == pytest.approx(2 / 150)
    assert got["a", 400]["previous_change_count"] == 4 and got["a", 400]["historical_cochange_frequency"] == 3 and got["a", 400]["recent_change_frequency"] == 0.0 and got["a", 400]["time_since_last_change_secs"] == 200


def test_dataset(spark):
    _, ch, _ = world(spark, commit("c1", 100, ["a"]), commit("c2", 200, ["a", "b"]), commit("c3", 300, ["b"]))
    got = rows(features.dataset(ch, ch.select("repo", "path")), "sha", "path", "label", "previous_change_count")
    assert got == [("c1", "a", 1, 0), ("c2", "a", 1, 1), ("c2", "b", 1, 0), ("c3", "a", 0, 2), ("c3", "b", 1, 1)]


def test_percentiles(spark):
    df = spark.createDataFrame([("r", str(i), float(v)) for i, v in enumerate([1, 2, 3, 10])] + [("s", "x", 4.0), ("s", "y", 4.0)], "repo string, path string, v double")
    got = {(r["repo"], r["path"]): r["p"] for r in scoring.percentile(df, "v", "p").collect()}
    assert got["r", "3"] == 100.0 and got["r", "0"] == 0.0 and got["s", "x"] == 0.0


def test_dependencies(spark):
    files = [("a/x.js", 'import { b } from "./y";\nimport "z";\nconst q = require(\'./w\');\n'), ("a/y.ts", 'export { c } from "../nope";'), ("a/w.js", ""), ("m.rs", "use crate::n::o;\nmod p;\nextern crate q;\n"), ("p.py", "import os\nfrom .a import b  # x\n")]
    s = spark.createDataFrame([("r", p, c, i, None) for i, (p, c) in enumerate(files)], "repo string, path string, content string, file_id bigint, fetched_at timestamp")
    got = rows(dep.edges(dep.latest_sources(s), s), "source", "target")
    assert got == [("a/x.js", "$z"), ("a/x.js", "a/w.js"), ("a/x.js", "a/y.ts"), ("a/y.ts", "$../nope"), ("m.rs", "$crate::n::o"), ("m.rs", "$extern crate q"), ("m.rs", "$p"), ("p.py", "$from .a import b"), ("p.py", "$import os")]
    m = {r["path"]: (r["outgoing"], r["incoming"], r["coupling"]) for r in dep.metrics(spark.createDataFrame([("r", "a", "b"), ("r", "a", "b"), ("r", "b", "b"), ("r", "c", "b")], EDGES)).collect()}
    assert m == {"a": (1, 0, 1), "b": (0, 2, 2), "c": (1, 0, 1)}


def test_complexity():
    assert structure.complexity_of("def f(x):\n    if x:\n        return 1\n    elif x > 2:\n        return 2\n    for i in x:\n        pass\n", "Python")[:2] == (4, 1)
    assert structure.complexity_of("fn f(x: u8) -> u8 { if x > 1 { match x { 1 => 2, _ => 3 } } else { 0 } } // if\n", "Rust")[:2] == (3, 1)
    assert structure.complexity_of('function f(a) { const s = "if"; return a ? 1 : 2; }\nconst g = (x) => { while (x) { x--; } };', "JavaScript")[:2] == (3, 2)
    assert structure.complexity_of("def f(:", "Python") is None and structure.complexity_of("", "Rust") == (1, 0, 0)


def test_ripple(spark):
    c, ch, cf = world(spark, commit("1", 1, ["a", "b"]), commit("2", 2, ["a"]), commit("3", 3, ["a"]))
    edges = spark.createDataFrame([], EDGES)
    got = {(r["source"], r["target"]): r for r in ripple.edges(cf, ch, h.cochange(ch), edges).collect()}
    assert got["a", "b"]["cochange_probability"] == pytest.approx(1 / 3) and got["b", "a"]["follow_count"] == 2
    walk = ripple.paths(spark.createDataFrame([("r", "a", "b", 0.9), ("r", "b", "a", 0.8), ("r", "b", "c", 0.5), ("r", "c", "a", 0.9)], "repo string, source string, target string, combined_score double"), spark.createDataFrame([("r", "a")], "repo string, path string"))
    assert [(r["nodes"], r["confidence"]) for r in walk.collect()] == [(["a", "b", "c"], pytest.approx(0.7))]
    assert ripple.weights_without("cochange")["temporal"] == pytest.approx(0.5) and ripple.weights_without(weights=dict.fromkeys(ripple.WEIGHTS, 0.0))["cochange"] == 1.0


def test_intent(spark):
    df = spark.createDataFrame([("Replace JWT authentication with OAuth2",), ("address the docs",), (None,)], "m string")
    a, b, c = impact.intent(df, "m").collect()
    assert (a["operation"], a["current_technology"], a["target_technology"]) == ("replace", "jwt", "oauth2") and "authentication" in a["domains"] and b["operation"] == "add" and c["operation"] == "general"


def test_score_of_one_vector(spark):
    values = {c: 0.0 for c in prediction.FEATURES}
    df = spark.createDataFrame([tuple(prediction.MODEL["median"])], ", ".join(f"{c} double" for c in prediction.FEATURES))
    z = prediction.INTERCEPT + sum((m - a) / s * c for m, a, s, c in zip(prediction.MODEL["median"], prediction.MODEL["mean"], prediction.MODEL["scale"], prediction.MODEL["coefficient"]))
    import math

    got = prediction.score(df).collect()[0]["probability"]
    empty = prediction.score(df.select(*[F.lit(None).cast("double").alias(c) for c in values])).collect()[0]["probability"]
    assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12) and empty == got


def test_areas(spark):
    df = spark.createDataFrame([("g", 1, 0.9), ("g", 0, 0.8), ("g", 1, 0.8), ("g", 0, 0.1), ("h", 1, 0.5)], "g string, label int, probability double")
    got = {r["g"]: r for r in prediction.ranking(df, ["g"]).collect()}
    assert got["g"]["roc_auc"] == pytest.approx(0.875) and got["g"]["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3) and got["h"]["roc_auc"] is None


def test_split_of_ten_commits(spark):
    df = spark.createDataFrame([("r", f"c{i}", i) for i in range(10)] + [("s", "x", 1), ("s", "y", 2)], "repo string, commit_sha string, timestamp bigint")
    n = {(r["repo"], r["split"]): r["count"] for r in prediction.chronological_split(df).groupBy("repo", "split").count().collect()}
    assert n == {("r", "train"): 7, ("r", "validation"): 1, ("r", "test"): 2, ("s", "train"): 2}
    n = {r["split"]: r["count"] for r in prediction.chronological_split(df.where("repo = 'r'").limit(4), at_least_one=True).groupBy("split").count().collect()}
    assert min(n.values()) >= 1 and len(n) == 3


def test_neighbourhood(spark):
    e = spark.createDataFrame([("r", "a", "b", 5), ("r", "a", "c", 9), ("r", "c", "d", 1), ("r", "e", "f", 1)], "repo string, source string, target string, strength bigint")
    focus = spark.createDataFrame([("r", "a")], "repo string, path string")
    assert rows(rollups.neighbourhood(e, focus, 2), "node", "hop") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(rollups.neighbourhood(e, focus, 2, 2), "node", "hop") == [("a", 0), ("c", 1)]


def test_published_probability(spark):
    # One vector and its published probability.
    raw = [8224.0, 259.0, 18.0, 9.0, 5.0, 0.0, 3.0, 3.0, 0.0, 3.0, 210.0, 1.0, 13.0, 0.0000011574074074074074, 77.0, 3.0, 74.0, 2.0, 458827.0, 7.0, 35.0, 7.0, 3.0]
    df = spark.createDataFrame([tuple(raw)], ", ".join(f"{c} double" for c in prediction.FEATURES))
    assert prediction.score(df).collect()[0]["probability"] == pytest.approx(0.03526788170277072, abs=1e-9)
