"""Queries that did a part of their job: what was missing is there."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tests.compare import FOLDER
from tidemark.operators import learning, prediction
from tidemark.plans import analytics_queries, evaluation_queries
from tidemark.plans.history_queries import World

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@needs_tables
def test_directory_stats_counts_lines(spark):
    stats = analytics_queries.QUERIES["directory_stats"](spark, FOLDER)
    got = {r["repo"]: r["n"] for r in stats.groupBy("repo").agg(F.sum("lines").alias("n")).collect() if r["n"]}
    want = {r["repo"]: r["n"] for r in World(spark, FOLDER).structural.groupBy("repo").agg(F.sum("lines_of_code").alias("n")).collect()}
    assert got == want and sum(got.values()) > 0


def test_compare_trains_200_trees_and_rounds(monkeypatch):
    asked = {}

    class Stop(Exception):
        pass

    def learner(name):
        def make(**options):
            asked[name] = options.get("numTrees", options.get("maxIter"))
            raise Stop

        return make

    class Rows:
        def count(self):
            return 1

        def withColumn(self, *_):
            return self

    for f in ("medians", "impute", "scaling", "scale", "balanced"):
        monkeypatch.setattr(learning, f, lambda *_: Rows())
    monkeypatch.setattr(learning, "cut", lambda x: x)
    monkeypatch.setattr(learning.F, "col", lambda c: learning.F)
    monkeypatch.setattr(learning.F, "cast", lambda c: None, raising=False)
    for name in ("RandomForestClassifier", "GBTClassifier"):
        monkeypatch.setattr(learning, name, learner(name))
    for kind in ("random_forest", "gradient_boosting"):
        with pytest.raises(Stop):
            learning.compare(None, None, (kind,))
    assert asked == {"RandomForestClassifier": 200, "GBTClassifier": 200}


def test_permutation_importance_averages_repeats(spark):
    rng = random.Random(3)
    rows = [(i, int(x + rng.gauss(0, 0.5) > 0), x, None if i % 7 == 0 else rng.random()) for i, x in enumerate(rng.gauss(0, 1) for _ in range(400))]
    df = spark.createDataFrame(rows, "row_id bigint, label int, churn double, noise double").repartition(3)
    model = learning.Model("logistic_regression", ["churn", "noise"]).fit(df)
    loss = lambda **o: {r["feature"]: r["loss"] for r in learning.permutation_importance(model, df, **o).collect()}
    once, five = loss(repeats=1), loss()
    assert set(five) == {"churn", "noise"} and five["churn"] > 0.2 > abs(five["noise"])
    assert once["churn"] != five["churn"] and loss() == pytest.approx(five)


@needs_tables
def test_permutation_importance_has_every_feature_of_every_model(spark, monkeypatch):
    init = learning.Model.__init__
    monkeypatch.setattr(learning.Model, "__init__", lambda self, kind, features=None, trees=3, seed=42: init(self, kind, features, 3, seed))
    got = analytics_queries.QUERIES["permutation_importance"](spark, FOLDER).collect()
    assert {(r["model"], r["feature"]) for r in got} == {(m, f) for m in learning.KINDS for f in prediction.FEATURES} and len(got) == 69


@needs_tables
def test_ripple_examples_of_every_candidate(spark):
    key = lambda q: {(r["repo"], r["source"], r["target"]) for r in q.select("repo", "source", "target").distinct().collect()}
    ranked = analytics_queries.QUERIES["ripple_candidates"](spark, FOLDER).where("rank > 3")
    assert key(evaluation_queries.QUERIES["ripple_examples"](spark, FOLDER)) & key(ranked)


@needs_tables
def test_time_window_scores_has_three_models_in_three_windows(spark, monkeypatch):
    init = learning.Model.__init__
    monkeypatch.setattr(learning.Model, "__init__", lambda self, kind, features=None, trees=3, seed=42: init(self, kind, features, 3, seed))
    got = analytics_queries.QUERIES["time_window_scores"](spark, FOLDER).collect()
    assert sorted((r["fold"], r["model"]) for r in got) == sorted((k, m) for k in (1, 2, 3) for m in learning.KINDS)
