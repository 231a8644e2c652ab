"""Forests, boosted trees and their permutation importance are few jobs, and do not depend on how rows are dealt to tasks."""

import random

import numpy as np
import pytest

from tidemark.operators import learning, trees

NAMES = ["churn", "age", "noise"]
KINDS = ("random_forest", "gradient_boosting")


class Alone:
    rank = 0

    def gather(self, a):
        yield a

    def sum(self, a):
        return a.copy()

    def share(self, what=None):
        return what

    total = sum


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = []
    for i in range(500):
        churn, age = rng.gauss(0, 1), rng.choice([None, float("nan"), float(rng.randrange(40))])
        data.append((i, int(churn + rng.gauss(0, 0.4) > 0.3), churn, age, rng.random()))
    return spark.createDataFrame(data, "row_id bigint, label int, churn double, age double, noise double").cache()


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    got = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("kind", KINDS)
def test_a_model_is_few_jobs_whatever_its_trees(spark, rows, kind):
    _, n = jobs(spark, f"fit {kind}", lambda: learning.Model(kind, NAMES, trees=30).fit(rows))
    assert 0 < n < 10


@pytest.mark.parametrize("kind", KINDS)
def test_models_do_not_depend_on_partitions(rows, kind):
    fits = [learning.Model(kind, NAMES, trees=7).fit(d).model for d in (rows.coalesce(1), rows.repartition(7, "churn"))]
    assert len(fits[0].trees) == 7
    for a, b in zip(fits[0].trees, fits[1].trees):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_thresholds_are_exact_quantiles_or_all_values():
    rng = np.random.default_rng(2)
    columns = [rng.normal(size=1001), rng.integers(-3, 3, 1001).astype(float), np.zeros(1001)]
    many, few, one = trees.thresholds(Alone(), columns)
    assert many.tolist() == np.sort(columns[0])[[-(-k * 1001 // 32) - 1 for k in range(1, 32)]].tolist()
    assert few.tolist() == [-3, -2, -1, 0, 1] and len(one) == 0


@pytest.mark.parametrize("kind", KINDS)
def test_dealt_values_are_scored_as_whole_rows(rows, kind):
    model = learning.Model(kind, NAMES, trees=9).fit(rows).model
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 32, (300, 3)).astype(np.uint8)
    dealt = rng.integers(0, 32, (4, 300)).astype(np.uint8)
    base, got = model.totals_dealt(codes, dealt, [0, 2], 2)
    assert np.array_equal(base, model.totals(codes))
    for place, f in enumerate((0, 0, 2, 2)):
        other = codes.copy()
        other[:, f] = dealt[place]
        assert np.array_equal(got[place], model.totals(other))


def test_average_precision_shares_ties():
    p, label = np.array([0.9, 0.5, 0.5, 0.1]), np.array([1, 0, 1, 0])
    assert trees.average_precision(p, label) == pytest.approx((1 + 2 / 3) / 2)
    assert trees.average_precision(p, np.ones(4)) is None and trees.average_precision(p[:0], label[:0]) is None


@pytest.mark.parametrize("kind", KINDS)
def test_permutation_importance_is_few_jobs(spark, rows, kind):
    model = learning.Model(kind, NAMES, trees=20).fit(rows)
    got, n = jobs(spark, f"permute {kind}", lambda: {r["feature"]: r["loss"] for r in learning.permutation_importance(model, rows).collect()})
    assert got["churn"] > 0.2 > abs(got["age"]) and n < 12


def test_one_class_only(spark):
    df = spark.createDataFrame([(i, 1, float(i)) for i in range(20)], "row_id bigint, label int, churn double")
    for kind in KINDS:
        assert learning.Model(kind, ["churn"], trees=3).fit(df).score(df).where("probability < 0.99").count() == 0


def test_windows_scores_are_few_jobs_and_those_of_their_models(spark, rows, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.operators import prediction

    monkeypatch.setattr(learning, "FEATURES", NAMES)
    d = rows.select("*", F.lit("r").alias("repo"), F.format_string("c%03d", F.floor(F.col("row_id") / 5)).alias("commit_sha"), F.col("row_id").alias("timestamp"))
    windows = prediction.time_windows(d)
    got, n = jobs(spark, "windows", lambda: {(r["fold"], r["model"]): r for r in learning.cross_validate(d, windows, KINDS, trees=12).collect()})
    assert set(got) == {(k, m) for k in (1, 2, 3) for m in KINDS} and n < 100
    both = d.join(windows.where("fold = 2"), ["repo", "commit_sha"]).drop("repo", "commit_sha", "fold")
    for kind in KINDS:
        model = learning.Model(kind, NAMES, trees=12).fit(both.where("part = 'train'"))
        want = learning.metrics(model.score(both.where("part = 'test'")), kind).collect()[0].asDict()
        assert {c: got[2, kind][c] for c in want} == pytest.approx(want)
