import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import learning, prediction

NAMES = ["churn", "age", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(600):
        churn, age = rng.gauss(0, 1), rng.choice([None, rng.gauss(5, 2)])
        data.append((i, "r", f"c{i // 4:03}", i // 4, int(churn + rng.gauss(0, 0.5) > 0.4), churn, age, rng.random()))
    return spark.createDataFrame(data, "row_id bigint, repo string, commit_sha string, timestamp bigint, label int, churn double, age double, noise double").cache()


def test_medians_and_scaling(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (3.0, None, 2.0), (None, None, 2.0)], "churn double, age double, noise double")
    fill = learning.medians(df, NAMES)
    assert fill == {"churn": 2.0, "age": 0.0, "noise": 2.0}
    by = learning.scaling(learning.impute(df, fill), NAMES)
    assert by["churn"] == (2.0, pytest.approx((2 / 3) ** 0.5)) and by["noise"] == (2.0, 1.0)


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest", "gradient_boosting"])
def test_held_out_accuracy(rows, kind):
    split = prediction.chronological_split(rows)
    both = rows.join(split, ["repo", "commit_sha"])
    model = learning.Model(kind, NAMES, trees=10).fit(both.where("split = 'train'"))
    m = learning.metrics(model.score(both.where("split = 'test'")), kind).collect()[0]
    assert m["roc_auc"] > 0.85 and m["f1"] > 0.6 and model.importance()[0][0] == "churn"


def test_export_gives_the_same_scores(rows):
    model = learning.Model("logistic_regression", NAMES).fit(rows)
    x = learning.export(model)
    z = F.lit(x["intercept"])
    for c, m, a, s, k in zip(x["features"], x["median"], x["mean"], x["scale"], x["coefficient"]):
        z = z + (F.coalesce(F.col(c), F.lit(m)) - a) / s * k
    worst = model.score(rows).select("row_id", "probability").join(rows.select("row_id", (1 / (1 + F.exp(-z))).alias("p")), "row_id").agg(F.max(F.abs(F.col("p") - F.col("probability")))).collect()[0][0]
    assert worst < 1e-9


def test_calibration_and_permutation(rows):
    model = learning.Model("logistic_regression", NAMES).fit(rows.where("row_id < 300"))
    raw = model.score(rows.where("row_id >= 300"))
    better = learning.calibrated(learning.calibrate(raw), raw)
    brier = lambda d: learning.metrics(d, "m").collect()[0]["brier"]
    assert brier(better) <= brier(raw) + 1e-6
    loss = {r["feature"]: r["loss"] for r in learning.permutation_importance(model, rows, ["churn", "noise"]).collect()}
    assert loss["churn"] > 0.2 > abs(loss["noise"])


def test_windows_expand(rows):
    n = {(r["fold"], r["part"]): r["count"] for r in prediction.time_windows(rows, 2).groupBy("fold", "part").count().collect()}
    assert n == {(1, "train"): 50, (1, "test"): 50, (2, "train"): 100, (2, "test"): 50}
