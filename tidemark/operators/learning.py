"""Training and comparing models on rows with the 23 features, chronologically."""

from __future__ import annotations

from itertools import chain

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prediction import FEATURES, HISTORICAL, STRUCTURAL, TEMPORAL, confusion, ranking
from tidemark.operators.trees import GBTClassifier, RandomForestClassifier, average_precision, filled, in_tasks, scored
from tidemark.session import cut, discard, ship, written

KINDS = ("logistic_regression", "random_forest", "gradient_boosting")
GROUPS = {
    "all": FEATURES, "structural": STRUCTURAL, "historical": HISTORICAL, "temporal": TEMPORAL,
    "without_structural": HISTORICAL + TEMPORAL, "without_historical": STRUCTURAL + TEMPORAL, "without_temporal": STRUCTURAL + HISTORICAL,
}


def medians(train: DataFrame, features: list[str] = FEATURES) -> dict[str, float]:
    """Exact medians; 0 where a column has no value."""
    row = train.agg(*[F.expr(f"percentile({c}, 0.5)").alias(c) for c in features]).collect()[0]
    return {c: float(row[c]) if row[c] is not None else 0.0 for c in features}


def impute(rows: DataFrame, fill: dict[str, float]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def scaling(train: DataFrame, features: list[str] = FEATURES) -> dict[str, tuple[float, float]]:
    """Mean and population deviation; a deviation of 0 becomes 1."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).collect()[0]
    return {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0) or 1.0) for c in features}


def scale(rows: DataFrame, by: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in by.items()})


def balanced(rows: DataFrame) -> DataFrame:
    """Add weight: rows / (2 rows of the class)."""
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(n.values())
    return rows.withColumn("weight", F.when(F.col("label") == 1, total / (2.0 * n.get(1, 1) or 1)).otherwise(total / (2.0 * n.get(0, 1) or 1)))


class Model:
    """A model with the imputation and scaling it was trained with."""

    def __init__(self, kind: str, features: list[str] | None = None, trees: int = 200, seed: int = 42):
        self.kind, self.features, self.trees, self.seed = kind, features or FEATURES, trees, seed

    def fit(self, train: DataFrame, fill: dict[str, float] | None = None) -> "Model":
        """Train; ``fill`` are the medians of train, where they are known."""
        self.fill = fill or medians(train, self.features)
        if self.kind == "logistic_regression":
            filled = impute(train, self.fill)
            self.by = scaling(filled, self.features)
            data = balanced(scale(filled, self.by)).withColumn("label", F.col("label").cast("double"))
            n = data.count()
            learner = LogisticRegression(weightCol="weight", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-6)
            self.model = learner.fit(VectorAssembler(inputCols=self.features, outputCol="features").transform(data))
        else:
            learner = RandomForestClassifier(numTrees=self.trees, maxDepth=10, seed=self.seed) if self.kind == "random_forest" else GBTClassifier(maxIter=self.trees, seed=self.seed)
            self.model = learner.fit(train, self.features, self.fill)
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        """Add probability and predicted to rows, which keep their raw features."""
        keep = [c for c in rows.columns if c not in self.features]
        if self.kind == "logistic_regression":
            x = export(self)
            z = F.lit(x["intercept"])
            for c, m, mean, sd, k in zip(x["features"], x["median"], x["mean"], x["scale"], x["coefficient"]):
                z = z + (F.coalesce(F.col(c), F.lit(m)) - mean) / sd * k
            out = rows.select(*keep, *self.features, (1.0 / (1.0 + F.exp(-z))).alias("probability"))
        else:
            out = scored(self.model, rows, self.features, self.fill).select(*keep, *self.features, "probability")
        return out.withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))

    def importance(self) -> list[tuple[str, float]]:
        """(feature, weight), heaviest first: absolute coefficients or impurity."""
        values = self.model.coefficients.toArray() if self.kind == "logistic_regression" else self.model.featureImportances
        return sorted(((f, abs(float(v))) for f, v in zip(self.features, values)), key=lambda x: (-x[1], x[0]))


def metrics(scored: DataFrame, name: str) -> DataFrame:
    """One row of precision, recall, F1 (0 without a denominator) and the exact areas (null for one class)."""
    return metrics_by(scored.withColumn("model", F.lit(name)), ["model"])


def metrics_by(scored: DataFrame, by: list[str]) -> DataFrame:
    """The metrics of each group of scores, all groups together."""
    c, r = confusion(scored, by), ranking(scored, by)
    return c.join(r, by).select(*by, *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("precision", "recall", "f1")], "roc_auc", "average_precision", "brier", "tp", "fp", "tn", "fn")


def _scores(train: DataFrame, test: DataFrame, kinds: tuple[str, ...], trees: int) -> DataFrame:
    """(model, label, probability, predicted) of the rows of test by each kind of model trained on train."""
    out, fill = None, medians(train, FEATURES)
    for kind in kinds:
        one = cut(Model(kind, trees=trees).fit(train, fill).score(test).select(F.lit(kind).alias("model"), "label", "probability", "predicted"))
        out = one if out is None else out.unionByName(one)
    return out


def compare(train: DataFrame, test: DataFrame, kinds: tuple[str, ...] = KINDS, trees: int = 200) -> DataFrame:
    """The metrics of each kind of model, of as many trees or rounds, trained on train and tested on test."""
    return metrics_by(_scores(cut(train), cut(test), kinds, trees), ["model"])


def ablation(train: DataFrame, test: DataFrame) -> DataFrame:
    """The metrics of logistic regression on seven choices of feature groups."""
    out = None
    for name, features in GROUPS.items():
        m = metrics(Model("logistic_regression", features).fit(train).score(test), name)
        out = m if out is None else out.unionByName(m)
    return out


def calibrate(scored: DataFrame) -> tuple[float, float]:
    """Slope and intercept of a sigmoid over the log odds of held-out scores."""
    data = _odds(scored).select("_odds", F.col("label").cast("double").alias("label"))
    model = LogisticRegression(regParam=0.0, maxIter=100).fit(VectorAssembler(inputCols=["_odds"], outputCol="features").transform(data))
    return float(model.coefficients[0]), float(model.intercept)


def _odds(scored: DataFrame) -> DataFrame:
    p = F.least(F.greatest(F.col("probability"), F.lit(1e-9)), F.lit(1 - 1e-9))
    return scored.withColumn("_odds", F.ln(p / (1 - p)))


def calibrated(sigmoid: tuple[float, float], scored: DataFrame) -> DataFrame:
    p = 1.0 / (1.0 + F.exp(-(F.col("_odds") * sigmoid[0] + sigmoid[1])))
    return _odds(scored).withColumn("probability", p).withColumn("predicted", (F.col("probability") >= 0.5).cast("int")).drop("_odds")


PERMUTATION_REPEATS, BLOCK_ROWS = 5, 50_000
#: Rows that go to a task together.
PIECE_ROWS = 1000


def _dealt(model: Model, names: list[str], repeats: int, seed: int):
    """A function from a block's rows to pieces (labels, values, dealt) of them, in the order of row_id.

    Each name's values are dealt out anew as many times as asked. Trees get the bins of
    the rows and of the dealt values, a logistic regression is applied at once.
    """
    import numpy as np
    import pyarrow as pa

    features, fill, grown = model.features, model.fill, None if model.kind == "logistic_regression" else model.model
    linear = export(model) if grown is None else None

    def deal(table):
        table = table.sort_by("row_id")
        block, n = table.column("_b")[0].as_py(), len(table)
        columns = filled([table], features, fill)
        orders = lambda k: (np.random.default_rng([seed, block, k, r]).permutation(n) for r in range(repeats))
        if grown is None:
            terms = [(c - m) / sd * k for c, m, sd, k in zip(columns, linear["mean"], linear["scale"], linear["coefficient"])]

            def probability(moved=None, order=None):
                z = np.full(n, linear["intercept"])
                for c, x in zip(features, terms):
                    z = z + (x[order] if c == moved else x)
                return 1.0 / (1.0 + np.exp(-z))

            values = probability()[:, None]
            dealt = np.array([probability(c, o) for k, c in enumerate(names) for o in orders(k)]).T
        else:
            values = grown.bins(columns).T
            dealt = np.array([values[o, features.index(c)] for k, c in enumerate(names) for o in orders(k)]).T
        labels = table.column("label").to_numpy().astype(np.uint8)
        pieces = [slice(i, i + PIECE_ROWS) for i in range(0, n, PIECE_ROWS)]
        return pa.table({name: pa.array([np.ascontiguousarray(x[p]).tobytes() for p in pieces], pa.binary()) for name, x in (("labels", labels), ("values", values), ("dealt", dealt))})

    return deal


def permutation_importance(model: Model, test: DataFrame, features: list[str] | None = None, seed: int = 42, repeats: int = PERMUTATION_REPEATS) -> DataFrame:
    """(feature, loss): how much average precision falls when a feature's values are dealt out anew, on average over seeded repeats.

    Values move within blocks of about 50,000 rows of like hash (all rows where there are
    fewer), so no sort of all rows is needed. All features and repeats are scored in one job, whose
    first task ranks the scores of one of them at a time.
    """
    import numpy as np
    import pyarrow as pa

    names, spark = features or model.features, test.sparkSession
    rows = test.select("row_id", "label", *model.features)
    blocks = -(-test.count() // BLOCK_ROWS) or 1
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(blocks)))
    ship(spark)
    pieces = rows.groupBy("_b").applyInArrow(_dealt(model, names, repeats, seed), "labels binary, values binary, dealt binary")
    grown, width, cells = None if model.kind == "logistic_regression" else model.model, len(model.features), len(names) * repeats
    places = [model.features.index(c) for c in names]

    def rank(tasks, batches):
        read = lambda name, kind, w: np.concatenate([np.empty((0, w), kind), *[np.frombuffer(x, kind).reshape(-1, w) for b in batches for x in b.column(name).to_pylist()]])
        label = read("labels", np.uint8, 1)[:, 0]
        if grown is None:
            base, dealt = read("values", np.float64, 1)[:, 0], np.ascontiguousarray(read("dealt", np.float64, cells).T)
        else:
            base, dealt = grown.totals_dealt(read("values", np.uint8, width), np.ascontiguousarray(read("dealt", np.uint8, cells).T), places, repeats)
            base, dealt = grown.probability(base), (grown.probability(x) for x in dealt)
        labels, found = np.concatenate([np.empty(0, np.uint8), *tasks.gather(label)]), []
        for scores in chain([base], dealt):
            every = list(tasks.gather(scores))
            if tasks.rank == 0:
                found.append(average_precision(np.concatenate(every), labels))
        if tasks.rank == 0:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, cells), pa.int32()), pa.array(found, pa.float64())], ["g", "ap"])

    ap = {r["g"]: r["ap"] or 0.0 for r in in_tasks(pieces, rank, "g int, ap double").collect()}
    losses = [(c, float(ap[-1] - sum(ap[k * repeats + r] for r in range(repeats)) / repeats)) for k, c in enumerate(names)]
    return spark.createDataFrame(losses, "feature string, loss double")


def export(model: Model) -> dict[str, object]:
    """A fitted logistic regression as plain numbers, in the order of its features, as ``prediction.score`` takes them."""
    means, scales = zip(*(model.by[c] for c in model.features))
    return {
        "features": model.features, "median": [model.fill[c] for c in model.features], "mean": list(means), "scale": list(scales),
        "coefficient": [float(x) for x in model.model.coefficients], "intercept": float(model.model.intercept),
    }


def cross_validate(rows: DataFrame, windows: DataFrame, kinds: tuple[str, ...] = KINDS, trees: int = 200) -> DataFrame:
    """The metrics of each kind of model on each chronological window (repo, fold, commit_sha, part); folds of all repositories together.

    A window's rows are written once and deleted when its models are done; the scores of all models are ranked together.
    """
    windows = cut(windows)
    both, out = rows.join(windows, ["repo", "commit_sha"]), None
    for fold in [r["fold"] for r in windows.select("fold").distinct().orderBy("fold").collect()]:
        own, name = written(both.where(F.col("fold") == fold).drop("repo", "commit_sha", "file_path", "fold"))
        one = _scores(own.where("part = 'train'"), own.where("part = 'test'"), kinds, trees).withColumn("fold", F.lit(fold))
        discard(rows.sparkSession, name)
        out = one if out is None else out.unionByName(one)
    m = metrics_by(out, ["model", "fold"])
    return m.select(*[c for c in m.columns if c != "fold"], "fold")
