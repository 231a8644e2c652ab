"""Results written down: documents, rows and models."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

MOST_KEPT, KEPT_SECONDS = 64, 300


def write_rows(df: DataFrame, path: str) -> int:
    """One JSON object a line, nulls included; the number of rows written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return df.sparkSession.read.text(path).count()


def write_bundle(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """A folder of JSON rows for each table; the rows of each."""
    return {name: write_rows(df, f"{path.rstrip('/')}/{name}") for name, df in tables.items()}


def save_model(model: PipelineModel, features: list[str], path: str) -> None:
    """A model beside the list of the features it was trained on."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(features),)], "features string").write.mode("overwrite").json(f"{path}/features")


def load_model(features: list[str], path: str) -> PipelineModel:
    """The model, unless it was trained on other features."""
    kept = json.loads(SparkSession.active().read.json(f"{path}/features").collect()[0]["features"])
    if kept != features:
        raise ValueError("the model was trained on other features")
    return PipelineModel.load(f"{path}/model")


class Kept:
    """Results persisted for a time, the oldest let go beyond a number."""

    def __init__(self, most: int = MOST_KEPT, seconds: float = KEPT_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.held: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        now = self.clock()
        for k in [k for k, (t, _) in self.held.items() if now - t > self.seconds]:
            self.held.pop(k)[1].unpersist()
        if key not in self.held:
            self.held[key] = (now, make().persist())
            while len(self.held) > self.most:
                self.held.popitem(last=False)[1][1].unpersist()
        return self.held[key][1]
