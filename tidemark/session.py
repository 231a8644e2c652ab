"""Session helpers: shared folder, lineage cuts and code shipping.

Nothing here keeps state on a single machine: cut tables and the packaged code
go to the folder named in ``spark.checkpoint.dir``, which every executor sees.
"""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def local_session(name: str = "tidemark", cpus: int | None = None, **conf: str) -> SparkSession:
    """A single-machine session as the tests and the bench use it."""
    builder = (
        SparkSession.builder.master(f"local[{cpus or '*'}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus or 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one below the warehouse.

    On a cluster a warehouse on the driver's own disk is no shared folder: then it is an error not to name one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        _, fs = _path(spark, named)
        if not sc.master.startswith("local") and fs.getUri().getScheme() == "file":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _forget() -> None:
    for spark, name in _written:
        try:
            discard(spark, name)
        except Exception:
            pass


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and the table's path."""
    spark = df.sparkSession
    if not _written:
        atexit.register(_forget)
    name = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(name)
    _written.append((spark, name))
    return spark.read.schema(df.schema).parquet(name), name


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: a lost executor costs no recomputation of what led to it."""
    return written(df)[0]


def discard(spark: SparkSession, name: str) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    path, fs = _path(spark, name)
    fs.delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as pack:
        for file in sorted(PACKAGE.rglob("*.py")):
            pack.writestr(zipfile.ZipInfo(str(file.relative_to(PACKAGE.parent))), file.read_bytes())
    blob = buffer.getvalue()
    name = f"{shared_dir(spark)}/{PACKAGE.name}-{hashlib.sha1(blob).hexdigest()[:12]}.zip"
    path, fs = _path(spark, name)
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(blob))
        out.close()
    sc.addPyFile(name if ":" in name.split("/")[0] else path.toUri().getPath())
    _shipped.add(sc.applicationId)


def tasks(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
