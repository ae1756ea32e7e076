"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet and reading it back, so a lost executor costs only the tasks it ran.
The folder is the cluster's ``spark.checkpoint.dir``; only a local session without that setting gets
a temporary folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_sent: set[str] = set()


def send_code(spark: SparkSession) -> None:
    """Let Spark bring this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)


def folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-folioflow-")
    return "file://" + _own[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{folder(spark)}/folioflow/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table."""
    return _written(df, fresh(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    send_code(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Room:
    """Staged tables of one piece of work, deleted together when nothing reads them any more.

    What the work returns must be staged outside the room, or be in memory, when the room is left.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh(self.spark, name)
        self.paths.append(path)
        return _written(df, path)

    def clear(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []

    def __enter__(self) -> Room:
        return self

    def __exit__(self, *_) -> None:
        self.clear()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark writes to."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what is written already; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    send_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
