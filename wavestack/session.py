"""Spark session with the settings the engine expects."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError


def session(master: str | None = None, name: str = "wavestack", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; further settings by keyword (dots as ``__``)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; on a local master without one, a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="wavestack-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/wavestack/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, on whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_KEPT: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end, once the results that read it are written."""
    _KEPT.append([])
    try:
        yield
    finally:
        for path in _KEPT.pop():
            remove(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has staged and no result reads any more."""
    remove(spark, scratch(spark, "x").rsplit("/", 1)[0])


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new path of ``scratch`` and read again: what several plans read is made once, and lineage ends there."""
    path = scratch(df.sparkSession, name)
    if _KEPT:
        _KEPT[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that functions sent to Python workers find it; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="wavestack-ship-")) / "wavestack.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
