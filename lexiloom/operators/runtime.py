"""Shared folder, written tables and package shipping for operators that run Python on executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
ROWS_PER_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of few partitions dealt out over the cores, for costly row-wise work; others as they are.

    Small files have one row group, which one task would read and work on alone. Only for
    plans without a shuffle: asking for their partitions runs nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan


def prepare(spark: SparkSession) -> None:
    """Ship this package to Python workers once, and bound the rows of an Arrow batch unless the session did."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package, at = Path(__file__).resolve().parents[1], tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, at, True)
        with zipfile.ZipFile(f"{at}/lexiloom.zip", "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(f"{at}/lexiloom.zip")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) in (0, -1, 10000):
        spark.conf.set(key, str(ROWS_PER_BATCH))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; without that, a temporary one for a local master only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            top = found.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            top = tempfile.mkdtemp(prefix="lexiloom-")
            spark.sparkContext.setCheckpointDir(top)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top.rstrip('/')}/lexiloom/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession):
    """Shuffle files of what is written meanwhile go as soon as it is written, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read again: calls behind it are made once."""
    with brief_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
