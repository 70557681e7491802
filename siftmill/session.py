"""Session settings and the shared folder for written tables."""

from __future__ import annotations

import contextlib
import contextvars
import pathlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution settings the operators count on: rows of a hot key are
# joined back to per-key results with a shuffled join whose skewed partitions
# are split at run time, also when that costs one more shuffle later.
# A task is dealt few bytes, as these are compressed: repetitive rows, sorted and
# grouped, take a hundred times that in memory. A batch for Python is bounded in
# bytes, however long its texts are, as every worker and its executor hold one.
ADAPTIVE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}

CHECKPOINT_SETTING = "spark.checkpoint.dir"

_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch folder", default=None)


def tune(spark: SparkSession) -> SparkSession:
    """Switch on the adaptive settings and pin the time zone of the session."""
    for key, value in ADAPTIVE_SETTINGS.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per Spark context."""
    context = spark.sparkContext
    shipped = getattr(context, "_siftmill_shipped", False)
    if not shipped:
        package = pathlib.Path(__file__).parent
        folder = tempfile.mkdtemp(prefix="siftmill-py-")
        archive = shutil.make_archive(f"{folder}/siftmill", "zip", package.parent, package.name)
        context.addPyFile(archive)
        context._siftmill_shipped = True


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """New sub-folder of the folder that all executors can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where the
    setting is missing and the session is local is a temporary folder used.
    Inside ``scratch`` it lies in the folder that is removed at the end.
    """
    own = _scratch.get()
    if own is not None:
        return f"{own}/{purpose}-{uuid.uuid4().hex}"
    root = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="siftmill-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Everything written inside lies in one folder of its own, which is removed at the end.

    Results have to be used, or saved elsewhere, before that.
    """
    folder = shared_folder(spark, "scratch")
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        delete_folder(spark, folder)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder, in whatever store it lies; one that is not there is no error."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    What is costly, such as parsing, then runs once, and a lost executor does
    not bring it back.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
