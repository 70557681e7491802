"""Sinks: observation runs, evaluation results, errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftmill.functions.hashing import content_hash
from siftmill.operators.keys import null_equal_join
from siftmill.schemas import OBS9

# Fixed value: the folders below which the rows of a run are kept.
RUN_KEYS = ["project", "test_case", "func_name"]


def write_observations(
    df: DataFrame,
    path: str,
    run: Sequence[str] = RUN_KEYS,
    columns: Sequence[str] = OBS9,
    max_records_per_file: int = 5_000_000,
) -> None:
    """Write rows below one folder per run, the last level being the hash of the run's content.

    Parametrised runs of one function differ in content and so do not overwrite
    each other; writing the same content again replaces it. A large run is
    spread over tasks and files by the rebalance.
    """
    hashes = content_hash(df, columns, run).select(*run, F.col("content_hash").cast("string"))
    partitions = [*run, "content_hash"]
    keyed = null_equal_join(df, hashes, run)
    (
        keyed.hint("rebalance", *[F.col(c) for c in partitions])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*partitions)
        .parquet(path)
    )


def read_observation_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_evaluation(metrics: DataFrame, timings: DataFrame, store: str, name: str = "data") -> None:
    """Write the metric table and the timing table of an evaluation under its name."""
    metrics.write.mode("overwrite").parquet(f"{store.rstrip('/')}/{name}/metrics")
    timings.write.mode("overwrite").parquet(f"{store.rstrip('/')}/{name}/timings")


def read_evaluation(spark: SparkSession, store: str, name: str = "data") -> tuple[DataFrame, DataFrame]:
    folder = f"{store.rstrip('/')}/{name}"
    return spark.read.parquet(f"{folder}/metrics"), spark.read.parquet(f"{folder}/timings")


def write_errors(errors: DataFrame, store: str, name: str = "data") -> None:
    """Write what went wrong next to the data; a run that is repeated replaces its errors."""
    errors.write.mode("overwrite").parquet(f"{store.rstrip('/')}/{name}/errors")
