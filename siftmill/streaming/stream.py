"""Observations as a stream: deduplication, incremental compaction, running to the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftmill.operators.reduce import compact
from siftmill.schemas import OBS9, ORD
from siftmill.session import delete_folder, folder_exists, shared_folder


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Files of a folder as a stream; times without zone are taken as UTC times."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(path)
    for field in schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            stream = stream.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return stream


def dedup_stream(
    stream: DataFrame, keys: Sequence[str] = OBS9, event_time: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """First row of every key. With an event time, copies further apart than ``delay`` may both pass.

    Without one the keys are kept for good; their number has to be bounded.
    """
    if event_time is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_to_end(stream: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Process what is there into a Parquet folder and give the written table."""
    spark = stream.sparkSession
    path = path or shared_folder(spark, "stream")
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", shared_folder(spark, "stream-state"))
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def compact_into(
    stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str] = OBS9, order: str = ORD
) -> None:
    """Add what is new in the stream to a compacted summary, then stop.

    Every batch is compacted by itself and written below its own number, so a
    batch that runs twice overwrites itself. ``summary`` merges the parts.
    """
    def write(batch: DataFrame, number: int) -> None:
        compact(batch, keys, order).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def summary(spark: SparkSession, folder: str, keys: Sequence[str] = OBS9, order: str = ORD) -> DataFrame:
    """The compacted summary: input for the reducers like any compacted table."""
    return compact(spark.read.parquet(folder).drop("batch"), keys, order)


def fold_into(
    stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str] = OBS9, order: str = ORD, every: int = 10
) -> None:
    """Like ``compact_into``, but every ``every``-th batch folds the parts into a base.

    A base holds all batches up to its own number, its generation. It counts
    once a row in ``manifest`` names it, which is one file put in place by one
    rename: what stops before that leaves the generation before valid. The base
    and the parts a generation was made from stay until the next one is named, so
    a batch that runs twice finds them, and so does a reader that has just
    looked up the generation.
    """
    def step(batch: DataFrame, number: int) -> None:
        compact(batch, keys, order).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")
        if (number + 1) % every:
            return
        named = generations(batch.sparkSession, folder)
        if number in named:
            return
        before = max((g for g in named if g < number), default=None)
        whole = compact(_pieces(batch.sparkSession, folder, before, number), keys, order)
        whole.write.mode("overwrite").parquet(f"{folder}/base/generation={number}")
        row = batch.sparkSession.range(1).select(F.lit(number).cast("long").alias("generation"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/named={number}")
        _forget_before(batch.sparkSession, folder, [g for g in named if g < number], before)

    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def generations(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the bases that count, in order."""
    if not folder_exists(spark, f"{folder}/manifest"):
        return []
    schema = T.StructType([T.StructField("generation", T.LongType())])
    return sorted(row.generation for row in spark.read.schema(schema).parquet(f"{folder}/manifest/named=*").collect())


def _pieces(spark: SparkSession, folder: str, base: int | None, last: int | None = None) -> DataFrame:
    """Rows of a base and of the parts after it, up to the batch ``last``."""
    parts = spark.read.parquet(f"{folder}/parts")
    if last is not None:
        parts = parts.where(F.col("batch") <= last)
    if base is None:
        return parts.drop("batch")
    rows = parts.where(F.col("batch") > base).drop("batch")
    return rows.unionByName(spark.read.parquet(f"{folder}/base/generation={base}"))


def _forget_before(spark: SparkSession, folder: str, older: list[int], before: int | None) -> None:
    """Remove what only generations older than ``before`` were made from."""
    if before is None:
        return
    for generation in older:
        if generation < before:
            delete_folder(spark, f"{folder}/manifest/named={generation}")
            delete_folder(spark, f"{folder}/base/generation={generation}")
    numbers = [row.batch for row in spark.read.parquet(f"{folder}/parts").select("batch").distinct().collect()]
    for number in numbers:
        if number <= before:
            delete_folder(spark, f"{folder}/parts/batch={number}")


def folded_summary(spark: SparkSession, folder: str, keys: Sequence[str] = OBS9, order: str = ORD) -> DataFrame:
    """The compacted summary of ``fold_into``: its last base and the parts since."""
    named = generations(spark, folder)
    return compact(_pieces(spark, folder, named[-1] if named else None), keys, order)
