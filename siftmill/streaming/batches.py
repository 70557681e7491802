"""Change operators batch by batch, for streams whose keys may be hot.

The processors in ``replay`` keep a key in one task. Here every batch goes
through the batch operators, which split hot keys; between batches only the
last row of every key is carried, as a written table. The batches have to
arrive in order: a row is compared with the rows of its own and earlier
batches. A batch with a row that is older than what its key has had fails.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftmill.operators.changes import ITERATIONS_UNTIL_STABLE, PREVIOUS, numbered_iterations, only_changes, with_attributed_line
from siftmill.operators.keys import null_equal_join
from siftmill.operators.ordered import DEFAULT_CHUNK_ROWS, previous
from siftmill.schemas import ORD
from siftmill.session import shared_folder

_NEW = "__new"

STATE_BUCKETS = 64


def previous_by_batch(
    stream: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    finish: Callable[[DataFrame], DataFrame],
    folder: str,
    checkpoint: str,
    order: str = ORD,
) -> None:
    """Give every row the preceding row of its key, apply ``finish``, write, and stop at the end.

    Output and carried rows are written below the number of the batch, so a
    batch that runs twice overwrites itself.
    """
    def step(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn(_NEW, F.lit(True))
        if number > 0:
            carried = batch.sparkSession.read.parquet(f"{checkpoint}/carried/batch={number - 1}")
            rows = rows.unionByName(carried.withColumn(_NEW, F.lit(False)), allowMissingColumns=True)
        last = F.max_by(F.struct(order, *values), F.col(order)).alias("last")
        before = F.max(F.when(~F.col(_NEW), F.col(order))).alias("__before")
        first = F.min(F.when(F.col(_NEW), F.col(order))).alias("__first")
        named = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
        late = F.raise_error(F.concat(F.lit("a batch came out of order, rows are late for: "), named)).cast("boolean")
        in_order = F.when(F.col("__first") < F.col("__before"), late).otherwise(F.lit(True))
        # written first: a late batch leaves no output behind
        carried = rows.groupBy(*keys).agg(last, before, first).where(in_order).select(*keys, "last.*")
        carried.write.mode("overwrite").parquet(f"{checkpoint}/carried/batch={number}")
        seen = previous(rows, keys, values, PREVIOUS, order)
        finish(seen.where(_NEW).drop(_NEW)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{checkpoint}/offsets")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _written(stream: DataFrame, keys, values, finish, order: str, folder: str | None, checkpoint: str | None) -> DataFrame:
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "changes")
    previous_by_batch(stream, keys, values, finish, folder, checkpoint or shared_folder(spark, "changes-state"), order)
    return spark.read.parquet(folder).drop("batch")


def changed_values_by_batch(
    stream: DataFrame,
    keys: Sequence[str],
    value: str,
    order: str = ORD,
    folder: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Rows in which a key (scope and name) is new or has another value than before."""
    return _written(stream, keys, [value], lambda seen: only_changes(seen, value), order, folder, checkpoint)


def attributed_lines_by_batch(
    stream: DataFrame,
    call: Sequence[str],
    line: str = "LineNo",
    order: str = ORD,
    folder: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Every row with the line of the call's row before."""
    return _written(stream, call, [line], lambda seen: with_attributed_line(seen, line), order, folder, checkpoint)


def until_stable_loops_by_batch(
    stream: DataFrame,
    loop: Sequence[str],
    is_head: str,
    observation: Sequence[str],
    order: str = ORD,
    until_stable: int = ITERATIONS_UNTIL_STABLE,
    folder: str | None = None,
    checkpoint: str | None = None,
    buckets: int = STATE_BUCKETS,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Drop the rows of a loop from the point on where it has become stable; add ``iteration``.

    Iterations are counted at the loop's head; rows before the first head lie
    outside and stay, and so does the head that finds the loop stable.

    Between batches a loop is one row: how many heads it has had, the iteration
    of its last news, its end if it has one, and its last row's order. What it has
    shown before is a table of observations. Both are kept in hash buckets,
    and a batch reads and writes only those of its own loops and observations. Whether a
    loop has become stable is decided on its news alone, one row per
    iteration with any. Rows of a hot loop are numbered in chunks and joined by
    skew-safe joins, so they never meet in one task.
    """
    spark = stream.sparkSession
    folder, checkpoint = folder or shared_folder(spark, "stable"), checkpoint or shared_folder(spark, "stable-state")
    kinds = {f.name: f for f in stream.schema.fields}
    numbers = [T.StructField(name, T.LongType()) for name in ("heads", "news", "end")]
    parts = [T.StructField("batch", T.LongType()), T.StructField("bucket", T.LongType())]
    loops_schema = T.StructType([*[kinds[c] for c in loop], *numbers, T.StructField("at", kinds[order].dataType), *parts])
    seen_schema = T.StructType([*[kinds[c] for c in (*loop, *observation)], *parts])

    def bucket(columns: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(buckets)).alias("bucket")

    def kept(batch: DataFrame, name: str, schema: T.StructType, number: int, columns: Sequence[str]) -> DataFrame:
        """Stored rows of earlier batches in the buckets that this batch has rows for."""
        if number == 0:
            return batch.sparkSession.createDataFrame([], schema)
        own = [row.bucket for row in batch.select(bucket(columns)).distinct().collect()]
        stored = batch.sparkSession.read.schema(schema).parquet(f"{checkpoint}/{name}")
        return stored.where((F.col("batch") < number) & F.col("bucket").isin(own))

    def store(rows: DataFrame, name: str, number: int, columns: Sequence[str]) -> None:
        path = f"{checkpoint}/{name}/batch={number}"
        dealt = rows.withColumn("bucket", bucket(columns)).repartition("bucket")  # a file for each bucket
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            old = kept(batch, "loops", loops_schema, number, loop)
            old = old.groupBy(*loop).agg(F.max_by(F.struct("heads", "news", "end", "at"), "batch").alias("__old"))
            rows = null_equal_join(numbered_iterations(batch, loop, is_head, "iteration", order, chunk_rows), old, loop, "left")
            counted = F.col("iteration") + F.coalesce("__old.heads", F.lit(0))
            rows = rows.withColumn("iteration", F.when(counted >= 0, counted))
            # only what the loop has not shown before is news
            firsts = rows.where(F.col("iteration").isNotNull()).groupBy(*loop, *observation).agg(F.min("iteration").alias("__news"))
            before = kept(batch, "seen", seen_schema, number, [*loop, *observation]).drop("batch", "bucket")
            fresh = null_equal_join(firsts, before, [*loop, *observation], "left_anti")
            fresh = fresh.persist()
            store(fresh.drop("__news"), "seen", number, [*loop, *observation])
            states = _loop_states(batch, old, fresh, loop, is_head, order, until_stable, chunk_rows)
            store(states, "loops", number, loop)
            # the state as it was written decides, so what is written and what is given out agree
            own = spark.read.schema(loops_schema).parquet(f"{checkpoint}/loops").where(F.col("batch") == number)
            ends = own.select(*loop, F.coalesce("end", F.col("news") + until_stable + 1).alias("__end"))
            joined = null_equal_join(rows.drop("__old"), ends, loop, "left")
            stays = F.col("iteration").isNull() | (F.col("iteration") < F.col("__end"))
            stays = stays | ((F.col("iteration") == F.col("__end")) & F.col(is_head))
            joined.where(stays).drop("__end").write.mode("overwrite").parquet(f"{folder}/batch={number}")
            fresh.unpersist()
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{checkpoint}/offsets")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("iteration", T.LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/batch=*")


def _loop_states(
    batch: DataFrame, old: DataFrame, fresh: DataFrame, loop: Sequence[str], is_head: str, order: str, until_stable: int, chunk_rows: int
) -> DataFrame:
    """Loops of a batch after it: heads, news (iteration of the last), end, at."""
    totals = batch.groupBy(*loop).agg(F.sum(F.col(is_head).cast("long")).alias("__heads"), F.min(order).alias("__first"), F.max(order).alias("at"))
    totals = null_equal_join(totals, old, loop, "left")
    named = F.concat_ws(", ", *[F.col(c).cast("string") for c in loop])
    late = F.raise_error(F.concat(F.lit("a batch came out of order, rows are late for: "), named)).cast("boolean")
    totals = totals.where(F.when(F.col("__first") < F.col("__old.at"), late).otherwise(F.lit(True)))
    news = fresh.groupBy(*loop, "__news").agg(F.lit(True).alias(_NEW))
    carried = old.where(F.col("__old.news").isNotNull()).select(*loop, F.col("__old.news").alias("__news"), F.lit(False).alias(_NEW))
    # news within the iteration of the carried ones change nothing
    steps = news.unionByName(carried).groupBy(*loop, "__news").agg(F.min(_NEW).alias(_NEW))
    placed = previous(steps, loop, ["__news"], "__before", "__news", chunk_rows)
    last = F.coalesce(F.col("__before")["__news"], F.lit(-1).cast("long"))
    gap = F.col(_NEW) & (F.col("__news") - last > until_stable)
    found = placed.groupBy(*loop).agg(F.min(F.when(gap, last + until_stable + 1)).alias("__end"), F.max("__news").alias("__last"))
    joined = null_equal_join(totals, found, loop, "left")
    return joined.select(
        *loop,
        (F.coalesce("__old.heads", F.lit(0)) + F.col("__heads")).cast("long").alias("heads"),
        F.coalesce("__last", "__old.news").cast("long").alias("news"),
        F.coalesce("__old.end", "__end").cast("long").alias("end"),
        "at",
    )
