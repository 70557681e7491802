"""Order-dependent operators that do not need a whole group in one task.

A plain window sorts all rows of a key in one task, which a key holding a third
of the table does not survive. Here the order column is cut into chunks of
bounded length. The window runs per (key, chunk); what has to cross a chunk
border is one small row per (key, chunk), combined before the shuffle, carried
forward by a second window over those rows and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from siftmill.schemas import ORD

DEFAULT_CHUNK_ROWS = 1_000_000

_KEY = "__key"
# sorting by a number first is much faster than by a struct
_HASH = "__hash"


def order_chunk(df: DataFrame, order: str = ORD, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> Column:
    """Chunk of a row, growing with ``order``; a chunk spans ``chunk_rows`` orders.

    The order column is a whole number (an id, a row index) or a struct ending
    in one, such as (file, row index).
    """
    dtype = df.schema[order].dataType
    if isinstance(dtype, T.IntegralType):
        return F.expr(f"`{order}` div {int(chunk_rows)}")
    if isinstance(dtype, T.StructType) and isinstance(dtype.fields[-1].dataType, T.IntegralType):
        leading = [F.col(order)[f.name].alias(f.name) for f in dtype.fields[:-1]]
        last = F.expr(f"`{order}`.`{dtype.fields[-1].name}` div {int(chunk_rows)}")
        return F.struct(*leading, last.alias("part"))
    raise TypeError(f"{order} must be a whole number or a struct ending in one, not {dtype.simpleString()}")


def _chunked(df: DataFrame, keys: Sequence[str], order: str, chunk_rows: int) -> DataFrame:
    """Move the key columns into one struct, together with the row's chunk.

    Windows, aggregates and the join below all use this column and its hash as
    key, so the rows are shuffled once, and without a second copy of their key.
    Structs with equal nulls are equal.
    """
    chunk = order_chunk(df, order, chunk_rows).alias("chunk")
    packed = F.struct(F.struct(F.lit(0).alias("any"), *keys).alias("key"), chunk).alias(_KEY)
    rest = [c for c in df.columns if c not in keys or c == order]
    return df.select(packed, *rest).withColumn(_HASH, F.xxhash64(_KEY))


def _restored(df: DataFrame, columns: Sequence[str], keys: Sequence[str], out: str, value: Column) -> DataFrame:
    """The columns as they were before ``_chunked``, and the result."""
    here = set(df.columns)
    kept = [F.col(c) if c in here else F.col(_KEY)["key"][c].alias(c) for c in columns if c != out]
    return df.select(*kept, value.alias(out))


def _over_chunks() -> WindowSpec:
    return Window.partitionBy(F.col(_KEY)["key"]).orderBy(F.col(_KEY)["chunk"])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    out: str,
    order: str = ORD,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Sum of ``value`` over the rows of the same key up to this one."""
    chunked = _chunked(df.withColumn("__value", value.cast("long")), keys, order, chunk_rows)
    within = Window.partitionBy(_HASH, _KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = _over_chunks().rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(_HASH, _KEY)
        .agg(F.sum("__value").alias("__sum"))
        .withColumn("__offset", F.sum("__sum").over(earlier))
        .where(F.col("__offset") != 0)
        .drop("__sum")
    )
    local = chunked.withColumn(out, F.sum("__value").over(within)).drop("__value")
    total = F.col(out) + F.coalesce(F.col("__offset"), F.lit(0))
    return _restored(local.join(offsets, [_HASH, _KEY], "left"), df.columns, keys, out, total)


def occurrence_number(
    df: DataFrame,
    keys: Sequence[str],
    out: str = "_occurrence",
    order: str = ORD,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Number the rows of equal keys 0, 1, 2, … in order."""
    return running_sum(df, keys, F.lit(1), out, order, chunk_rows).withColumn(out, F.col(out) - 1)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    out: str,
    order: str = ORD,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Add struct ``out`` with ``values`` of the preceding row of the same key.

    The struct is null for the first row of a key, so that a missing row and a
    preceding null value stay apart.
    """
    chunked = _chunked(df, keys, order, chunk_rows)
    packed = F.struct(*[F.col(v).alias(v) for v in values])
    tails = chunked.groupBy(_HASH, _KEY).agg(F.max_by(packed, F.col(order)).alias("__tail"))
    carried = (
        tails.withColumn("__carried", F.lag("__tail").over(_over_chunks()))
        .where(F.col("__carried").isNotNull())
        .drop("__tail")
    )
    local = chunked.withColumn(out, F.lag(packed).over(Window.partitionBy(_HASH, _KEY).orderBy(order)))
    before = F.coalesce(F.col(out), F.col("__carried"))
    return _restored(local.join(carried, [_HASH, _KEY], "left"), df.columns, keys, out, before)
