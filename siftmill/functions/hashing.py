"""Order-free content hash of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_FIELD, _NULL = "\u001f", "\u0000"


def row_hash(columns: Sequence[str], digest: str = "xxhash64") -> Column:
    """Whole number per row. ``md5`` can be computed by other engines as well."""
    if digest == "xxhash64":
        # xxhash64 skips nulls, so their places are hashed as well
        nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
        return F.xxhash64(*columns, nulls).cast("decimal(20,0)")
    if digest == "md5":
        text = F.concat_ws(_FIELD, *[F.coalesce(F.col(c).cast("string"), F.lit(_NULL)) for c in columns])
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    raise ValueError(f"unknown digest {digest}")


def content_hash(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), digest: str = "xxhash64") -> DataFrame:
    """Sum of the row hashes, in total or per group; copies of a row count."""
    return df.groupBy(*by).agg(
        F.sum(row_hash(columns, digest)).cast("decimal(38,0)").alias("content_hash"),
        F.count(F.lit(1)).alias("n_rows"),
    )
