"""Scans: observation files, source files, timing vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siftmill.operators.keys import null_equal_join
from siftmill.schemas import OBSERVATIONS, ORD, SOURCES, TIMINGS, empty
from siftmill.session import written
from siftmill.sources.footers import footer_verdict, footers

FILE_ORDER = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])

TIMING_LENGTH = 4


def _reader(spark: SparkSession, schema: T.StructType | None, glob: str | None, recursive: bool):
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.option("pathGlobFilter", glob) if glob else reader


def with_order(df: DataFrame) -> DataFrame:
    """Add ``_ord``, the struct (file, row): files in path order, rows in file order.

    ``df`` is a Parquet scan with its ``_metadata`` still reachable. The order
    has this one form for any number of files, so scans can be united and
    results of earlier runs merged with later ones.
    """
    # local paths come with one or three slashes
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    return df.select(*df.columns, F.struct(path.alias("file"), F.col("_metadata.row_index").alias("row")).alias(ORD))


def scan_parquet(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = OBSERVATIONS,
    glob: str = "*.parquet",
    recursive: bool = True,
) -> DataFrame:
    """Rows of the Parquet files under a folder, with their order. The schema is given, not inferred."""
    paths = [path] if isinstance(path, str) else list(path)
    if not paths:
        return empty(spark, T.StructType([*schema.fields, T.StructField(ORD, FILE_ORDER)]))
    return with_order(_reader(spark, schema, glob, recursive).parquet(*paths))


def scan_text_rows(
    spark: SparkSession,
    path: str,
    file_format: str,
    schema: T.StructType = OBSERVATIONS,
    glob: str | None = None,
    recursive: bool = True,
    **options: str,
) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON or CSV files and, apart, the records that do not fit the schema."""
    if file_format not in ("json", "csv"):
        raise ValueError(f"json or csv, not {file_format}")
    broken = "_corrupt_record"
    wide = T.StructType([*schema.fields, T.StructField(broken, T.StringType(), True)])
    reader = _reader(spark, wide, glob or f"*.{file_format}", recursive).options(**options)
    reader = reader.option("columnNameOfCorruptRecord", broken).option("mode", "PERMISSIVE")
    # within a split rows are read in order, so the running id orders them
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = reader.format(file_format).load(path).select(*[f.name for f in wide.fields], order.alias(ORD))
    accepted = rows.where(F.col(broken).isNull()).drop(broken)
    # Spark refuses to read the broken records alone: the always true test asks for the other columns
    others = F.pmod(F.xxhash64(*[f.name for f in schema.fields]), F.lit(2)) < 2
    rejected = rows.where(F.col(broken).isNotNull() & others).select(
        F.col(f"{ORD}.file").alias("file"), F.col(broken).alias("record")
    )
    return accepted, rejected


def check_parquet_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType = OBSERVATIONS,
    glob: str = "*.parquet",
    recursive: bool = True,
) -> DataFrame:
    """Table (file, reason): reason is null for files that have the schema's columns and types.

    Footers are read in tasks, by ranges (``sources.footers``). Addresses that
    only Spark's own readers can open go through these, which read whole files
    of 2 GB at most. Only what is wrong with a file's format is a reason; that
    a file cannot be reached is an error.
    """
    ranged = footers(spark, path, schema, glob, recursive)
    if ranged is not None:
        return ranged.select("file", "reason")
    wanted = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    listing = _reader(spark, None, glob, recursive).format("binaryFile").load(path)
    # the last eight bytes of a file are the size of its footer and a mark
    size = F.conv(F.hex(F.reverse(F.substring("content", -8, 4))), 16, 10).cast("long")
    tail = F.when(F.length("content") >= size + 8, F.expr("substring(content, greatest(-length(content), -CAST(conv(hex(reverse(substring(content, -8, 4))), 16, 10) AS INT) - 8))"))
    tails = listing.select("path", F.coalesce(tail, F.expr("substring(content, -8)")).alias("tail"))

    def inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a file that is nothing but its mark and footer has the same schema
            verdicts = [footer_verdict(FileEnds(b"PAR1" + tail), "", wanted) for tail in batch["tail"]]
            yield pd.DataFrame({"file": batch["path"], "reason": [reason for _, reason in verdicts]})

    return tails.mapInPandas(inspect, "file string, reason string")


class FileEnds:
    """Stands for a store that holds one file, given by its bytes."""

    def __init__(self, data: bytes):
        self.data = data

    def open_input_file(self, path: str):
        import pyarrow as pa

        return pa.BufferReader(self.data)


def plain_path(address: Column) -> Column:
    """An address of ``_metadata.file_path`` as it was written: unescaped, local ones with a single slash."""
    unescaped = F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(unescaped, "^file:/+", "file:/")


def scan_checked(
    spark: SparkSession,
    path: str,
    schema: T.StructType = OBSERVATIONS,
    glob: str = "*.parquet",
    recursive: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that have the schema, and the other files with the reason.

    The verdicts are written, so footers are read once. Only the names of
    refused files pass through the driver: they are excluded by their path, a
    test that Spark applies to its listing, so these files are never opened. The
    listing is taken before the check, so every file of it has a verdict. No file
    fits: an empty typed table.
    """
    rows = _reader(spark, schema, glob, recursive).parquet(path)
    checked = written(check_parquet_files(spark, path, schema, glob, recursive), "checked-files")
    refused = checked.where(F.col("reason").isNotNull())
    if checked.where(F.col("reason").isNull()).isEmpty():
        return scan_parquet(spark, [], schema, glob, recursive), refused
    names = [row.file for row in refused.select(plain_name(F.col("file")).alias("file")).collect()]
    if names:
        rows = rows.where(~plain_path(F.col("_metadata.file_path")).isin(names))
    return with_order(rows), refused


def plain_name(file: Column) -> Column:
    return F.regexp_replace(file, "^file:/+", "file:/")


def scan_timings(spark: SparkSession, path: str, recursive: bool = False, glob: str = "*.parquet") -> DataFrame:
    """Timing vectors of the right length. Nothing found: no rows."""
    return valid_timings(_reader(spark, TIMINGS, glob, recursive).parquet(path))


def valid_timings(timings: DataFrame) -> DataFrame:
    return timings.where(F.size("times") == TIMING_LENGTH)


def scan_sources(
    spark: SparkSession,
    root: str,
    folder: str | None = None,
    files: Sequence[str] | None = None,
    recursive: bool = True,
    glob: str = "*.py",
    project: str | None = None,
) -> DataFrame:
    """Source table (project, path, content); paths are relative to ``root``.

    Reads a folder, the root by default, or single files given relative to the
    root. A file that does not lie under the root is an error.
    """
    if files is not None:
        paths = [name if name.startswith("/") or ":" in name else f"{root.rstrip('/')}/{name}" for name in files]
        if not paths:
            return empty(spark, SOURCES)
    else:
        paths = [folder or root]
    scan = _reader(spark, None, glob, recursive).text(paths, wholetext=True)
    full = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    prefix = root.removeprefix("file://").rstrip("/") + "/"
    outside = F.raise_error(F.concat(full, F.lit(f" is not under {root}"))).cast("string")
    relative = F.when(full.startswith(prefix), F.substr(full, F.lit(len(prefix) + 1))).otherwise(outside)
    return scan.select(F.lit(project).cast("string").alias("project"), relative.alias("path"), F.col("value").alias("content"))


def digests(sources: DataFrame) -> DataFrame:
    """Files of a source table with the SHA-256 of their content instead of it: project, path, digest."""
    return sources.select("project", "path", F.sha2("content", 256).alias("digest"))


def changed_digests(original: DataFrame, other: DataFrame, strict: bool = True) -> DataFrame:
    """Files in both of two tables of digests that differ: project, path, digest, other_digest.

    A file of ``original`` that is missing on the other side is an error, or is
    left out when not ``strict``. Null and the empty name are different projects.
    """
    renamed = other.withColumnRenamed("digest", "other_digest")
    joined = null_equal_join(original, renamed, ["project", "path"], "left" if strict else "inner")
    other_digest = F.col("other_digest")
    if strict:
        missing = F.raise_error(F.concat(F.lit("file is missing in the other tree: "), F.col("path"))).cast("string")
        other_digest = F.coalesce(other_digest, missing)
    return joined.where(F.col("digest") != other_digest).select("project", "path", "digest", "other_digest")


def changed_files(original: DataFrame, other: DataFrame, strict: bool = True) -> DataFrame:
    """Files of two source tables that exist in both with different content: project, path.

    See ``changed_digests``; only digests are shuffled, never contents.
    """
    return changed_digests(digests(original), digests(other), strict).select("project", "path")
