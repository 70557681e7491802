"""Matching two tables of hints one to one, and scores on the matches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftmill.operators.filters import has_original, map_filenames
from siftmill.operators.keys import null_equal_join
from siftmill.operators.ordered import DEFAULT_CHUNK_ROWS, occurrence_number
from siftmill.schemas import HINT6, METRICS, ORD

_OCC = "__occurrence"
_OCC2 = "__occurrence2"
_AT = "__at"
_HASH = "__hash"
_BUCKET = "__bucket"

HEAT_BUCKETS = 1 << 14
HEAT_FACTOR = 4  # a hot bucket has more than so many times the average
HOT_ROWS = 2_000_000


def _of_side(side: str, value: Column) -> Column:
    return F.max(F.when(F.col("side") == side, value))


def match_exact(
    original: DataFrame,
    generated: DataFrame,
    keys: Sequence[str] = HINT6,
    label: str = "Type",
    order: str = ORD,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Pair equal rows one to one; unpaired rows of both sides stay.

    The n-th copy of a row on one side meets the n-th copy on the other. Row
    and number together are unique per side, so copies never multiply and a
    row with many copies spreads over all tasks. The join is a grouping of both
    sides' rows. ``side`` tells: ``both``, ``original`` or ``generated``.
    """
    return _exact_pairs(_tagged(original, generated, keys, label, order), keys, label, chunk_rows)


def _tagged(original: DataFrame, generated: DataFrame, keys: Sequence[str], label: str, order: str) -> DataFrame:
    """Rows of both sides with ``__at``, their order, and ``side``."""
    sides = [
        df.select(*keys, label, F.col(order).alias(_AT), F.lit(side).alias("side"))
        for side, df in (("original", original), ("generated", generated))
    ]
    return sides[0].unionByName(sides[1])


def _exact_pairs(rows: DataFrame, keys: Sequence[str], label: str, chunk_rows: int) -> DataFrame:
    numbered = occurrence_number(rows, [*keys, label, "side"], _OCC, _AT, chunk_rows)
    paired = numbered.groupBy(*keys, label, _OCC).agg(
        _of_side("original", F.col(_AT)).alias("_ord_original"),
        _of_side("generated", F.col(_AT)).alias("_ord_generated"),
    )
    side = (
        F.when(F.col("_ord_original").isNull(), "generated")
        .when(F.col("_ord_generated").isNull(), "original")
        .otherwise("both")
    )
    return paired.withColumn("side", side)


def match_by_key(
    rows: DataFrame,
    keys: Sequence[str] = HINT6,
    label: str = "Type",
    nested_occurrence: bool = False,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Pair what ``match_exact`` left over by key alone, the n-th with the n-th."""
    single = rows.withColumn(_AT, F.coalesce("_ord_original", "_ord_generated"))
    if nested_occurrence:
        numbered = occurrence_number(single, [*keys, "side", _OCC], _OCC2, _AT, chunk_rows)
        sides = [
            numbered.where(F.col("side") == side).select(
                *keys, _OCC2, F.col(label).alias(name), F.col(_AT).alias(f"_ord_{side}")
            )
            for side, name in (("original", "OriginalType"), ("generated", "GeneratedType"))
        ]
        return null_equal_join(*sides, [*keys, _OCC2], "full_outer").drop(_OCC2)
    numbered = occurrence_number(single, [*keys, "side"], _OCC2, _AT, chunk_rows)
    hint = F.struct(F.col(_AT).alias("at"), F.col(label).alias("label"))
    paired = numbered.groupBy(*keys, _OCC2).agg(
        _of_side("original", hint).alias("__original"), _of_side("generated", hint).alias("__generated")
    )
    return paired.select(
        *keys,
        F.col("__original.label").alias("OriginalType"),
        F.col("__generated.label").alias("GeneratedType"),
        F.col("__original.at").alias("_ord_original"),
        F.col("__generated.at").alias("_ord_generated"),
    )


def match_hints(
    original: DataFrame,
    generated: DataFrame,
    filenames: DataFrame | Mapping[str, str] | None = None,
    keys: Sequence[str] = HINT6,
    label: str = "Type",
    order: str = ORD,
    file: str = "Filename",
    null_types: str = "match",
    nested_occurrence: bool = False,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Metric rows: every original and generated hint, matched one to one.

    Rows equal in key and type are paired first and score true twice. What is
    left is paired by key alone, in order: complete if there is a generated
    type, never correct. Without an original type both scores are null.

    ``null_types="ignore"`` leaves the scores of pairs without any type null.
    ``nested_occurrence`` numbers leftovers within their first number, which
    lets one row meet several.

    Rows are dealt out by key once, and both numberings and both pairings work
    on what a task has got. Keys with so many rows that a task should not have
    them all (``hot_rows``, beside a multiple of what keys have on average) are
    told by a count of rows per hash bucket, and are numbered in chunks.
    """
    if null_types not in ("match", "ignore"):
        raise ValueError(f"null_types must be match or ignore, not {null_types}")
    if filenames is not None:
        generated = map_filenames(generated, filenames, file)
    rows = _tagged(original, generated, keys, label, order)
    if nested_occurrence:
        pairs = _pairs_in_chunks(rows, keys, label, True, chunk_rows)
    else:
        cold, hot = split_by_heat(rows, keys, hot_rows)
        pairs = _pairs_by_key(cold, keys, label).unionByName(_pairs_in_chunks(hot, keys, label, False, chunk_rows))
    comparable = F.lit(True) if null_types == "match" else F.when(F.col("OriginalType").isNotNull(), F.lit(True))
    has_type, exact = F.col("OriginalType").isNotNull(), F.col("__exact")
    return pairs.select(
        *keys,
        "OriginalType",
        "GeneratedType",
        F.when(exact, comparable).when(has_type, F.col("GeneratedType").isNotNull()).alias("Completeness"),
        F.when(exact, comparable).when(has_type, F.lit(False)).alias("Correctness"),
        "_ord_original",
        "_ord_generated",
    )


def split_by_heat(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows of keys that one task may have all rows of, and the rows of the others.

    Counted are hash buckets of keys, so what is broadcast is bounded: a
    quarter of ``HEAT_BUCKETS`` numbers at most, as each hot bucket has several times the average.
    """
    bucketed = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(HEAT_BUCKETS)))
    counts = bucketed.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    average = F.sum("__n").over(Window.partitionBy()) / HEAT_BUCKETS
    hot = counts.withColumn("__average", average).where(F.col("__n") > hot_rows + HEAT_FACTOR * F.col("__average")).select(_BUCKET)
    cold = bucketed.join(F.broadcast(hot), _BUCKET, "left_anti")
    return cold.drop(_BUCKET), bucketed.join(F.broadcast(hot), _BUCKET, "left_semi").drop(_BUCKET)


def _pairs_by_key(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Both pairings within the tasks that hold the rows of a key: one shuffle by the key's hash."""
    dealt = rows.withColumn(_HASH, F.xxhash64(*keys)).repartition(_HASH)
    copies = Window.partitionBy(_HASH, *keys, label, "side").orderBy(_AT)
    met = (
        dealt.withColumn(_OCC, F.row_number().over(copies))
        .groupBy(_HASH, *keys, label, _OCC)
        .agg(_of_side("original", F.col(_AT)).alias("__original"), _of_side("generated", F.col(_AT)).alias("__generated"))
        .withColumn("__exact", F.col("__original").isNotNull() & F.col("__generated").isNotNull())
    )
    # what is left is numbered per key and side; exact pairs keep their own number and label
    rest = Window.partitionBy(_HASH, *keys, "__exact", F.col("__original").isNull()).orderBy(F.coalesce("__original", "__generated"))
    placed = met.withColumn(_OCC2, F.when(~F.col("__exact"), F.row_number().over(rest)))
    own = F.struct(F.when(F.col("__exact"), F.col(label)).alias("label"), F.when(F.col("__exact"), F.col(_OCC)).alias("n"), _OCC2)
    sides = [
        F.max(F.when(F.col(at).isNotNull(), F.struct(F.col(at).alias("at"), F.col(label).alias("label")))).alias(at)
        for at in ("__original", "__generated")
    ]
    return (
        placed.groupBy(_HASH, *keys, "__exact", own.alias("__own"))
        .agg(*sides)
        .select(
            *keys,
            F.col("__original.label").alias("OriginalType"),
            F.col("__generated.label").alias("GeneratedType"),
            F.col("__original.at").alias("_ord_original"),
            F.col("__generated.at").alias("_ord_generated"),
            "__exact",
        )
    )


def _pairs_in_chunks(rows: DataFrame, keys: Sequence[str], label: str, nested_occurrence: bool, chunk_rows: int) -> DataFrame:
    """Both pairings with numbers given in chunks of the order: no key meets in one task."""
    paired = _exact_pairs(rows, keys, label, chunk_rows)
    both = paired.where(F.col("side") == "both").select(
        *keys,
        F.col(label).alias("OriginalType"),
        F.col(label).alias("GeneratedType"),
        "_ord_original",
        "_ord_generated",
        F.lit(True).alias("__exact"),
    )
    rest = match_by_key(paired.where(F.col("side") != "both"), keys, label, nested_occurrence, chunk_rows)
    return both.unionByName(rest.withColumn("__exact", F.lit(False)))


def in_report_order(metrics: DataFrame) -> DataFrame:
    """Metric rows by original row, then generated row, rows without one last."""
    return metrics.orderBy(F.col("_ord_original").asc_nulls_last(), F.col("_ord_generated").asc_nulls_last())


def metrics_table(metrics: DataFrame) -> DataFrame:
    return metrics.select(*[f.name for f in METRICS.fields])


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def total_scores(metrics: DataFrame) -> DataFrame:
    """One row: total completeness and correctness, zero where nothing can be scored."""
    complete = F.count_if(F.col("Completeness"))
    return metrics.agg(
        _share(complete, F.count("Completeness")).alias("completeness"),
        _share(F.count_if(F.col("Correctness")), complete).alias("correctness"),
    )


def status_counts(metrics: DataFrame) -> DataFrame:
    """One row: how many hints there are on each side and how many met."""
    counts = metrics.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("Completeness").alias("n_original"),
        F.count_if(F.col("Completeness")).alias("n_matched"),
    )
    counts = counts.withColumn("n_only_original", F.col("n_original") - F.col("n_matched"))
    counts = counts.withColumn("n_only_generated", F.col("n_rows") - F.col("n_original"))
    counts = counts.withColumn("n_generated", F.col("n_matched") + F.col("n_only_generated"))
    for name in ("matched", "only_original", "only_generated"):
        counts = counts.withColumn(f"share_{name}", _share(F.col(f"n_{name}"), F.col("n_rows")))
    return counts


def file_rates(metrics: DataFrame, file: str | Sequence[str] = "Filename") -> DataFrame:
    """Completeness and correctness rate of every file that has original hints."""
    complete = F.count_if(F.col("Completeness"))
    return has_original(metrics).groupBy(*([file] if isinstance(file, str) else file)).agg(
        _share(complete, F.count("Completeness")).alias("completeness_rate"),
        _share(F.count_if(F.col("Correctness")), complete).alias("correctness_rate"),
    )


def top_files(rates: DataFrame, rate: str, lowest: bool = True, k: int = 5, file: str = "Filename") -> DataFrame:
    """The ``k`` files with the lowest or highest rate, ties by file name."""
    by = F.col(rate).asc() if lowest else F.col(rate).desc()
    return rates.orderBy(by, F.col(file).asc()).limit(k)
