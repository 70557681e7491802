"""Reducers and filters that bring the observations of a site down to one answer.

All of them combine before they shuffle, so the number of rows of a site does
not matter, only the number of different ones. Frames with a ``_n`` column are
compacted: distinct rows with their multiplicity. ``compact`` makes them, and
every operator here but the union with repeated members accepts them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siftmill.operators.keys import null_equal_join
from siftmill.operators.ordered import order_chunk
from siftmill.schemas import ORD, SITE7, TYPE2, WEIGHT

# Defaults of the filters and modules whose types are never
# offered as a common base.
MIN_THRESHOLD = 0.25
MIN_AMOUNT_TYPES_TO_DROP = 2
IGNORED_BASE_MODULES = ["abc"]

UNION_CHUNK_ROWS = 100_000
EXPAND_COPIES = 10_000
BASE_SALTS = 64
MAX_MEMBERS = 1_000_000  # of one site in one cell: some 50 MB


def compact(df: DataFrame, keys: Sequence[str] = (*SITE7, *TYPE2), order: str = ORD) -> DataFrame:
    """Distinct rows with multiplicity and smallest order.

    The result is mergeable: compacting a union of compacted parts gives the
    same as compacting the whole.
    """
    weight = F.sum(WEIGHT) if WEIGHT in df.columns else F.count(F.lit(1))
    return df.groupBy(*keys).agg(weight.alias(WEIGHT), F.min(order).alias(order))


def expand(df: DataFrame, copies_per_row: int = EXPAND_COPIES) -> DataFrame:
    """Repeat compacted rows by their multiplicity; copies share the order.

    A row with many copies is first cut into pieces of ``copies_per_row`` which
    are dealt out to the tasks, so that no task emits them all.
    """
    count, size = F.col(WEIGHT), F.lit(int(copies_per_row)).cast("long")
    last = F.floor((count - 1) / size)
    pieces = df.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    spread = pieces.hint("rebalance")
    here = F.least(size, count - F.col("__piece") * size)
    return spread.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), here))).drop(
        "__copy", "__piece", WEIGHT
    )


def dedup(df: DataFrame, keys: Sequence[str] = (*SITE7, *TYPE2), order: str = ORD) -> DataFrame:
    """Distinct rows; the first copy stays."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def drop_min_threshold(
    df: DataFrame,
    min_threshold: float = MIN_THRESHOLD,
    sites: Sequence[str] = SITE7,
    types: Sequence[str] = TYPE2,
) -> DataFrame:
    """Keep rows whose type is seen often enough at its site.

    The share is relative to the site's most frequent type and has to exceed
    the threshold. Rows keep their multiplicity.
    """
    rows = [*sites, *types]
    label = types[-1]
    weighted = WEIGHT in df.columns
    seen = F.when(F.col(label).isNotNull(), F.col(WEIGHT) if weighted else F.lit(1)).otherwise(F.lit(0))
    if weighted:
        counts = df.withColumn("__seen", seen)
    else:
        counts = df.groupBy(*rows).agg(F.sum(seen).alias("__seen"))
    peaks = counts.groupBy(*sites).agg(F.max("__seen").alias("__peak"))
    often = F.try_divide(F.col("__seen"), F.col("__peak")) > F.lit(float(min_threshold))
    kept = null_equal_join(counts, peaks, sites).where(often).drop("__seen", "__peak")
    if weighted:
        return kept.select(*df.columns)
    return null_equal_join(df, kept, rows, "left_semi")


def drop_mult_var(
    df: DataFrame,
    min_amount_types_to_drop: int = MIN_AMOUNT_TYPES_TO_DROP,
    sites: Sequence[str] = SITE7,
    types: Sequence[str] = TYPE2,
    count_across_modules: bool = False,
) -> DataFrame:
    """Drop variables seen with too many different types.

    The module of the type is part of the key unless ``count_across_modules``
    is set; then (module, type) pairs are counted per site.
    """
    label = types[-1]
    keys = list(sites) if count_across_modules else [*sites, *types[:-1]]
    distinct = df.where(F.col(label).isNotNull()).groupBy(*sites, *types).agg(F.lit(1).alias("__one"))
    if min_amount_types_to_drop <= 0:
        return df.where(F.lit(False))
    ambiguous = (
        distinct.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__types"))
        .where(F.col("__types") >= min_amount_types_to_drop)
        .drop("__types")
    )
    return null_equal_join(df, ambiguous, keys, "left_anti")


def keep_only_first(
    df: DataFrame, sites: Sequence[str] = SITE7, types: Sequence[str] = TYPE2, order: str = ORD
) -> DataFrame:
    """First row of every site."""
    distinct = df.drop(WEIGHT) if WEIGHT in df.columns else dedup(df, [*sites, *types], order)
    first = F.min_by(F.struct(*types), F.col(order)).alias("__first")
    reduced = distinct.groupBy(*sites).agg(first, F.min(order).alias(order))
    return reduced.select(*sites, *[F.col("__first")[t].alias(t) for t in types], order)


def union(
    df: DataFrame,
    distinct: bool = False,
    include_file: bool = False,
    sites: Sequence[str] = SITE7,
    types: Sequence[str] = TYPE2,
    order: str = ORD,
    chunk_rows: int = UNION_CHUNK_ROWS,
) -> DataFrame:
    """Replace the types of a site by their union, ``A | B``, modules by ``m,n``.

    Members come in row order and repeat as often as they were seen, unless
    ``distinct`` is set. Sites are equal across files unless ``include_file``
    is set; every file keeps one row. A site with one row is left as it is.

    The text of a site is put together from pieces of at most ``chunk_rows``
    rows, so that members of a hot site are gathered by many tasks.
    """
    module, label = types
    file = sites[0]
    keys = list(sites) if include_file else list(sites[1:])
    if distinct:
        rows = dedup(df, [*keys, *types], order)
    elif WEIGHT in df.columns:
        raise ValueError("a union with repeated members needs single rows: dedup first, or use distinct=True")
    else:
        rows = df
    members = F.array_sort(
        F.collect_list(F.struct(F.col(order).alias("at"), F.col(module).alias("m"), F.col(label).alias("t")))
    )
    pieces = (
        rows.groupBy(*keys, order_chunk(rows, order, chunk_rows).alias("__chunk"))
        .agg(members.alias("__members"))
        .select(
            *keys,
            "__chunk",
            F.size("__members").cast("long").alias("__count"),
            F.col("__members")[0].alias("__head"),
            F.array_join(F.transform("__members", lambda x: F.coalesce(x["m"], F.lit(""))), ",").alias("__modules"),
            F.array_join(F.transform("__members", lambda x: x["t"]), " | ").alias("__types"),
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("__chunk", "__head", "__modules", "__types")))
    texts = (
        pieces.groupBy(*keys)
        .agg(F.sum("__count").alias("__count"), ordered.alias("__pieces"))
        .select(
            *keys,
            F.when(F.col("__count") == 1, F.col("__pieces")[0]["__head"]["m"])
            .otherwise(F.array_join(F.transform("__pieces", lambda p: p["__modules"]), ","))
            .alias(module),
            F.array_join(F.transform("__pieces", lambda p: p["__types"]), " | ").alias(label),
        )
    )
    files = df.groupBy(file, *[k for k in keys if k != file]).agg(F.min(order).alias(order))
    return null_equal_join(files, texts, keys).select(*sites, *types, order)


def union_members(
    df: DataFrame,
    distinct: bool = False,
    include_file: bool = False,
    most: int = MAX_MEMBERS,
    sites: Sequence[str] = SITE7,
    types: Sequence[str] = TYPE2,
    order: str = ORD,
) -> tuple[DataFrame, DataFrame]:
    """The union of a site's types as a column ``members`` of (module, type), and the sites too large for that.

    Members are those of ``union``, in the same order; ``member_text`` writes
    them out. They are one cell, so a site with more than ``most`` members is
    never gathered: it is counted first, and goes to the second table, with the
    site's columns, ``n_members`` and an ``error``.
    """
    keys = list(sites) if include_file else list(sites[1:])
    if distinct:
        rows = dedup(df, [*keys, *types], order)
    elif WEIGHT in df.columns:
        raise ValueError("a union with repeated members needs single rows: dedup first, or use distinct=True")
    else:
        rows = df
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_members"))
    too_many = sizes.where(F.col("n_members") > most)
    fitting = null_equal_join(rows, too_many.select(*keys), keys, "left_anti")
    member = F.struct(F.col(order).alias("at"), F.col(types[0]).alias("module"), F.col(types[1]).alias("type"))
    listed = F.transform(F.array_sort(F.collect_list(member)), lambda m: F.struct(m["module"].alias("module"), m["type"].alias("type")))
    members = fitting.groupBy(*keys).agg(listed.alias("members"))
    files = df.groupBy(sites[0], *[k for k in keys if k != sites[0]]).agg(F.min(order).alias(order))
    united = null_equal_join(files, members, keys).select(*sites, "members", order)
    error = F.concat(F.lit("more members than "), F.lit(most).cast("string"))
    return united, too_many.withColumn("error", error)


def member_text(united: DataFrame, types: Sequence[str] = TYPE2) -> DataFrame:
    """Write the members of a union out as text: modules ``m,n``, types ``A | B``; one member as it is."""
    modules = F.array_join(F.transform("members", lambda m: F.coalesce(m["module"], F.lit(""))), ",")
    single = F.size("members") == 1
    return united.withColumns(
        {
            types[0]: F.when(single, F.col("members")[0]["module"]).otherwise(modules),
            types[1]: F.array_join(F.transform("members", lambda m: m["type"]), " | "),
        }
    ).drop("members")


def common_bases(
    df: DataFrame,
    hierarchy: DataFrame,
    keys: Sequence[str],
    types: Sequence[str] = TYPE2,
    order: str = ORD,
    on_unknown: str = "error",
    salts: int = BASE_SALTS,
) -> DataFrame:
    """Nearest common base of every group of types: ``keys``, ``base``, ``n_types``.

    Of the common bases the first one in the shortest list wins, the earliest
    list among equally short ones. Groups without a common base are left out.

    What a set of types needs to be known for is small, whatever its size: its
    shortest list, the bases all its lists have, and the number of types. Types
    are dealt out to ``salts`` parts of a group, and the parts' states are
    intersected; so a part holds at most that share of the hierarchy's types, and
    nothing is exploded, counted per base and joined back.
    """
    module, label = types
    if on_unknown not in ("error", "keep"):
        raise ValueError(f"on_unknown must be error or keep, not {on_unknown}")
    kept = F.filter("bases", lambda b: ~F.coalesce(b["module"].isin(IGNORED_BASE_MODULES), F.lit(False)))
    lists = hierarchy.select(
        F.col("module").alias(module),
        F.col("type").alias(label),
        F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))).alias("__bases"),
    )
    distinct = df.groupBy(*keys, *types).agg(F.min(order).alias("__first"))
    listed = null_equal_join(distinct, lists, types, "left")
    if on_unknown == "error":
        name = F.concat_ws(".", F.col(module), F.col(label))
        unknown = F.raise_error(F.concat(F.lit("type is not in the hierarchy: "), name)).cast(listed.schema["__bases"].dataType)
    else:
        unknown = F.array().cast(listed.schema["__bases"].dataType)
    bases = F.coalesce(F.col("__bases"), unknown)
    # a list that is empty comes first and leaves nothing in common
    rank = F.struct(F.size("__bases").alias("size"), F.col("__first").alias("first"))
    ranked = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col("__bases").alias("shared"))))
    parts = (
        listed.withColumn("__bases", bases)
        .groupBy(*keys, F.pmod(F.xxhash64(*types), F.lit(salts)).alias("__salt"))
        .agg(ranked.alias("__lists"))
        .select(
            *keys,
            F.size("__lists").cast("long").alias("__types"),
            F.struct(
                F.col("__lists")[0]["rank"].alias("rank"),
                F.col("__lists")[0]["shared"].alias("shortest"),
                _in_common(F.col("__lists")).alias("shared"),
            ).alias("__part"),
        )
    )
    groups = parts.groupBy(*keys).agg(F.sum("__types").alias("n_types"), F.array_sort(F.collect_list("__part")).alias("__parts"))
    first = F.get(_in_common(F.col("__parts"), "shortest"), F.lit(0)).alias("base")
    return groups.select(*keys, first, "n_types").where(F.col("base").isNotNull())


def _in_common(ranked: Column, start: str = "shared") -> Column:
    """What all lists have, in the order of the first one."""
    return F.aggregate(ranked, ranked[0][start], lambda found, item: F.array_intersect(found, item["shared"]))


def unify_subtypes(
    df: DataFrame,
    hierarchy: DataFrame,
    only_unify_if_base_was_traced: bool = False,
    include_file: bool = False,
    on_unknown: str = "error",
    sites: Sequence[str] = SITE7,
    types: Sequence[str] = TYPE2,
    order: str = ORD,
) -> DataFrame:
    """Replace the types of a site by their nearest common base, if they have one.

    In strict mode the base has to occur in the table: its module and its name
    are looked up independently of each other, a base without module counts as
    present when any row has no module. Groups of one type are left alone.
    """
    module, label = types
    keys = list(sites) if include_file else list(sites[1:])
    distinct = df.drop(WEIGHT) if WEIGHT in df.columns else dedup(df, [*sites, *types], order)
    bases = common_bases(distinct, hierarchy, keys, types, order, on_unknown)
    bases = bases.where(F.col("n_types") > 1).drop("n_types")
    if only_unify_if_base_was_traced:
        bases = base_was_seen(bases, distinct, types)
    replaced = null_equal_join(distinct, bases, keys, "left").select(
        *sites,
        F.when(F.col("base").isNotNull(), F.col("base")["module"]).otherwise(F.col(module)).alias(module),
        F.when(F.col("base").isNotNull(), F.col("base")["type"]).otherwise(F.col(label)).alias(label),
        order,
    )
    return dedup(replaced, [*sites, *types], order)


def base_was_seen(bases: DataFrame, seen: DataFrame, types: Sequence[str] = TYPE2) -> DataFrame:
    """Rows whose base's module and name both occur somewhere in ``seen``."""
    module, label = types
    columns = bases.columns
    modules = seen.groupBy(F.col(module).alias("__m")).agg(F.lit(1).alias("__one")).drop("__one")
    labels = seen.groupBy(F.col(label).alias("__t")).agg(F.lit(1).alias("__one")).drop("__one")
    flat = bases.withColumn("__m", F.col("base")["module"]).withColumn("__t", F.col("base")["type"])
    flat = null_equal_join(flat, modules, ["__m"], "left_semi")
    return null_equal_join(flat, labels, ["__t"], "left_semi").select(*columns)


def conflicts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups that still have more than one row."""
    total = F.sum(WEIGHT) if WEIGHT in df.columns else F.count(F.lit(1))
    return df.groupBy(*keys).agg(total.alias("n_hints")).where(F.col("n_hints") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with their row count; the query fails at a group with more than one row."""
    total = F.sum(WEIGHT) if WEIGHT in df.columns else F.count(F.lit(1))
    shown = F.to_json(F.struct(*keys))
    checked = F.when(
        F.col("n_hints") > 1, F.raise_error(F.concat(F.lit("more than one hint for "), shown)).cast("long")
    ).otherwise(F.col("n_hints"))
    return df.groupBy(*keys).agg(total.alias("n_hints")).withColumn("n_hints", checked)
