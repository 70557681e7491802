"""Type hierarchy from inheritance edges.

Every type gets its bases in lookup order: itself first, the root last. A type
is worked out once all its bases are. A chain of single bases takes rounds as
the logarithm of its length, others as their depth. The state between rounds is
a written table.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftmill.schemas import HIERARCHY, TYPE_REF
from siftmill.session import shared_folder, written

# Fixed value: the root of all types, a builtin.
ROOT = "object"
_ROOT_ID = f":{ROOT}"


def _type_id(module: Column, name: Column) -> Column:
    return F.concat(F.coalesce(module, F.lit("")), F.lit(":"), name)


def _merge(lines: list[list[str]]) -> list[str] | None:
    """Merge lookup orders: take the first head that no other order puts later; none left over means failure."""
    lines = [list(line) for line in lines if len(line)]
    merged: list[str] = []
    while lines:
        head = next((line[0] for line in lines if not any(line[0] in other[1:] for other in lines)), None)
        if head is None:
            return None
        merged.append(head)
        lines = [rest for line in lines if (rest := line[1:] if line[0] == head else line)]
    return merged


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lookup_order(own: pd.Series, bases: pd.Series, lines: pd.Series) -> pd.Series:
    def one(name, direct, orders):
        merged = _merge([*map(list, orders), list(direct)])
        return None if merged is None else [name, *merged]

    return pd.Series([one(*row) for row in zip(own, bases, lines)], dtype=object)


_LINE = T.ArrayType(T.StringType())
# A type with its lookup order.
_SETTLED = T.StructType([T.StructField("id", T.StringType()), T.StructField("line", _LINE)])
# A type with a single base: the part of its order up to a type still open.
_SINGLE = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("above", _LINE), T.StructField("next", T.StringType())]
)
# A base of a type with several, with its order once that is known.
_LINK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("base", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("line", _LINE),
    ]
)


def _single_lines(rows: DataFrame, frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types with one base: those settled now, as ``next`` was in the round before, and the others after a jump.

    Jumps double in length, so a chain takes rounds as the logarithm of its
    depth. A type whose ``next`` is settled in this round waits for it, so
    nobody needs to look further back than one round. A type that comes back to
    itself is on a cycle and drops out.
    """
    settled = frontier.select(F.col("id").alias("next"), F.col("line").alias("rest"))
    joined = rows.join(settled, "next", "left")
    found = joined.where(F.col("rest").isNotNull()).select("id", F.concat("above", "rest").alias("line"))
    waiting = joined.where(F.col("rest").isNull()).select("id", "above", "next")
    jumps = waiting.select(F.col("id").alias("next"), F.col("above").alias("more"), F.col("next").alias("further"))
    jumped = waiting.join(jumps, "next", "left")
    far = F.col("further").isNotNull()
    moved = jumped.select(
        "id",
        F.when(far, F.concat("above", "more")).otherwise(F.col("above")).alias("above"),
        F.when(far, F.col("further")).otherwise(F.col("next")).alias("next"),
    )
    return found, moved.where(~F.array_contains("above", F.col("next")))


def _merged_lines(links: DataFrame, frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types with several bases: those settled now, as all their bases are, and the links of the others."""
    settled = frontier.select(F.col("id").alias("base"), F.col("line").alias("__line"))
    filled = links.join(settled, "base", "left").select("id", "base", "position", F.coalesce("line", "__line").alias("line"))
    # a type's direct bases stand in one line of its source: the lists are short
    grouped = filled.groupBy("id").agg(
        F.count_if(F.col("line").isNull()).alias("open"),
        F.sort_array(F.collect_list(F.struct("position", "base", "line"))).alias("parts"),
    )
    ready = grouped.where("open = 0")
    bases, lines = F.transform("parts", lambda p: p["base"]), F.transform("parts", lambda p: p["line"])
    found = ready.select("id", _lookup_order(F.col("id"), bases, lines).alias("line")).where(F.col("line").isNotNull())
    waiting = grouped.where("open > 0").select("id", F.inline("parts")).select(*_LINK.names)
    return found, waiting


def _settle(links: DataFrame, known: DataFrame) -> DataFrame:
    """Lookup orders (id, line) of all types of ``links`` (id, base, position) that have one, given those in ``known``.

    A round looks at what the round before has settled, and at what is still
    open, never at all that is known.
    """
    spark = links.sparkSession
    folder = shared_folder(spark, "hierarchy")

    def put(rows: DataFrame, schema: T.StructType, name: str) -> DataFrame:
        rows.select(*schema.names).write.parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    counted = links.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("base").alias("next"))
    singles = put(counted.where("n = 1").withColumn("above", F.array("id")), _SINGLE, "singles/round=0")
    several = links.join(counted.where("n > 1").select("id"), "id", "left_semi").withColumn("line", F.lit(None).cast(_LINE))
    several = put(several.withColumn("position", F.col("position").cast("long")), _LINK, "several/round=0")
    frontier = known
    # each round before the last settles a type at least
    for number in itertools.count(1):
        by_one, singles_left = _single_lines(singles, frontier)
        by_several, several_left = _merged_lines(several, frontier)
        settled = put(by_one.unionByName(by_several), _SETTLED, f"settled/round={number}")
        if settled.isEmpty():
            break
        singles = put(singles_left, _SINGLE, f"singles/round={number}")
        several = put(several_left, _LINK, f"several/round={number}")
        frontier = settled
    return spark.read.schema(_SETTLED).parquet(f"{folder}/settled/round=*")


def _links(edges: DataFrame) -> DataFrame:
    own = _type_id(F.col("module"), F.col("type")).alias("id")
    base = _type_id(F.col("base_module"), F.col("base_type"))
    links = edges.select(own, F.coalesce(base, F.lit(_ROOT_ID)).alias("base"), "position").where(F.col("id") != _ROOT_ID)
    return written(links, "links")


def _reference(type_id: Column) -> Column:
    module = F.nullif(F.substring_index(type_id, ":", 1), F.lit(""))
    return F.struct(module.alias("module"), F.substring_index(type_id, ":", -1).alias("type")).cast(TYPE_REF)


def _as_table(known: DataFrame) -> DataFrame:
    return known.select(
        _reference(F.col("id"))["module"].alias("module"),
        _reference(F.col("id"))["type"].alias("type"),
        F.transform("line", _reference).alias("bases"),
    ).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HIERARCHY.fields])


def _without_order(links: DataFrame, known: DataFrame) -> DataFrame:
    missing = links.select("id").distinct().join(known.select("id"), "id", "left_anti")
    return missing.select(_reference(F.col("id"))["module"].alias("module"), _reference(F.col("id"))["type"].alias("type"))


def hierarchy_from_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hierarchy table and the types (module, type) that have none.

    ``edges`` has module, type, base_module, base_type, position; a type
    without bases has one row with a null base. No order exists for types with
    an unknown base, on a cycle, or whose bases contradict each other.
    """
    links = _links(edges)
    root = edges.sparkSession.createDataFrame([(_ROOT_ID, [_ROOT_ID])], _SETTLED)
    known = root.unionByName(_settle(links, root))
    return _as_table(known), _without_order(links, known)


def update_hierarchy(hierarchy: DataFrame, edges: DataFrame, old_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``hierarchy_from_edges(edges)``, given the hierarchy of ``old_edges``.

    Worked out anew are the types whose bases differ between the two edge
    tables, everything that had one of them in its lookup order, and types that
    had no order. All others keep theirs and are only read.
    """
    links, old_links = _links(edges), _links(old_edges)

    def bases(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("position", "base"))).alias(name))

    compared = bases(links, "now").join(bases(old_links, "before"), "id", "full")
    changed = compared.where(~F.col("now").eqNullSafe(F.col("before"))).select("id")
    base_ids = F.transform("bases", lambda b: _type_id(b["module"], b["type"]))
    stored = hierarchy.select(_type_id(F.col("module"), F.col("type")).alias("id"), base_ids.alias("line"))
    below = stored.select("id", F.explode("line").alias("base")).join(changed.withColumnRenamed("id", "base"), "base", "left_semi").select("id")
    without = links.select("id").join(stored, "id", "left_anti")
    affected = written(changed.unionByName(below).unionByName(without).distinct(), "affected")
    kept = stored.join(affected, "id", "left_anti")
    settled = _settle(written(links.join(affected, "id", "left_semi"), "links"), written(kept, "kept"))
    known = kept.unionByName(settled)
    return _as_table(known), _without_order(links, known)
