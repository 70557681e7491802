"""Queries of the reducers, the chains and the type hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftmill.catalog.views import HIERARCHY_EDGES_SQL, OBSERVED_SQL, hierarchy, observed, table
from siftmill.operators import reduce as reducers
from siftmill.operators.hierarchy import hierarchy_from_edges, update_hierarchy
from siftmill.operators.keys import null_equal_join
from siftmill.plans.pipeline import Chain, Configuration
from siftmill.schemas import OBS9, ORD, SITE6, SITE7, TYPE2
from siftmill.session import written

_SITE6 = ", ".join(SITE6)
_SITE7 = ", ".join(SITE7)
_OBS9 = ", ".join(OBS9)
_OBS9_NAMES = [*OBS9, ORD]


def _same(left: str, right: str, columns) -> str:
    return " AND ".join(f"{left}.{c} IS NOT DISTINCT FROM {right}.{c}" for c in columns)


WITH_V = f"WITH v AS ({OBSERVED_SQL})"

DEDUP_SQL = f"SELECT {_OBS9}, min(_ord) AS _ord FROM {{}} GROUP BY {_OBS9}"


def threshold_sql(source: str, threshold: float) -> str:
    """Rows of ``source`` whose type is frequent enough at its site."""
    return f"""SELECT {_OBS9}, _ord FROM (
        SELECT *, max(cnt) OVER (PARTITION BY {_SITE7}) AS peak FROM (
            SELECT *, count(Type) OVER (PARTITION BY {_OBS9}) AS cnt FROM {source}))
        WHERE cnt::DOUBLE / peak > {threshold}"""


def first_sql(source: str) -> str:
    return f"""SELECT {_OBS9}, _ord FROM (
        SELECT *, row_number() OVER (PARTITION BY {_SITE7} ORDER BY _ord) AS rn FROM {source}) WHERE rn = 1"""


def mult_var_sql(source: str, amount: int) -> str:
    keys = f"{_SITE7}, TypeModule"
    return f"""SELECT {', '.join('s.' + c for c in OBS9)}, s._ord FROM {source} s JOIN (
        SELECT {keys}, count(DISTINCT Type) AS n FROM {source} GROUP BY {keys}) k
        ON {_same('s', 'k', [*SITE7, 'TypeModule'])} WHERE k.n < {amount}"""


def union_sql(source: str, members: str, keys) -> str:
    """United types per site, one row per file; ``members`` holds the rows to unite."""
    names = ", ".join(keys)
    sites = ", ".join(f"s.{c}" for c in SITE7)
    return f"""SELECT {sites}, u.TypeModule, u.Type, min(s._ord) AS _ord FROM {source} s JOIN (
        SELECT {names},
          CASE WHEN count(*) = 1 THEN min(TypeModule)
               ELSE string_agg(coalesce(TypeModule, ''), ',' ORDER BY _ord) END AS TypeModule,
          string_agg(Type, ' | ' ORDER BY _ord) AS Type
        FROM {members} GROUP BY {names}) u ON {_same('s', 'u', keys)}
        GROUP BY {sites}, u.TypeModule, u.Type"""


def bases_sql(source: str, strict: bool) -> str:
    """Common base by counting: every type of the site has it; nearest in the shortest list."""
    seen = f"""AND EXISTS (SELECT 1 FROM {source} m WHERE m.TypeModule IS NOT DISTINCT FROM c.base_module)
        AND EXISTS (SELECT 1 FROM {source} t WHERE t.Type = c.base_type)""" if strict else ""
    return f"""
    distinct_types AS (SELECT {_SITE6}, TypeModule, Type, min(_ord) AS first_ord FROM {source}
        GROUP BY {_SITE6}, TypeModule, Type),
    listed AS (SELECT d.*, h.base_module, h.base_type, h.place,
          count(*) OVER (PARTITION BY {', '.join('d.' + c for c in SITE6)}, d.TypeModule, d.Type) AS len
        FROM distinct_types d JOIN h ON d.TypeModule IS NOT DISTINCT FROM h.module AND d.Type = h.type),
    sized AS (SELECT {_SITE6}, count(*) AS n FROM distinct_types GROUP BY {_SITE6}),
    ranked AS (SELECT *, dense_rank() OVER (PARTITION BY {_SITE6} ORDER BY len, first_ord) AS rk FROM listed),
    shared AS (SELECT {_SITE6}, base_module, base_type, count(*) AS having_it,
          min(CASE WHEN rk = 1 THEN place END) AS place FROM ranked GROUP BY {_SITE6}, base_module, base_type),
    picked AS (SELECT c.*, row_number() OVER (PARTITION BY {', '.join('c.' + k for k in SITE6)} ORDER BY place) AS rn
        FROM shared c JOIN sized s ON {_same('c', 's', SITE6)} WHERE c.having_it = s.n AND s.n > 1),
    chosen AS (SELECT * FROM picked c WHERE rn = 1 {seen})"""


def replaced_sql(source: str, strict: bool) -> str:
    return f"""{bases_sql(source, strict)},
    replaced AS (SELECT s.{', s.'.join(SITE7)},
          CASE WHEN c.base_type IS NULL THEN s.TypeModule ELSE c.base_module END AS TypeModule,
          coalesce(c.base_type, s.Type) AS Type, s._ord
        FROM {source} s LEFT JOIN chosen c ON {_same('s', 'c', SITE6)})"""


def subtypes_sql(source: str, strict: bool) -> str:
    return f"{replaced_sql(source, strict)} {DEDUP_SQL.format('replaced')}"


WITH_VH = f"{WITH_V}, h AS ({HIERARCHY_EDGES_SQL}), "

# The kinds and the names of their settings, which make up the file format.
CONFIGURATION = """
[[unifier]]
name = "without_tests"
kind = "drop_test"
test_name_pat = "test_"

[[unifier]]
name = "common_enough"
kind = "drop_min_threshold"
min_threshold = 0.3

[[unifier]]
name = "distinct_rows"
kind = "dedup"

[[unifier]]
name = "at_most_two_types"
kind = "drop_mult_var"
min_amount_types_to_drop = 3

[[unifier]]
name = "to_seen_base"
kind = "unify_subty"
only_unify_if_base_was_traced = true

[[unifier]]
name = "joined"
kind = "union"

[[unifier]]
name = "earliest"
kind = "keep_only_first"
"""

FLAGSHIP_CHAIN = ["without_tests", "common_enough", "distinct_rows", "earliest"]
STRICT_CHAIN = ["without_tests", "distinct_rows", "to_seen_base", "distinct_rows", "at_most_two_types"]
UNION_CHAIN = ["without_tests", "common_enough", "distinct_rows", "joined", "distinct_rows", "earliest"]


def united_members_of_sites(spark, sf_dir: str) -> DataFrame:
    """Members of every site's union, one a row; sites with more members than allowed have an error instead."""
    united, too_large = reducers.union_members(observed(spark, sf_dir), distinct=True, most=1)
    rows = united.select(*SITE7, F.posexplode("members").alias("place", "m"))
    rows = rows.select(*SITE7, F.col("place").cast("long").alias("place"), F.col("m.module").alias("TypeModule"), F.col("m.type").alias("Type"), F.lit(None).cast("string").alias("error"))
    nothing = F.lit(None).cast("string")
    errors = too_large.select(nothing.alias("Filename"), *SITE6, F.col("n_members").alias("place"), nothing.alias("TypeModule"), nothing.alias("Type"), "error")
    return rows.unionByName(errors)


def flagship(spark, sf_dir: str) -> DataFrame:
    return Configuration.from_toml(CONFIGURATION).chain(FLAGSHIP_CHAIN)(observed(spark, sf_dir)).select(*_OBS9_NAMES)


def _chain(names, written_steps=False):
    def run(spark, sf_dir: str) -> DataFrame:
        chain = Configuration.from_toml(CONFIGURATION).chain(names)
        return chain(observed(spark, sf_dir), hierarchy(spark), written_steps=written_steps).select(*_OBS9_NAMES)

    return run


def _over_view(operator):
    return lambda spark, sf_dir: operator(observed(spark, sf_dir)).select(*_OBS9_NAMES)


def registered_chain(spark, sf_dir: str) -> DataFrame:
    """A chain built in code, kinds looked up in the registry."""
    chain = Chain().append("drop_mult_var", min_amount_types_to_drop=2).append("keep_only_first")
    return chain(observed(spark, sf_dir)).select(*_OBS9_NAMES)


def base_lookup(spark, sf_dir: str) -> DataFrame:
    """Every type of the view with its bases, one row per base."""
    types = observed(spark, sf_dir).groupBy(*TYPE2).agg(F.count(F.lit(1)).alias("n_rows"))
    bases = hierarchy(spark).withColumnRenamed("module", "TypeModule").withColumnRenamed("type", "Type")
    joined = null_equal_join(types, bases, TYPE2, "left")
    return joined.select(*TYPE2, "n_rows", F.posexplode_outer("bases").alias("place", "base")).select(
        *TYPE2,
        "n_rows",
        F.col("place").cast("long").alias("place"),
        F.col("base")["module"].alias("base_module"),
        F.col("base")["type"].alias("base_type"),
    )


def base_seen(spark, sf_dir: str) -> DataFrame:
    """Common bases of all sites that occur in the table themselves."""
    rows = observed(spark, sf_dir)
    bases = reducers.common_bases(rows, hierarchy(spark), SITE6).where(F.col("n_types") > 1)
    kept = reducers.base_was_seen(bases, rows)
    return kept.select(*SITE6, F.col("base")["module"].alias("base_module"), F.col("base")["type"].alias("base_type"))


def site_conflicts(spark, sf_dir: str) -> DataFrame:
    return reducers.conflicts(reducers.dedup(observed(spark, sf_dir)), SITE7)


def share_at_site(spark, sf_dir: str) -> DataFrame:
    """Counts per row value and their peak per site, brought to the compacted rows."""
    counts = reducers.compact(observed(spark, sf_dir)).drop(ORD)
    peaks = counts.groupBy(*SITE7).agg(F.max("_n").alias("peak"))
    return null_equal_join(counts, peaks, SITE7).select(*OBS9, F.col("_n").alias("n"), "peak")


def types_at_site(spark, sf_dir: str) -> DataFrame:
    """Number of different types per site and module, brought to the compacted rows."""
    counts = reducers.compact(observed(spark, sf_dir)).drop(ORD)
    amounts = counts.groupBy(*SITE7, "TypeModule").agg(F.count("Type").alias("amount_types"))
    return null_equal_join(counts, amounts, [*SITE7, "TypeModule"]).select(*OBS9, F.col("_n").alias("n"), "amount_types")


def expanded(spark, sf_dir: str) -> DataFrame:
    """Compacting and expanding again keeps every row's multiplicity."""
    rows = reducers.expand(reducers.compact(observed(spark, sf_dir)))
    return rows.groupBy(*OBS9).agg(F.count(F.lit(1)).alias("n"))


def inheritance(spark, sf_dir: str) -> DataFrame:
    """Parts as types, each inheriting from the part with a third of its number."""
    key = F.col("p_partkey")
    edges = table(spark, sf_dir, "part").select(
        F.lit("parts").alias("module"),
        F.concat(F.lit("P"), key.cast("string")).alias("type"),
        F.when(key > 0, "parts").alias("base_module"),
        F.when(key > 0, F.concat(F.lit("P"), F.expr("p_partkey div 3").cast("string"))).alias("base_type"),
        F.lit(0).alias("position"),
    )
    bases, _ = hierarchy_from_edges(edges)
    return bases.where(F.col("module") == "parts").select("type", F.posexplode("bases").alias("place", "base")).select(
        "type", F.col("place").cast("long").alias("place"), F.col("base.type").alias("base_type")
    )


def deep_inheritance(spark, sf_dir: str) -> DataFrame:
    """Chains of twenty types below each other, as many as the parts make: depth of every type."""
    key = F.col("p_partkey")
    edges = table(spark, sf_dir, "part").select(
        F.lit("chain").alias("module"),
        F.concat(F.lit("T"), key.cast("string")).alias("type"),
        F.when(key % 20 != 0, F.lit("chain")).alias("base_module"),
        F.when(key % 20 != 0, F.concat(F.lit("T"), (key - 1).cast("string"))).alias("base_type"),
        F.lit(0).alias("position"),
    )
    bases, _ = hierarchy_from_edges(edges)
    return bases.where(F.col("module") == "chain").select("type", F.size("bases").cast("long").alias("depth"))


def updated_inheritance(spark, sf_dir: str) -> DataFrame:
    """A stored hierarchy after some types changed their base, some were added and some removed."""
    key = F.col("p_partkey")

    def edges(base, prefix: str = "P"):
        return table(spark, sf_dir, "part").select(
            F.lit("parts").alias("module"),
            F.concat(F.lit(prefix), key.cast("string")).alias("type"),
            F.when(key > 0, "parts").alias("base_module"),
            F.when(key > 0, F.concat(F.lit("P"), base.cast("string"))).alias("base_type"),
            F.lit(0).alias("position"),
        )

    third = F.expr("p_partkey div 3")
    added = F.substring("type", 2, 20).cast("long") % 90 == 11
    old = edges(third).where(~added).unionByName(edges(third, "Q"))
    new = edges(F.when(key % 50 == 7, F.expr("p_partkey div 5")).otherwise(third))
    stored = written(hierarchy_from_edges(old)[0], "hierarchy")
    bases, _ = update_hierarchy(stored, new, old)
    return bases.where(F.col("module") == "parts").select("type", F.posexplode("bases").alias("place", "base")).select(
        "type", F.col("place").cast("long").alias("place"), F.col("base.type").alias("base_type")
    )


INHERITANCE_SQL = """WITH RECURSIVE up AS (
   SELECT p_partkey, p_partkey AS base, 0::BIGINT AS place FROM part
   UNION ALL SELECT p_partkey, base // 3, place + 1 FROM up WHERE base > 0)
 SELECT 'P' || p_partkey AS type, place, 'P' || base AS base_type FROM up
 UNION ALL SELECT 'P' || p_partkey, max(place) + 1, 'object' FROM up GROUP BY p_partkey"""

QUERIES = {
    "hierarchy_from_edges": (inheritance, INHERITANCE_SQL),
    "hierarchy_updated": (
        updated_inheritance,
        INHERITANCE_SQL.replace("base // 3", "CASE WHEN base % 50 = 7 THEN base // 5 ELSE base // 3 END"),
    ),
    "hierarchy_deep": (
        deep_inheritance,
        "SELECT 'T' || p_partkey AS type, p_partkey % 20 + 2 AS depth FROM part",
    ),
    "unify_dedup": (_over_view(reducers.dedup), f"{WITH_V} {DEDUP_SQL.format('v')}"),
    "unify_min_threshold": (
        _over_view(lambda df: reducers.drop_min_threshold(df, 0.3)),
        f"{WITH_V} {threshold_sql('v', 0.3)}",
    ),
    "unify_min_threshold_compacted": (
        lambda spark, sf_dir: reducers.drop_min_threshold(reducers.compact(observed(spark, sf_dir)), 0.3),
        f"{WITH_V}, kept AS ({threshold_sql('v', 0.3)}) "
        f"SELECT {_OBS9}, count(*) AS _n, min(_ord) AS _ord FROM kept GROUP BY {_OBS9}",
    ),
    "unify_drop_mult_var": (_over_view(reducers.drop_mult_var), f"{WITH_V} {mult_var_sql('v', 2)}"),
    "unify_drop_mult_var_across_modules": (
        _over_view(lambda df: reducers.drop_mult_var(df, 2, count_across_modules=True)),
        f"""{WITH_V} SELECT {', '.join('s.' + c for c in OBS9)}, s._ord FROM v s JOIN (
            SELECT {_SITE7}, count(*) AS n FROM (SELECT DISTINCT {_OBS9} FROM v) GROUP BY {_SITE7}) k
            ON {_same('s', 'k', SITE7)} WHERE k.n < 2""",
    ),
    "unify_keep_first": (_over_view(reducers.keep_only_first), f"{WITH_V} {first_sql('v')}"),
    "unify_union": (
        _over_view(reducers.union),
        f"{WITH_V} {union_sql('v', 'v', SITE6)}",
    ),
    "unify_union_members": (
        united_members_of_sites,
        f"""{WITH_V}, d AS (SELECT {_SITE6}, TypeModule, Type, min(_ord) AS first_at FROM v GROUP BY {_SITE6}, TypeModule, Type),
          m AS (SELECT *, row_number() OVER (PARTITION BY {_SITE6} ORDER BY first_at) - 1 AS place, count(*) OVER (PARTITION BY {_SITE6}) AS n FROM d),
          f AS (SELECT DISTINCT {_SITE7} FROM v)
        SELECT f.Filename, {', '.join('m.' + c for c in SITE6)}, place, TypeModule, Type, NULL::VARCHAR AS error
        FROM f JOIN m ON {_same('f', 'm', SITE6)} WHERE n <= 1
        UNION ALL SELECT DISTINCT NULL, {_SITE6}, n, NULL, NULL, 'more members than 1' FROM m WHERE n > 1""",
    ),
    "unify_union_distinct": (
        _over_view(lambda df: reducers.union(df, distinct=True)),
        f"{WITH_V}, d AS (SELECT {_SITE6}, TypeModule, Type, min(_ord) AS _ord FROM v "
        f"GROUP BY {_SITE6}, TypeModule, Type) {union_sql('v', 'd', SITE6)}",
    ),
    "unify_union_per_file": (
        _over_view(lambda df: reducers.union(df, include_file=True)),
        f"{WITH_V} {union_sql('v', 'v', SITE7)}",
    ),
    "unify_subtypes": (
        lambda spark, sf_dir: reducers.unify_subtypes(observed(spark, sf_dir), hierarchy(spark)),
        f"{WITH_VH} {subtypes_sql('v', False)}",
    ),
    "unify_subtypes_strict": (
        lambda spark, sf_dir: reducers.unify_subtypes(observed(spark, sf_dir), hierarchy(spark), True),
        f"{WITH_VH} {subtypes_sql('v', True)}",
    ),
    "hierarchy_base_lookup": (
        base_lookup,
        f"""{WITH_VH} t AS (SELECT TypeModule, Type, count(*) AS n_rows FROM v GROUP BY TypeModule, Type),
        whole AS (SELECT * FROM h UNION ALL SELECT module, type, NULL, 'object', max(place) + 1 FROM h
            GROUP BY module, type)
        SELECT t.TypeModule, t.Type, n_rows, CAST(place AS BIGINT) AS place, base_module, base_type
        FROM t JOIN whole w ON t.TypeModule IS NOT DISTINCT FROM w.module AND t.Type = w.type""",
    ),
    "hierarchy_base_seen": (
        base_seen,
        f"{WITH_VH} {bases_sql('v', True)} "
        f"SELECT {_SITE6}, base_module, base_type FROM chosen",
    ),
    "site_conflicts": (
        site_conflicts,
        f"{WITH_V}, d AS (SELECT DISTINCT {_OBS9} FROM v) "
        f"SELECT {_SITE7}, count(*) AS n_hints FROM d GROUP BY {_SITE7} HAVING count(*) > 1",
    ),
    "join_share_at_site": (
        share_at_site,
        f"{WITH_V}, c AS (SELECT {_OBS9}, count(*) AS n FROM v GROUP BY {_OBS9}) "
        f"SELECT *, max(n) OVER (PARTITION BY {_SITE7}) AS peak FROM c",
    ),
    "join_types_at_site": (
        types_at_site,
        f"{WITH_V}, c AS (SELECT {_OBS9}, count(*) AS n FROM v GROUP BY {_OBS9}) "
        f"SELECT *, count(*) OVER (PARTITION BY {_SITE7}, TypeModule) AS amount_types FROM c",
    ),
    "compact_and_expand": (expanded, f"{WITH_V} SELECT {_OBS9}, count(*) AS n FROM v GROUP BY {_OBS9}"),
    "chain_flagship": (
        flagship,
        f"""{WITH_V}, a AS (SELECT * FROM v WHERE NOT coalesce(regexp_matches(FunctionName, '^(?:test_)'), false)),
        b AS ({threshold_sql('a', 0.3)}), c AS ({DEDUP_SQL.format('b')}) {first_sql('c')}""",
    ),
    "chain_strict": (
        _chain(STRICT_CHAIN, written_steps=True),
        f"""{WITH_VH} a AS (SELECT * FROM v WHERE NOT coalesce(FunctionName LIKE 'test\\_%' ESCAPE '\\', false)),
        b AS ({DEDUP_SQL.format('a')}), {replaced_sql('b', True)},
        c AS ({DEDUP_SQL.format('replaced')}) {mult_var_sql('c', 3)}""",
    ),
    "chain_union": (
        _chain(UNION_CHAIN),
        f"""{WITH_V}, a AS (SELECT * FROM v WHERE NOT coalesce(FunctionName LIKE 'test\\_%' ESCAPE '\\', false)),
        b AS ({threshold_sql('a', 0.3)}), c AS ({DEDUP_SQL.format('b')}),
        d AS ({union_sql('c', 'c', SITE6)}) {first_sql('d')}""",
    ),
    "chain_registered": (registered_chain, f"{WITH_V}, a AS ({mult_var_sql('v', 2)}) {first_sql('a')}"),
}
