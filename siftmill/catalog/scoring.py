"""Queries of matching and scoring, of changes between events, and of timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftmill.catalog.reducing import WITH_V, _same
from siftmill.catalog.views import observed, table
from siftmill.operators import changes, matching, ordered, timings
from siftmill.schemas import HINT6, HINT7, OBS9
from siftmill.sources.files import valid_timings

_KEYS6, _KEYS7 = ", ".join(HINT6), ", ".join(HINT7)


def hint_sides(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hints of even events as the originals, those of odd events as the generated ones."""
    hints = observed(spark, sf_dir).withColumnRenamed("LineNo", "ColumnOffset").select(*HINT7, "_ord")
    # every tenth generated hint lost its type
    even = F.col("_ord") % 2 == 0
    return hints.where(even), hints.where(~even).withColumn("Type", F.when(F.col("_ord") % 10 != 1, F.col("Type")))


SIDES = f"""{WITH_V},
 hints AS (SELECT Filename, Class, FunctionName, LineNo AS ColumnOffset, Category, VarName, Type, _ord FROM v),
 o AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS7} ORDER BY _ord) AS occ FROM hints WHERE _ord % 2 = 0),
 g AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS7} ORDER BY _ord) AS occ FROM (
   SELECT * REPLACE (CASE WHEN _ord % 10 <> 1 THEN Type END AS Type) FROM hints WHERE _ord % 2 = 1)),
 both_sides AS (SELECT o.*, g._ord AS g_ord FROM o JOIN g ON {_same('o', 'g', [*HINT7, 'occ'])}),
 o2 AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS6} ORDER BY _ord) AS occ2 FROM o
   WHERE _ord NOT IN (SELECT _ord FROM both_sides)),
 g2 AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS6} ORDER BY _ord) AS occ2 FROM g
   WHERE _ord NOT IN (SELECT g_ord FROM both_sides)),
 m AS (
  SELECT {_KEYS6}, Type AS OriginalType, Type AS GeneratedType, true AS Completeness, true AS Correctness,
    _ord AS _ord_original, g_ord AS _ord_generated FROM both_sides
  UNION ALL
  SELECT {', '.join(f'coalesce(o2.{k}, g2.{k})' for k in HINT6)}, o2.Type, g2.Type,
    CASE WHEN o2.Type IS NOT NULL THEN g2.Type IS NOT NULL END, CASE WHEN o2.Type IS NOT NULL THEN false END,
    o2._ord, g2._ord
  FROM o2 FULL OUTER JOIN g2 ON {_same('o2', 'g2', [*HINT6, 'occ2'])})"""

_RATES = """rates AS (SELECT Filename,
   count(*) FILTER (Completeness) / count(*)::DOUBLE AS completeness_rate,
   coalesce(count(*) FILTER (Correctness) / nullif(count(*) FILTER (Completeness), 0)::DOUBLE, 0) AS correctness_rate
 FROM m WHERE Completeness IS NOT NULL GROUP BY Filename)"""


def metrics(spark, sf_dir: str) -> DataFrame:
    return matching.match_hints(*hint_sides(spark, sf_dir))


def exact_only(spark, sf_dir: str) -> DataFrame:
    return matching.match_exact(*hint_sides(spark, sf_dir)).drop("__occurrence")


def mapped(spark, sf_dir: str) -> DataFrame:
    original, generated = hint_sides(spark, sf_dir)
    renamed = generated.withColumn("Filename", F.concat(F.lit("out/"), F.col("Filename")))
    names = {f"out/pkg/m{i}.py": f"pkg/m{i}.py" for i in range(3)}
    return matching.match_hints(original, renamed, filenames=names)


def occurrences(spark, sf_dir: str) -> DataFrame:
    """Number of every row among its copies, chunks much shorter than the table."""
    rows = observed(spark, sf_dir)
    return ordered.occurrence_number(rows, OBS9, "occurrence", chunk_rows=1000).select("_ord", "occurrence")


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def _top(rate: str, lowest: bool):
    return lambda spark, sf_dir: _rounded(matching.top_files(matching.file_rates(by_variable(spark, sf_dir)), rate, lowest))


def by_variable(spark, sf_dir: str) -> DataFrame:
    """Metrics with the variable standing in for the file, to have more than a few of them."""
    original, generated = (side.withColumn("Filename", F.col("VarName")) for side in hint_sides(spark, sf_dir))
    return matching.match_hints(original, generated)


SIDES_BY_VARIABLE = SIDES.replace("hints AS (SELECT Filename,", "hints AS (SELECT VarName AS Filename,")


def _top_sql(rate: str, lowest: bool) -> str:
    return f"""{SIDES_BY_VARIABLE}, {_RATES} SELECT Filename, round(completeness_rate, 6) AS completeness_rate,
        round(correctness_rate, 6) AS correctness_rate FROM rates
        ORDER BY {rate} {'ASC' if lowest else 'DESC'}, Filename LIMIT 5"""


def _event_rows(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("_ord"), "user_id", "event_type")


def changed(spark, sf_dir: str) -> DataFrame:
    rows = _event_rows(spark, sf_dir).withColumn("variable", F.col("_ord") % 3)
    return changes.changed_values(rows, ["user_id"], "variable", "event_type", chunk_rows=5000)


def changed_snapshots(spark, sf_dir: str) -> DataFrame:
    """Variables may be missing from a snapshot and come back."""
    rows = _event_rows(spark, sf_dir).select(
        "_ord",
        (F.col("user_id") % 10).alias("scope"),
        (F.col("user_id") % 7).alias("variable"),
        F.expr("_ord div 25").alias("snapshot"),
        (F.col("event_type") == "view").alias("value"),
    )
    return changes.changed_values(rows, ["scope"], "variable", "value", snapshot="snapshot", chunk_rows=5000)


def lines(spark, sf_dir: str) -> DataFrame:
    rows = _event_rows(spark, sf_dir).select("_ord", "user_id", (F.col("_ord") % 40).alias("LineNo"))
    return changes.attributed_lines(rows, ["user_id"], chunk_rows=5000)


def _loop_rows(spark, sf_dir: str) -> DataFrame:
    rows = _event_rows(spark, sf_dir).select(
        "_ord", (F.col("user_id") % 10).alias("loop"), "user_id", "event_type", (F.col("event_type") == "view").alias("is_head")
    )
    numbered = changes.numbered_iterations(rows, ["loop"], "is_head", chunk_rows=5000)
    # what precedes the first head lies outside the loop
    return numbered.withColumn("iteration", F.when(F.col("iteration") >= 0, F.col("iteration")))


def gated(spark, sf_dir: str) -> DataFrame:
    rows = _loop_rows(spark, sf_dir)
    found = changes.until_stable_loops(rows, ["loop"], ["user_id", "event_type"], is_head="is_head", chunk_rows=50)
    return found.drop("is_head")


LOOPS_SQL = """WITH e AS (SELECT event_id AS _ord, user_id % 10 AS loop, user_id, event_type FROM events),
 n AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY loop ORDER BY _ord)::BIGINT - 1 AS it FROM e),
 r AS (SELECT _ord, loop, user_id, event_type, CASE WHEN it >= 0 THEN it END AS iteration FROM n)"""

GATED_SQL = f"""{LOOPS_SQL},
 firsts AS (SELECT loop, user_id, event_type, min(iteration) AS news FROM r WHERE iteration IS NOT NULL GROUP BY ALL),
 its AS (SELECT loop, iteration, max(CASE WHEN iteration IN (SELECT news FROM firsts f WHERE f.loop = r.loop) THEN iteration END) AS news
   FROM r WHERE iteration IS NOT NULL GROUP BY loop, iteration),
 quiet AS (SELECT loop, iteration, iteration - 1 - coalesce(max(news) OVER (PARTITION BY loop ORDER BY iteration
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS without_news FROM its),
 ends AS (SELECT loop, min(iteration) AS last FROM quiet WHERE without_news >= 5 GROUP BY loop)
 SELECT r.* FROM r LEFT JOIN ends USING (loop) WHERE r.iteration IS NULL OR last IS NULL OR r.iteration < last
   OR (r.iteration = last AND event_type = 'view')"""


def updates(spark, sf_dir: str) -> DataFrame:
    """One update batch per event, with one to three variables."""
    event, user = F.col("event_id"), F.col("user_id")

    def ref(module, label):
        return F.struct(module.cast("string").alias("module"), label.alias("type"))

    pairs = F.array_compact(
        F.array(
            F.struct(F.lit("a").alias("key"), ref(F.lit(None), F.col("event_type")).alias("value")),
            F.when(event % 2 == 0, F.struct(F.lit("b").alias("key"), ref(F.lit("shop"), F.lit("Cart")).alias("value"))),
            F.when(event % 3 == 0, F.struct(F.lit("c").alias("key"), ref(F.lit("shop"), F.lit("Item")).alias("value"))),
        )
    )
    return table(spark, sf_dir, "events").select(
        event.alias("_ord"),
        F.lit("pkg/a.py").alias("Filename"),
        F.when(user % 2 == 0, "pkg.a").alias("ClassModule"),
        F.when(user % 2 == 0, "C").alias("Class"),
        F.concat(F.lit("f"), (user % 20).cast("string")).alias("FunctionName"),
        (10 + user % 50).alias("LineNo"),
        (1 + event % 5).alias("Category"),
        F.map_from_entries(pairs).alias("names2types"),
    )


UPDATES_SQL = """WITH e AS (SELECT *, 1 + event_id % 5 AS cat FROM events),
 names AS (SELECT e.*, 'a' AS VarName, NULL AS TypeModule, event_type AS Type FROM e
  UNION ALL SELECT e.*, 'b', 'shop', 'Cart' FROM e WHERE event_id % 2 = 0
  UNION ALL SELECT e.*, 'c', 'shop', 'Item' FROM e WHERE event_id % 3 = 0)
 SELECT 'pkg/a.py' AS Filename, CASE WHEN cat <> 5 AND user_id % 2 = 0 THEN 'pkg.a' END AS ClassModule,
  CASE WHEN cat <> 5 AND user_id % 2 = 0 THEN 'C' END AS Class,
  CASE WHEN cat < 4 THEN 'f' || CAST(user_id % 20 AS VARCHAR) END AS FunctionName,
  CASE WHEN cat < 3 THEN 10 + user_id % 50 ELSE 0 END AS LineNo, cat AS Category, VarName, TypeModule, Type,
  event_id AS _ord FROM names"""


def vectors(spark, sf_dir: str) -> DataFrame:
    """Timing vectors; some have the wrong length."""
    four = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("run"),
        F.when(F.col("l_linenumber") == 3, F.slice(four, 1, 3)).otherwise(four).alias("times"),
    )


def pairs(spark, sf_dir: str) -> DataFrame:
    return timings.timing_pairs(valid_timings(vectors(spark, sf_dir)))


PAIRS_SQL = """WITH t AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS run, l_quantity AS bare,
   l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_linenumber <> 3),
 p AS (SELECT run, 'no_op' AS series, bare, l_extendedprice AS time, l_extendedprice / bare AS ratio FROM t
  UNION ALL SELECT run, 'full', bare, l_discount, l_discount / bare FROM t
  UNION ALL SELECT run, 'optimised', bare, l_tax, l_tax / bare FROM t)"""

QUERIES = {
    "metrics_match": (metrics, f"{SIDES} SELECT * FROM m"),
    "metrics_match_exact": (
        exact_only,
        f"""{SIDES} SELECT {', '.join(f'coalesce(o.{k}, g.{k}) AS {k}' for k in HINT7)}, o._ord AS _ord_original,
          g._ord AS _ord_generated, CASE WHEN o._ord IS NULL THEN 'generated' WHEN g._ord IS NULL THEN 'original'
          ELSE 'both' END AS side FROM o FULL OUTER JOIN g ON {_same('o', 'g', [*HINT7, 'occ'])}""",
    ),
    "metrics_left_over": (
        lambda spark, sf_dir: exact_only(spark, sf_dir).where(F.col("side") != "both").select(*HINT7, "side"),
        f"""{SIDES} SELECT {_KEYS7}, 'original' AS side FROM o2 UNION ALL SELECT {_KEYS7}, 'generated' FROM g2""",
    ),
    "metrics_match_mapped_files": (mapped, f"{SIDES} SELECT * FROM m"),
    "metrics_ignore_null_types": (
        lambda spark, sf_dir: matching.match_hints(
            *[side.withColumn("Type", F.when(F.col("_ord") % 4 > 1, F.col("Type"))) for side in hint_sides(spark, sf_dir)],
            null_types="ignore",
        ).select("OriginalType", "GeneratedType", "Completeness", "Correctness", "_ord_original", "_ord_generated"),
        SIDES.replace(
            "hints AS (SELECT Filename, Class, FunctionName, LineNo AS ColumnOffset, Category, VarName, Type,",
            "hints AS (SELECT Filename, Class, FunctionName, LineNo AS ColumnOffset, Category, VarName, "
            "CASE WHEN _ord % 4 > 1 THEN Type END AS Type,",
        )
        + """ SELECT OriginalType, GeneratedType, CASE WHEN OriginalType IS NOT NULL THEN Completeness END AS Completeness,
          CASE WHEN OriginalType IS NOT NULL THEN Correctness END AS Correctness, _ord_original, _ord_generated FROM m""",
    ),
    "metrics_report_order": (
        lambda spark, sf_dir: matching.metrics_table(matching.in_report_order(metrics(spark, sf_dir))),
        f"""{SIDES} SELECT {_KEYS6}, OriginalType, GeneratedType, Completeness, Correctness FROM m
          ORDER BY _ord_original NULLS LAST, _ord_generated NULLS LAST""",
    ),
    "metrics_scored_rows": (
        lambda spark, sf_dir: matching.has_original(metrics(spark, sf_dir)).select("_ord_original", "Correctness"),
        f"{SIDES} SELECT _ord_original, Correctness FROM m WHERE Completeness IS NOT NULL",
    ),
    "metrics_totals": (
        lambda spark, sf_dir: _rounded(matching.total_scores(metrics(spark, sf_dir))),
        f"""{SIDES} SELECT round(count(*) FILTER (Completeness) / count(Completeness)::DOUBLE, 6) AS completeness,
          round(count(*) FILTER (Correctness) / count(*) FILTER (Completeness)::DOUBLE, 6) AS correctness FROM m""",
    ),
    "metrics_status_counts": (
        lambda spark, sf_dir: _rounded(matching.status_counts(metrics(spark, sf_dir))),
        f"""{SIDES}, c AS (SELECT count(*) AS n_rows, count(Completeness) AS n_original,
            count(*) FILTER (Completeness) AS n_matched FROM m)
          SELECT *, n_original - n_matched AS n_only_original, n_rows - n_original AS n_only_generated,
            n_matched + n_rows - n_original AS n_generated, round(n_matched / n_rows::DOUBLE, 6) AS share_matched,
            round((n_original - n_matched) / n_rows::DOUBLE, 6) AS share_only_original,
            round((n_rows - n_original) / n_rows::DOUBLE, 6) AS share_only_generated FROM c""",
    ),
    "metrics_file_rates": (
        lambda spark, sf_dir: _rounded(matching.file_rates(metrics(spark, sf_dir))),
        f"""{SIDES}, {_RATES} SELECT Filename, round(completeness_rate, 6) AS completeness_rate,
          round(correctness_rate, 6) AS correctness_rate FROM rates""",
    ),
    **{
        f"metrics_{'lowest' if lowest else 'highest'}_{rate}": (_top(f"{rate}_rate", lowest), _top_sql(f"{rate}_rate", lowest))
        for rate in ("completeness", "correctness")
        for lowest in (True, False)
    },
    "occurrence_numbers": (
        occurrences,
        f"""{WITH_V} SELECT _ord, row_number() OVER (PARTITION BY {', '.join(OBS9)} ORDER BY _ord) - 1 AS occurrence FROM v""",
    ),
    "events_changed": (
        changed,
        """SELECT _ord, user_id, event_type, variable FROM (
          SELECT event_id AS _ord, user_id, event_type, event_id % 3 AS variable,
            row_number() OVER w AS rn, lag(event_type) OVER w AS before FROM events
          WINDOW w AS (PARTITION BY user_id, event_id % 3 ORDER BY event_id))
        WHERE rn = 1 OR before <> event_type""",
    ),
    "events_changed_snapshots": (
        changed_snapshots,
        """WITH e AS (SELECT event_id AS _ord, user_id % 10 AS scope, user_id % 7 AS variable, event_id // 25 AS snapshot,
            event_type = 'view' AS value FROM events)
        SELECT _ord, scope, variable, snapshot, value FROM (
          SELECT *, row_number() OVER w AS rn, lag(value) OVER w AS before, lag(snapshot) OVER w AS before_snapshot FROM e
          WINDOW w AS (PARTITION BY scope, variable ORDER BY _ord))
        WHERE rn = 1 OR before <> value OR before_snapshot < snapshot - 1""",
    ),
    "events_attributed_lines": (
        lines,
        """SELECT event_id AS _ord, user_id, event_id % 40 AS LineNo,
          coalesce(lag(event_id % 40) OVER (PARTITION BY user_id ORDER BY event_id), event_id % 40) AS AttributedLine
        FROM events""",
    ),
    "events_iterations": (
        lambda spark, sf_dir: _loop_rows(spark, sf_dir).drop("is_head"),
        f"{LOOPS_SQL} SELECT * FROM r",
    ),
    "events_until_stable": (gated, GATED_SQL),
    "events_flatten_updates": (lambda spark, sf_dir: changes.flatten_updates(updates(spark, sf_dir)), UPDATES_SQL),
    "timings_valid": (
        lambda spark, sf_dir: valid_timings(vectors(spark, sf_dir)).select("run", F.col("times")[3].alias("optimised")),
        "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS run, l_tax AS optimised FROM lineitem "
        "WHERE l_linenumber <> 3",
    ),
    "timings_pairs": (
        pairs,
        f"{PAIRS_SQL} SELECT * FROM p",
    ),
    "timings_summary": (
        lambda spark, sf_dir: _rounded(timings.timing_summary(pairs(spark, sf_dir))).drop(
            *[f"p{p}_ratio" for p in timings.PERCENTILES]  # not exact
        ),
        f"{PAIRS_SQL} SELECT series, count(*) AS n_runs, round(avg(time), 6) AS mean_time, round(avg(ratio), 6) AS mean_ratio, "
        "round(min(ratio), 6) AS min_ratio, "
        "round(max(ratio), 6) AS max_ratio FROM p GROUP BY series",
    ),
    "timings_percentiles": (
        lambda spark, sf_dir: _rounded(timings.timing_percentiles(pairs(spark, sf_dir))),
        f"{PAIRS_SQL} SELECT series, "
        + ", ".join(f"round(quantile_cont(ratio, {p / 100}), 6) AS p{p}_ratio" for p in timings.PERCENTILES)
        + " FROM p GROUP BY series",
    ),
}
