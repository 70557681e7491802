"""Observation-shaped views of the given tables, for Spark and as SQL text.

The given tables hold no observations. The SQL below reads in both engines, so
a query and its check start from the same rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from siftmill.schemas import HIERARCHY

OBSERVED_COLUMNS = [
    "event_id AS _ord",
    "'pkg/m' || CAST(user_id % 3 AS STRING) || '.py' AS Filename",
    "CASE WHEN user_id % 5 = 4 OR user_id % 3 = 0 THEN NULL "
    "ELSE 'pkg.m' || CAST(user_id % 3 AS STRING) END AS ClassModule",
    "CASE WHEN user_id % 5 = 4 OR user_id % 3 = 0 THEN NULL ELSE 'C' || CAST(user_id % 7 AS STRING) END AS Class",
    "CASE WHEN user_id % 5 >= 3 THEN NULL WHEN user_id % 11 = 0 THEN 'test_f' "
    "ELSE 'f' || CAST(user_id % 20 AS STRING) END AS FunctionName",
    "CASE WHEN user_id % 5 >= 2 THEN 0 ELSE 10 + user_id % 50 END AS LineNo",
    "1 + user_id % 5 AS Category",
    "'v' || CAST(user_id % 100 AS STRING) AS VarName",
    "CASE WHEN user_id % 4 = 2 THEN NULL ELSE 'shop.model' END AS TypeModule",
    "CASE user_id % 4 WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN 'View' ELSE 'Click' END "
    "WHEN 1 THEN CASE WHEN event_type = 'view' THEN 'Interaction' ELSE 'Click' END "
    "WHEN 2 THEN CASE WHEN event_type = 'view' THEN 'int' ELSE 'str' END ELSE 'Purchase' END AS Type",
]
OBSERVED_SQL = f"SELECT {', '.join(OBSERVED_COLUMNS)} FROM events"

# (module, type, bases as (module, type) from itself to the root)
HIERARCHY_ROWS = [
    ("shop.model", "Click", [("shop.model", "Click"), ("shop.model", "Interaction"), (None, "object")]),
    ("shop.model", "View", [("shop.model", "View"), ("shop.model", "Interaction"), (None, "object")]),
    ("shop.model", "Interaction", [("shop.model", "Interaction"), (None, "object")]),
    ("shop.model", "Purchase", [("shop.model", "Purchase"), (None, "object")]),
    (None, "int", [(None, "int"), (None, "object")]),
    (None, "str", [(None, "str"), (None, "object")]),
]

HIERARCHY_EDGES_SQL = """
SELECT * FROM (VALUES
 ('shop.model', 'Click', 'shop.model', 'Click', 0), ('shop.model', 'Click', 'shop.model', 'Interaction', 1),
 ('shop.model', 'View', 'shop.model', 'View', 0), ('shop.model', 'View', 'shop.model', 'Interaction', 1),
 ('shop.model', 'Interaction', 'shop.model', 'Interaction', 0),
 ('shop.model', 'Purchase', 'shop.model', 'Purchase', 0),
 (NULL, 'int', NULL, 'int', 0), (NULL, 'str', NULL, 'str', 0)
) AS h(module, type, base_module, base_type, place)
"""


# Schemas of the tables the queries read, so that no file is opened to infer them.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed_rows(table(spark, sf_dir, "events"))


def observed_rows(events: DataFrame) -> DataFrame:
    """The view over a table or a stream of events."""
    return events.selectExpr(*OBSERVED_COLUMNS)


def hierarchy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HIERARCHY_ROWS, HIERARCHY)
