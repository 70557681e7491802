"""Queries of the filters, predicates, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftmill.catalog.reducing import WITH_V
from siftmill.catalog.views import observed, table
from siftmill.functions.hashing import content_hash
from siftmill.functions.names import null_if_builtin, outermost, path_to_module, union_members
from siftmill.functions import typenames
from siftmill.operators import filters
from siftmill.schemas import HINTS, OBS9, ORD, Category, category_name, conform

_OBS9 = ", ".join(OBS9)
_ROWS = f"SELECT {_OBS9}, _ord FROM"


def _view(operator):
    return lambda spark, sf_dir: operator(observed(spark, sf_dir)).select(*OBS9, ORD)


# A file listing: one file per event. Projects, folders and names vary by id.
LISTING_SQL = """
SELECT event_id,
 'p' || CAST(user_id % 40 AS STRING) AS project,
 CASE event_id % 9 WHEN 0 THEN 'tests/' WHEN 1 THEN 'p' || CAST(user_id % 40 AS STRING) || '/test/' WHEN 2 THEN 'src/'
   WHEN 3 THEN 'testing/deep/' WHEN 4 THEN 'p1/tests/' WHEN 5 THEN 'docs/tests/' ELSE '' END
 || CASE event_id % 7 WHEN 0 THEN 'test_' ELSE '' END
 || CASE WHEN event_id % 11 = 0 THEN '__init__' ELSE 'mod' || CAST(event_id % 50 AS STRING) END
 || CASE event_id % 5 WHEN 0 THEN '_test.py' WHEN 1 THEN '.txt' ELSE '.py' END AS path
FROM events
"""


def listing(spark, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("siftmill_events")
    return spark.sql(LISTING_SQL.replace("FROM events", "FROM siftmill_events"))


PROJECT_FILES_SQL = """
SELECT 'p' || CAST(user_id AS STRING) AS project,
 CASE event_id % 8 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'requirements-dev.txt' WHEN 2 THEN 'pyproject.toml'
   WHEN 3 THEN 'sub/pytest.ini' WHEN 4 THEN 'setup.cfg'
   ELSE CASE WHEN user_id % 29 = 0 AND event_id % 40 = 7 THEN 'pytest.ini' ELSE 'a.py' END END AS path,
 CASE WHEN event_id % 8 = 2 THEN
   '[tool.poetry]' || chr(10) || 'name = "x"' || chr(10) || '[tool.poetry.dev-dependencies]' || chr(10) || 'mypy = "1"' || chr(10)
   || CASE WHEN user_id % 13 = 0 AND event_id % 32 = 2 THEN 'pytest = "7"' || chr(10) ELSE '' END
   || '[tool.' || CASE WHEN user_id % 17 = 0 AND event_id % 32 = 10 THEN 'pytest.ini_options' ELSE 'black' END || ']' || chr(10)
   || 'pytest = 1' || chr(10)
 ELSE 'numpy' || chr(10) || CASE WHEN user_id % 7 = 0 AND event_id % 48 = 1 THEN 'pytest>=7' ELSE ' pytest' END || chr(10)
 END AS content
FROM events
"""


def project_files(spark, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("siftmill_events")
    return spark.sql(PROJECT_FILES_SQL.replace("FROM events", "FROM siftmill_events"))


def predicates(spark, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return listing(spark, sf_dir).select(
        "event_id",
        "path",
        filters.is_test_file(path).alias("is_test"),
        filters.is_hintable_file(path).alias("is_hintable"),
        path_to_module(path).alias("module"),
    )


def relative(spark, sf_dir: str) -> DataFrame:
    return filters.relative_to(listing(spark, sf_dir), "path", "tests").select("event_id", "path")


ORIGIN_SQL = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'builtins' ELSE 'm' || CAST(user_id AS STRING) END AS module,
 CASE event_id % 6 WHEN 1 THEN NULL WHEN 2 THEN '/lib/py/' WHEN 3 THEN '/work/proj/' WHEN 4 THEN '/lib/py/site/' ELSE '/tmp/' END
  || 'pkg/m' || CAST(user_id AS STRING) || '.py' AS file
FROM events
"""


def origins(spark, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("siftmill_events")
    rows = spark.sql(ORIGIN_SQL.replace("FROM events", "FROM siftmill_events"))
    roots = [("project", "/work/proj"), ("third_party", "/lib/py/site"), ("stdlib", "/lib/py")]
    found = filters.origin_of_type(F.col("module"), F.col("file"), roots)
    return rows.select("event_id", found["origin"].alias("origin"), found["module"].alias("found_module"))


# type names with unions at several depths, built from two labels of an event
_A = "CASE event_id % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'str' ELSE 'shop.' || event_type END"
_B = "CASE user_id % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'None' ELSE 'Any' END"
TYPE_NAMES_SQL = f"""
SELECT event_id, {_A} AS a, {_B} AS b,
 CASE event_id % 6 WHEN 0 THEN {_A} WHEN 1 THEN {_A} || ' | ' || {_B} || ' | int'
  WHEN 2 THEN 'typing.Union[' || {_A} || ', Union[' || {_B} || ', str]]'
  WHEN 3 THEN 'Optional[' || {_A} || '] | ' || {_B}
  WHEN 4 THEN 'dict[' || {_A} || ' | ' || {_B} || ', list[typing.Optional[' || {_B} || ']]]'
  ELSE 'Callable[[' || {_A} || ', ' || {_B} || '], Union[' || {_B} || ']]' END AS name
FROM events
"""


def _sorted(*members: str) -> str:
    return f"array_to_string(list_sort(list_distinct([{', '.join(members)}])), ' | ')"


NORMALIZED_SQL = f"""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN a WHEN 1 THEN {_sorted('a', 'b', "'int'")}
  WHEN 2 THEN {_sorted('a', 'b', "'str'")} WHEN 3 THEN {_sorted('a', 'b', "'None'")}
  WHEN 4 THEN 'dict[' || {_sorted('a', 'b')} || ', list[' || {_sorted('b', "'None'")} || ']]'
  ELSE 'Callable[[' || a || ', ' || b || '], ' || b || ']' END AS normal
FROM ({TYPE_NAMES_SQL})
"""


def type_names(spark, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("siftmill_events")
    return spark.sql(TYPE_NAMES_SQL.replace("FROM events", "FROM siftmill_events"))


def normalized(spark, sf_dir: str) -> DataFrame:
    return typenames.with_normal_type(type_names(spark, sf_dir), "name").select("event_id", "normal")


def split_names(spark, sf_dir: str) -> DataFrame:
    rows = typenames.with_parts(type_names(spark, sf_dir), "name")
    return rows.select("event_id", F.size("parts").cast("long").alias("n_parts"), F.col("parts")[0].alias("head"))


# every seventh name has a bracket too many or too few
BROKEN_NAMES_SQL = f"""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'list[' || name WHEN event_id % 7 = 1 THEN name || ']' ELSE name END AS name
FROM ({TYPE_NAMES_SQL})
"""


def broken_names(spark, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("siftmill_events")
    rows = spark.sql(BROKEN_NAMES_SQL.replace("FROM events", "FROM siftmill_events"))
    return typenames.name_errors(rows, "name")


SPLIT_SQL = f"""
SELECT event_id, CASE event_id % 6 WHEN 1 THEN 3 WHEN 3 THEN 2 ELSE 1 END::BIGINT AS n_parts,
 CASE event_id % 6 WHEN 1 THEN a || ' ' WHEN 3 THEN 'Optional[' || a || '] ' ELSE name END AS head
FROM ({TYPE_NAMES_SQL})
"""


def united_members(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat_ws(",", F.lit("m1"), F.when(F.col("event_id") % 2 == 0, "").otherwise("m2")).alias("TypeModule"),
        F.concat_ws(" | ", F.lit("Outer.Inner"), "event_type", F.when(F.col("event_id") % 3 == 0, "Third")).alias("Type"),
    )
    exploded = rows.select("event_id", F.posexplode(union_members(F.col("TypeModule"), F.col("Type"))).alias("place", "m"))
    return exploded.select(
        "event_id",
        F.col("place").cast("long").alias("place"),
        F.col("m.module").alias("module"),
        outermost(F.col("m.type")).alias("outer_type"),
    )


def names(spark, sf_dir: str) -> DataFrame:
    module = F.when(F.col("event_id") % 4 == 0, "builtins").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", null_if_builtin(module).alias("module"))


def categories(spark, sf_dir: str) -> DataFrame:
    named = observed(spark, sf_dir).withColumn("name", category_name(F.col("Category")))
    return named.groupBy("Category", "name").agg(F.count(F.lit(1)).alias("n"))


def as_hints(spark, sf_dir: str) -> DataFrame:
    renamed = observed(spark, sf_dir).withColumn("ColumnOffset", F.col("LineNo").cast("string"))
    return conform(renamed, HINTS)


def mapped_by_table(spark, sf_dir: str) -> DataFrame:
    rows = observed(spark, sf_dir)
    mapping = rows.where(F.col("Filename") != "pkg/m1.py").groupBy(F.col("Filename").alias("generated")).agg(
        F.concat(F.lit("orig/"), F.first("Filename")).alias("original")
    )
    return filters.map_filenames(rows, mapping).select(*OBS9, ORD)


def hashed(spark, sf_dir: str) -> DataFrame:
    per_file = content_hash(observed(spark, sf_dir), OBS9, ["Filename"], digest="md5")
    return per_file.select("Filename", F.col("content_hash").cast("string").alias("content_hash"), "n_rows")


_DIGITS = ", chr(31), ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in OBS9)

QUERIES = {
    "filter_drop_test": (
        _view(lambda df: filters.drop_test_functions(df, "test_")),
        f"{WITH_V} {_ROWS} v WHERE FunctionName IS NULL OR NOT starts_with(FunctionName, 'test_')",
    ),
    "filter_drop_test_pattern": (
        _view(lambda df: filters.drop_test_functions(df, r"(test|f\d)_?\d*$")),
        rf"{WITH_V} {_ROWS} v WHERE FunctionName IS NULL OR NOT regexp_matches(FunctionName, '^(?:(test|f\d)_?\d*$)')",
    ),
    "filter_drop_own": (
        _view(lambda df: filters.drop_own_rows(df, ["C1", "C2"], ["f1", "f2", "f16"])),
        f"{WITH_V} {_ROWS} v WHERE NOT (coalesce(Class IN ('C1', 'C2'), false) "
        "AND coalesce(FunctionName IN ('f1', 'f2', 'f16'), false))",
    ),
    "filter_files": (
        predicates,
        f"""WITH l AS ({LISTING_SQL}), n AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM l)
        SELECT event_id, path,
          CASE WHEN base LIKE 'test\\_%' ESCAPE '\\' THEN base LIKE '%.py'
            ELSE base LIKE '%\\_test.py' ESCAPE '\\' END AS is_test,
          NOT ends_with(base, '__init__.py') AS is_hintable,
          regexp_replace(replace(path, '/', '.'), '\\.[^.]*$', '') AS module FROM n""",
    ),
    "filter_inside_project": (
        relative,
        f"WITH l AS ({LISTING_SQL}) SELECT event_id, substr(path, 7) AS path FROM l WHERE starts_with(path, 'tests/')",
    ),
    "filter_test_function_names": (
        _view(lambda df: df.where(filters.is_test_function(F.col("FunctionName")))),
        f"{WITH_V} {_ROWS} v WHERE FunctionName LIKE 'test\\_%' ESCAPE '\\'",
    ),
    "filter_line_range": (
        _view(lambda df: df.where(filters.in_line_range(F.col("LineNo"), 12, 30))),
        f"{WITH_V} {_ROWS} v WHERE LineNo >= 12 AND LineNo <= 30",
    ),
    "filter_importable": (
        _view(lambda df: filters.needs_import(df.withColumn("TypeModule", F.coalesce("ClassModule", "TypeModule")))),
        f"""{WITH_V}, w AS (SELECT * REPLACE (coalesce(ClassModule, TypeModule) AS TypeModule) FROM v)
        {_ROWS} w WHERE TypeModule IS NOT NULL AND TypeModule <> replace(replace(Filename, '.py', ''), '/', '.')""",
    ),
    "rename_none_type": (
        _view(
            lambda df: filters.rename_none_type(
                df.withColumn("Type", F.when(F.col("_ord") % 3 == 0, "NoneType").otherwise(F.col("Type")))
            )
        ),
        f"""{WITH_V} SELECT * REPLACE (CASE WHEN _ord % 3 = 0 THEN
            CASE WHEN TypeModule IS NULL THEN 'None' ELSE 'NoneType' END ELSE Type END AS Type) FROM v""",
    ),
    "map_filenames_literal": (
        _view(lambda df: filters.map_filenames(df, {"pkg/m1.py": "a.py", "pkg/m2.py": "b.py"})),
        f"""{WITH_V} SELECT * REPLACE (CASE Filename WHEN 'pkg/m1.py' THEN 'a.py' WHEN 'pkg/m2.py' THEN 'b.py'
            ELSE Filename END AS Filename) FROM v""",
    ),
    "map_filenames_table": (
        mapped_by_table,
        f"""{WITH_V} SELECT * REPLACE (CASE Filename WHEN 'pkg/m1.py' THEN Filename
            ELSE 'orig/' || Filename END AS Filename) FROM v""",
    ),
    "conform_hints": (
        as_hints,
        f"{WITH_V} SELECT Filename, Class, FunctionName, LineNo AS ColumnOffset, Category, VarName, Type, _ord FROM v",
    ),
    "category_names": (
        categories,
        f"""{WITH_V} SELECT Category, CASE Category WHEN 1 THEN 'LOCAL_VARIABLE' WHEN 2 THEN 'FUNCTION_PARAMETER'
            WHEN 3 THEN 'FUNCTION_RETURN' WHEN 4 THEN 'CLASS_MEMBER' ELSE 'GLOBAL_VARIABLE' END AS name,
            count(*) AS n FROM v GROUP BY ALL""",
    ),
    "filter_category": (
        _view(lambda df: filters.of_category(df, Category.CLASS_MEMBER)),
        f"{WITH_V} {_ROWS} v WHERE Category = 4",
    ),
    "type_origin": (
        origins,
        f"""WITH o AS ({ORIGIN_SQL}) SELECT event_id,
          CASE event_id % 6 WHEN 0 THEN 'builtin' WHEN 1 THEN 'fileless' WHEN 2 THEN 'stdlib' WHEN 3 THEN 'project'
            WHEN 4 THEN 'third_party' END AS origin,
          CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN module WHEN 5 THEN NULL ELSE 'pkg.' || module END AS found_module
          FROM o""",
    ),
    "test_folders": (
        lambda spark, sf_dir: filters.test_folders(listing(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long")),
        f"""WITH l AS ({LISTING_SQL}), f AS (
          SELECT project, split_part(path, '/', 1) AS folder, list_position(['tests', 'test', 'testing'], split_part(path, '/', 1)) * 2 - 2 AS rank
          FROM l WHERE path LIKE '%/%' AND split_part(path, '/', 1) IN ('tests', 'test', 'testing')
          UNION ALL
          SELECT project, project || '/' || split_part(path, '/', 2), list_position(['tests', 'test', 'testing'], split_part(path, '/', 2)) * 2 - 1
          FROM l WHERE path LIKE '%/%/%' AND split_part(path, '/', 1) = project AND split_part(path, '/', 2) IN ('tests', 'test', 'testing'))
        SELECT project, folder, rank::BIGINT AS rank, count(*) AS n_files FROM f GROUP BY ALL""",
    ),
    "uses_pytest": (
        lambda spark, sf_dir: filters.projects_using_pytest(project_files(spark, sf_dir)),
        f"""WITH f AS ({PROJECT_FILES_SQL}) SELECT project, bool_or(path = 'pytest.ini'
          OR (path = 'pyproject.toml' AND (contains(content, '[tool.pytest') OR contains(content, 'pytest = "7"')))
          OR (path IN ('requirements.txt', 'requirements-dev.txt') AND contains(content, 'pytest>'))) AS uses_pytest
        FROM f GROUP BY project""",
    ),
    "normalize_type": (normalized, NORMALIZED_SQL),
    "split_top_level": (split_names, SPLIT_SQL),
    "normalize_type_errors": (
        broken_names,
        f"SELECT name, 'brackets do not match' AS error, count(*) AS n FROM ({BROKEN_NAMES_SQL}) WHERE event_id % 7 < 2 GROUP BY name",
    ),
    "united_members": (
        united_members,
        """WITH r AS (SELECT event_id, 0::BIGINT AS place, 'm1' AS module, 'Outer' AS outer_type FROM events
          UNION ALL SELECT event_id, 1, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'm2' END, event_type FROM events)
        SELECT * FROM r""",
    ),
    "null_if_builtin": (
        names,
        "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS module FROM events",
    ),
    "content_hash": (
        hashed,
        f"""{WITH_V}, d AS (SELECT Filename, md5({_DIGITS.replace(', chr(31), ', ' || chr(31) || ')}) AS h FROM v)
        SELECT Filename, CAST(sum(('0x' || substr(h, 1, 15))::BIGINT) AS VARCHAR) AS content_hash, count(*) AS n_rows
        FROM d GROUP BY Filename""",
    ),
}
