"""Row filters and predicates."""

from __future__ import annotations

import re
import tomllib
import warnings
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftmill.functions.names import path_to_module
from siftmill.schemas import Category

# Pattern of test functions, names of test folders in the order
# in which they are looked for, and the files that show that a project uses
# the test runner.
TEST_FUNCTION_PREFIX = "test_"
TEST_FOLDERS = ["tests", "test", "testing"]


def java_pattern(pattern: str) -> str:
    """A regular expression of Python's, in the spelling that means the same in Java.

    Translated: ``\\Z``, ``{,n}``, and ``[`` and ``&&`` in character classes.
    Line ends are ``\\n`` only and classes know all of Unicode. What Java has no
    counterpart for is refused.
    """
    if pattern is None:
        raise ValueError("a pattern is needed")
    with warnings.catch_warnings():
        # signs that Python may read differently one day mean today what is translated here
        warnings.simplefilter("ignore", FutureWarning)
        re.compile(pattern)
    refused = re.search(r"\(\?(?:P|\(|[a-zA-Z]*[aLux])|\\(?:0|U|N)", re.sub(r"\\\\", "", pattern))
    if refused:
        raise ValueError(f"{refused[0]} is not supported: {pattern}")
    out, place, in_class = [], 0, False
    while place < len(pattern):
        part = pattern[place : place + 2] if pattern[place] == "\\" else pattern[place]
        if in_class:
            if part == "]":
                in_class = False
            out.append("\\" + part if part in ("[", "&") else part)
        elif part == "[":
            in_class = True
            # a bracket right after the opening one is a member
            first = re.match(r"\[\^?\]?", pattern[place:])[0]
            out.append(first.replace("]", "\\]"))
            part = first
        elif part == "{" and pattern.startswith("{,", place) and re.match(r"\{,\d+\}", pattern[place:]):
            out.append("{0")
        else:
            out.append("\\z" if part == "\\Z" else part)
        place += len(part)
    return "(?Ud)" + "".join(out)


def starts_with_match(column: Column, pattern: str) -> Column:
    """True where a regular expression of Python's matches at the start of the text, else false.

    A pattern without special characters turns into a prefix test, which
    reaches the file scan.
    """
    java = java_pattern(pattern)
    if re.escape(pattern) == pattern:
        found = column.startswith(pattern)
    else:
        found = column.rlike(java.replace("(?Ud)", r"(?Ud)\A(?:", 1) + ")")
    return F.coalesce(found, F.lit(False))


def drop_test_functions(df: DataFrame, test_name_pat: str, function: str = "FunctionName") -> DataFrame:
    """Drop rows seen inside test functions. Rows outside any function stay."""
    return df.where(~starts_with_match(F.col(function), test_name_pat))


def drop_own_rows(
    df: DataFrame,
    classes: Sequence[str],
    functions: Sequence[str],
    class_col: str = "Class",
    function_col: str = "FunctionName",
) -> DataFrame:
    """Drop rows that the observing tool produced itself: class and function both listed."""
    own_class = F.coalesce(F.col(class_col).isin(list(classes)), F.lit(False))
    own_function = F.coalesce(F.col(function_col).isin(list(functions)), F.lit(False))
    return df.where(~(own_class & own_function))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_test_file(path: Column) -> Column:
    name = base_name(path)
    return F.when(name.startswith("test_"), name.endswith(".py")).otherwise(name.endswith("_test.py"))


def is_hintable_file(path: Column) -> Column:
    return ~base_name(path).endswith("__init__.py")


def is_inside(path: Column, root: str) -> Column:
    return (path == F.lit(root.rstrip("/"))) | path.startswith(root.rstrip("/") + "/")


def relative_to(df: DataFrame, path: str, root: str) -> DataFrame:
    """Keep rows whose path lies under ``root`` and make the path relative."""
    prefix = root.rstrip("/") + "/"
    return df.where(F.col(path).startswith(prefix)).withColumn(path, F.substr(F.col(path), F.lit(len(prefix) + 1)))


def is_test_function(name: Column) -> Column:
    return F.coalesce(name.startswith(TEST_FUNCTION_PREFIX), F.lit(False))


def in_line_range(line: Column, first: int, last: int) -> Column:
    return line.between(first, last)


def has_original(df: DataFrame) -> DataFrame:
    """Metric rows that have an original hint to compare with."""
    return df.where(F.col("Completeness").isNotNull())


def needs_import(df: DataFrame) -> DataFrame:
    """Rows whose type lives neither among the builtins nor in the file's own module."""
    return df.where(F.col("TypeModule").isNotNull() & (F.col("TypeModule") != path_to_module(F.col("Filename"))))


def rename_none_type(df: DataFrame) -> DataFrame:
    """Hint the builtin NoneType as None, which needs no import."""
    renamed = F.when(F.col("TypeModule").isNull() & (F.col("Type") == "NoneType"), F.lit("None"))
    return df.withColumn("Type", renamed.otherwise(F.col("Type")))


def map_filenames(df: DataFrame, mapping: DataFrame | Mapping[str, str], path: str = "Filename") -> DataFrame:
    """Replace generated file names by the original ones.

    A dict becomes a literal map. A table (generated, original), one row per
    generated name, is joined; its size decides how.
    """
    if isinstance(mapping, Mapping):
        if not mapping:
            return df
        literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        return df.withColumn(path, F.coalesce(F.try_element_at(literal, F.col(path)), F.col(path)))
    names = mapping.select(F.col("generated").alias(path), F.col("original").alias("__original"))
    return df.join(names, path, "left").withColumn(path, F.coalesce("__original", path)).select(*df.columns)


def origin_of_type(module: Column, file: Column, roots: Sequence[tuple[str, str]]) -> Column:
    """Where a type comes from and its module name relative to that root.

    ``roots`` lists (origin, folder), the first folder holding the file wins.
    Builtins have no module, types without a file keep theirs, a file outside
    all folders leaves both fields null.
    """
    def pair(origin: Column, name: Column) -> Column:
        return F.struct(origin.cast("string").alias("origin"), name.cast("string").alias("module"))

    result = pair(F.lit(None), F.lit(None))
    for origin, folder in reversed(list(roots)):
        prefix = folder.rstrip("/") + "/"
        below = F.substr(file, F.lit(len(prefix) + 1))
        result = F.when(file.startswith(prefix), pair(F.lit(origin), path_to_module(below))).otherwise(result)
    result = F.when(file.isNull(), pair(F.lit("fileless"), module)).otherwise(result)
    return F.when(module == "builtins", pair(F.lit("builtin"), F.lit(None))).otherwise(result)


def test_folders(files: DataFrame) -> DataFrame:
    """Existing test folders of every project of a file listing (project, path).

    ``rank`` is the place in the order in which the candidates are looked for.
    """
    parts = F.split(F.col("path"), "/")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    names = F.array(*[F.lit(n) for n in TEST_FOLDERS])
    top = (F.size(parts) > 1) & F.array_contains(names, first)
    nested = (F.size(parts) > 2) & (first == F.col("project")) & F.array_contains(names, second)
    found = F.array_compact(
        F.array(
            F.when(top, F.struct(first.alias("folder"), (2 * F.array_position(names, first) - 2).alias("rank"))),
            F.when(
                nested,
                F.struct(
                    F.concat_ws("/", first, second).alias("folder"),
                    (2 * F.array_position(names, second) - 1).alias("rank"),
                ),
            ),
        )
    )
    return (
        files.select("project", F.explode(found).alias("f"))
        .groupBy("project", F.col("f.folder").alias("folder"), F.col("f.rank").alias("rank"))
        .agg(F.count(F.lit(1)).alias("n_files"))
    )


def _toml_has_pytest(text: str | None) -> bool:
    """Does a project file have a ``tool.pytest`` table or a ``pytest`` dev-dependency?"""
    try:
        tool = tomllib.loads(text or "").get("tool")
    except tomllib.TOMLDecodeError:
        return False
    if not isinstance(tool, dict):
        return False
    poetry = tool.get("poetry")
    dev = poetry.get("dev-dependencies") if isinstance(poetry, dict) else None
    return "pytest" in tool or (isinstance(dev, dict) and "pytest" in dev)


@F.pandas_udf(T.BooleanType())
def _toml_signs(texts: pd.Series) -> pd.Series:
    return texts.map(_toml_has_pytest)


def projects_using_pytest(files: DataFrame) -> DataFrame:
    """Per project of a source table (project, path, content): does it use pytest?

    Signs are a ``pytest.ini``, a ``tool.pytest`` table or a ``pytest``
    dev-dependency in ``pyproject.toml``, or a requirements line starting with
    ``pytest``, all in the project's root. Only ``pyproject.toml`` files are
    parsed in Python; one that does not parse shows nothing.
    """
    path, content = F.col("path"), F.coalesce(F.col("content"), F.lit(""))
    plain = (path == "pytest.ini") | (path.isin("requirements.txt", "requirements-dev.txt") & content.rlike(r"(?m)^pytest"))
    is_toml = path == "pyproject.toml"
    signs = files.where(~is_toml).select("project", plain.alias("sign"))
    parsed = files.where(is_toml).select("project", _toml_signs("content").alias("sign"))
    return signs.unionByName(parsed).groupBy("project").agg(F.bool_or("sign").alias("uses_pytest"))


def of_category(df: DataFrame, category: Category) -> DataFrame:
    return df.where(F.col("Category") == int(category))
