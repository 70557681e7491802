"""Table schemas, column presets and schema enforcement.

Column names, category numbers and defaults below are fixed values: they are
what existing observation tables use.
"""

from __future__ import annotations

from collections.abc import Sequence
from enum import IntEnum

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Row order. Every reader adds it, reducers keep the smallest one per group.
ORD = "_ord"
# Multiplicity of a compacted row. A frame that has it is distinct on OBS9.
WEIGHT = "_n"

SITE6 = ["ClassModule", "Class", "FunctionName", "LineNo", "Category", "VarName"]
SITE7 = ["Filename", *SITE6]
TYPE2 = ["TypeModule", "Type"]
OBS9 = [*SITE7, *TYPE2]
HINT6 = ["Filename", "Class", "FunctionName", "ColumnOffset", "Category", "VarName"]
HINT7 = [*HINT6, "Type"]


class Category(IntEnum):
    INVALID = 0
    LOCAL_VARIABLE = 1
    FUNCTION_PARAMETER = 2
    FUNCTION_RETURN = 3
    CLASS_MEMBER = 4
    GLOBAL_VARIABLE = 5


def _field(name: str, dtype: T.DataType, nullable: bool = False) -> T.StructField:
    return T.StructField(name, dtype, nullable)


TYPE_REF = T.StructType([_field("module", T.StringType(), True), _field("type", T.StringType(), True)])

OBSERVATIONS = T.StructType(
    [
        _field("Filename", T.StringType()),
        _field("ClassModule", T.StringType(), True),
        _field("Class", T.StringType(), True),
        _field("FunctionName", T.StringType(), True),
        _field("LineNo", T.LongType()),
        _field("Category", T.LongType()),
        _field("VarName", T.StringType()),
        _field("TypeModule", T.StringType(), True),
        _field("Type", T.StringType()),
    ]
)

HINTS = T.StructType(
    [
        _field("Filename", T.StringType()),
        _field("Class", T.StringType(), True),
        _field("FunctionName", T.StringType(), True),
        _field("ColumnOffset", T.LongType()),
        _field("Category", T.LongType()),
        _field("VarName", T.StringType()),
        _field("Type", T.StringType(), True),
    ]
)

METRICS = T.StructType(
    [
        *HINTS.fields[:-1],
        _field("OriginalType", T.StringType(), True),
        _field("GeneratedType", T.StringType(), True),
        _field("Completeness", T.BooleanType(), True),
        _field("Correctness", T.BooleanType(), True),
    ]
)

TIMINGS = T.StructType([_field("run", T.StringType(), True), _field("times", T.ArrayType(T.DoubleType()), True)])

HIERARCHY = T.StructType(
    [
        _field("module", T.StringType(), True),
        _field("type", T.StringType()),
        _field("bases", T.ArrayType(TYPE_REF)),
    ]
)

SOURCES = T.StructType(
    [
        _field("project", T.StringType(), True),
        _field("path", T.StringType()),
        _field("content", T.StringType(), True),
    ]
)

# Columns that hold unsigned numbers in the logical schema.
UNSIGNED = {"LineNo", "ColumnOffset"}


def category_name(category: Column) -> Column:
    """Readable name of a category number, null for numbers outside the enum."""
    name = F.lit(None).cast("string")
    for member in Category:
        name = F.when(category == F.lit(member.value), F.lit(member.name)).otherwise(name)
    return name


def conform(df: DataFrame, schema: T.StructType, keep: Sequence[str] = (ORD, WEIGHT)) -> DataFrame:
    """Project to the schema's columns, order and types.

    Columns named in ``keep`` are carried along when present. A negative value
    in an unsigned column is an error, as it has no counterpart in the schema.
    """
    columns = []
    for field in schema.fields:
        column = F.col(field.name).cast(field.dataType)
        if field.name in UNSIGNED:
            column = F.when(
                column < 0, F.raise_error(F.concat(F.lit(f"{field.name} is negative: "), column.cast("string")))
            ).otherwise(column)
        columns.append(column.alias(field.name))
    return df.select(*columns, *[F.col(name) for name in keep if name in df.columns])


def empty(spark, schema: T.StructType) -> DataFrame:
    """Typed table without rows."""
    return spark.createDataFrame([], schema)
