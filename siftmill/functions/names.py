"""Names of modules and types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def path_to_module(path: Column) -> Column:
    """Dotted module name of a relative file path."""
    return F.regexp_replace(F.replace(path, F.lit("/"), F.lit(".")), r"\.[^.]*$", "")


def outermost(type_name: Column) -> Column:
    """First part of a qualified name, the one that can be imported."""
    return F.substring_index(type_name, ".", 1)


def null_if_builtin(module: Column) -> Column:
    return F.nullif(module, F.lit("builtins"))


def union_members(modules: Column, types: Column) -> Column:
    """(module, type) structs of a united pair of texts, up to the shorter list."""
    zipped = F.arrays_zip(F.split(modules, ",").alias("module"), F.split(types, r" \| ").alias("type"))
    return F.filter(zipped, lambda m: m["module"].isNotNull() & m["type"].isNotNull())
