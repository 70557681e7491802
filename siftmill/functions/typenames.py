"""Normal form of type names.

A union may be written ``Union[A, B]``, ``Optional[A]`` or ``A | B``, at any
depth. The normal form has bars only, members once and in order.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Spellings of the two generic unions.
UNION_NAMES = frozenset(["Union", "typing.Union"])
OPTIONAL_NAMES = frozenset(["Optional", "typing.Optional"])


def split_outside_brackets(text: str, mark: str) -> list[str]:
    """Cut ``text`` at every ``mark`` that no bracket encloses."""
    parts, depth, start = [], 0, 0
    for place, char in enumerate(text):
        if char == "[":
            depth += 1
        elif char == "]":
            depth -= 1
            if depth < 0:
                raise ValueError(f"brackets do not match: {text}")
        elif depth == 0 and char == mark:
            parts.append(text[start:place])
            start = place + 1
    return [*parts, text[start:]]


_TOKEN = re.compile(r"[\[\],|]|[^\[\],|]+")


class _Level:
    """An open bracket: whose it is, its finished arguments, and the members of the one being read."""

    def __init__(self, head: str):
        self.head = head
        self.arguments: list[frozenset[str]] = []
        self.members: set[str] = set()
        self.name = ""  # the member being read
        self.closed: frozenset[str] | None = None  # its members, once it had brackets

    def end_member(self) -> None:
        self.members |= frozenset([self.name]) if self.closed is None else self.closed
        self.name, self.closed = "", None

    def end_argument(self) -> None:
        self.end_member()
        self.arguments.append(frozenset(self.members))
        self.members = set()


def _render(text: str) -> str:
    """Normal form of a name without blanks, read once from left to right."""
    levels = [_Level("")]
    for token in _TOKEN.findall(text):
        level = levels[-1]
        if token == "[":
            if level.closed is not None:
                raise ValueError(f"two bracket lists in a row: {text}")
            levels.append(_Level(level.name))
        elif token == "|":
            level.end_member()
        elif token == "," and len(levels) > 1:
            level.end_argument()
        elif token == "]":
            if len(levels) == 1:
                raise ValueError(f"brackets do not match: {text}")
            level.end_argument()
            levels.pop()
            if level.head in UNION_NAMES or level.head in OPTIONAL_NAMES:
                found = frozenset(["None"] if level.head in OPTIONAL_NAMES else []).union(*level.arguments)
            else:
                inner = ", ".join(" | ".join(sorted(members)) for members in level.arguments)
                found = frozenset([f"{level.head}[{inner}]"])
            levels[-1].closed = found
        elif level.closed is not None:
            # what follows a bracket belongs to the name: a[b].c
            if len(level.closed) > 1:
                raise ValueError(f"a union is no part of a name: {text}")
            level.name, level.closed = next(iter(level.closed)) + token, None
        else:
            level.name += token
    if len(levels) > 1:
        raise ValueError(f"brackets do not match: {text}")
    levels[0].end_member()
    return " | ".join(sorted(levels[0].members))


@lru_cache(maxsize=65536)
def normalize_text(text: str) -> str | None:
    """Normal form of one type name, null when its brackets do not match."""
    if "[" not in text and "|" not in text and "]" not in text:
        return text
    try:
        return _render(text.replace(" ", ""))
    except ValueError:
        return None


@F.udtf(returnType="normal string, parts array<string>, error string", useArrow=False)
class TypeNameForms:
    """What there is to know about a type name: normal form, parts between marks outside brackets, what is wrong."""

    def eval(self, name: str, mark: str):
        try:
            yield _render(name.replace(" ", "")), split_outside_brackets(name, mark), None
        except ValueError as problem:
            yield None, None, str(problem).split(":")[0]


def is_bracketed(name: Column) -> Column:
    return name.contains("[") | name.contains("]")


def name_forms(df: DataFrame, name: str, mark: str = "|") -> DataFrame:
    """Dictionary of the bracketed names in a column: name, normal, parts, error.

    Every different name is parsed once, by a table function; only different
    names reach Python. Names whose brackets do not match have an error.
    """
    names = df.where(is_bracketed(F.col(name))).select(F.col(name).alias("name")).distinct()
    return names.lateralJoin(TypeNameForms(F.col("name").outer(), F.lit(mark)))


def with_normal_type(df: DataFrame, name: str, out: str = "normal", forms: DataFrame | None = None) -> DataFrame:
    """Add the normal form of a type name, null for a name that can't be parsed.

    Built-in functions work on plain names and unions without brackets; the
    normal forms of bracketed names are joined from ``name_forms``. Of the rows
    that don't look anything up, none meets others by its name.
    """
    forms = name_forms(df, name) if forms is None else forms
    known = forms.select(F.col("name").alias("__name"), F.col("normal").alias("__normal"))
    looked_up = F.when(is_bracketed(F.col(name)), F.col(name))
    joined = df.withColumn("__wanted", looked_up).join(known, F.col("__wanted") == F.col("__name"), "left")
    flat = _flat_union(F.col(name))
    normal = F.when(is_bracketed(F.col(name)), F.col("__normal")).when(F.col(name).contains("|"), flat).otherwise(F.col(name))
    return joined.withColumn(out, normal).drop("__wanted", "__name", "__normal")


def with_parts(df: DataFrame, name: str, mark: str = "|", out: str = "parts", forms: DataFrame | None = None) -> DataFrame:
    """Add the parts of a name between marks outside brackets, null where brackets do not match."""
    if len(mark) != 1:
        raise ValueError("the mark is one character")
    forms = name_forms(df, name, mark) if forms is None else forms
    known = forms.select(F.col("name").alias("__name"), F.col("parts").alias("__parts"))
    looked_up = F.when(is_bracketed(F.col(name)), F.col(name))
    joined = df.withColumn("__wanted", looked_up).join(known, F.col("__wanted") == F.col("__name"), "left")
    parts = F.when(is_bracketed(F.col(name)), F.col("__parts")).otherwise(F.split(F.col(name), re.escape(mark)))
    return joined.withColumn(out, parts).drop("__wanted", "__name", "__parts")


def name_errors(df: DataFrame, name: str) -> DataFrame:
    """Names of a column that can't be parsed, with the reason and how many rows have them: name, error, n."""
    wrong = name_forms(df, name).where(F.col("error").isNotNull()).select("name", "error")
    counts = df.where(is_bracketed(F.col(name))).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(wrong, "name").select("name", "error", "n")


def _flat_union(name: Column) -> Column:
    """Normal form of a union without brackets."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.replace(name, F.lit(" ")), r"\|"))), " | ")


@F.pandas_udf(T.StringType())
def _normalize_bracketed(names: pd.Series) -> pd.Series:
    return pd.Series([None if name is None else normalize_text(name) for name in names], dtype=object)


def normalize_type(name: Column) -> Column:
    """Normal form of a type name.

    Plain names and unions without brackets stay with built-in functions; only
    bracketed names are worked on in Python, where names seen before are looked
    up. For large tables ``with_normal_type`` parses every different name once.
    """
    bracketed = is_bracketed(name)
    return (
        F.when(bracketed, _normalize_bracketed(F.when(bracketed, name)))
        .when(name.contains("|"), _flat_union(name))
        .otherwise(name)
    )


def split_top_level(text: Column, mark: str) -> Column:
    """Array of the parts of ``text`` between marks outside brackets, null when brackets do not match."""
    if len(mark) != 1:
        raise ValueError("the mark is one character")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        def one(value: str | None) -> list[str] | None:
            try:
                return None if value is None else split_outside_brackets(value, mark)
            except ValueError:
                return None

        return pd.Series([one(value) for value in texts], dtype=object)

    bracketed = text.contains("[") | text.contains("]")
    return F.when(bracketed, split(F.when(bracketed, text))).otherwise(F.split(text, re.escape(mark)))
