"""Joins in which null keys are equal to each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

_RIGHT = "__right_"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def null_equal_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on``, null matching null, key columns kept once.

    Catalyst turns ``<=>`` into hash keys, so this plans as a shuffled or (for
    a side whose measured size allows it) broadcast equi-join. Columns other
    than the keys must have different names on both sides.
    """
    others = [quoted(c) for c in right.columns if c not in on]
    renamed = right.selectExpr(*[f"{quoted(c)} AS {quoted(_RIGHT + c)}" for c in on], *others)
    condition = " AND ".join(f"{quoted(c)} <=> {quoted(_RIGHT + c)}" for c in on)
    joined = left.join(renamed, F.expr(condition), how)
    if how in ("left_semi", "left_anti"):
        return joined
    kept = [quoted(c) for c in left.columns]
    if how in ("full", "full_outer", "outer", "right", "right_outer"):
        kept = [
            f"coalesce({quoted(c)}, {quoted(_RIGHT + c)}) AS {quoted(c)}" if c in on else quoted(c) for c in left.columns
        ]
    return joined.selectExpr(*kept, *others)
