"""What changed between events: the observing side, as table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from siftmill.operators.keys import null_equal_join
from siftmill.operators.ordered import DEFAULT_CHUNK_ROWS, previous, running_sum
from siftmill.schemas import OBS9, ORD, SITE7, TYPE2, Category

# Fixed value: iterations without a new observation after which a loop counts as stable.
ITERATIONS_UNTIL_STABLE = 5

PREVIOUS = "__previous"


def only_changes(seen: DataFrame, value: str, snapshot: str | None = None) -> DataFrame:
    """Rows that are new or differ from ``__previous``, the struct ``previous`` gives."""
    before = F.col(PREVIOUS)
    changed = before.isNull() | ~F.col(value).eqNullSafe(before[value])
    if snapshot is not None:
        changed = changed | (before[snapshot] < F.col(snapshot) - 1)
    return seen.where(changed).drop(PREVIOUS)


def changed_values(
    df: DataFrame,
    scope: Sequence[str],
    name: str,
    value: str,
    order: str = ORD,
    snapshot: str | None = None,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Rows in which a variable is new in its scope or has another value than before.

    With ``snapshot``, the dense number of the scope's snapshot a row belongs
    to, a variable missing from the snapshot before counts as new again.
    """
    carried = [value] if snapshot is None else [value, snapshot]
    return only_changes(previous(df, [*scope, name], carried, PREVIOUS, order, chunk_rows), value, snapshot)


def with_attributed_line(seen: DataFrame, line: str = "LineNo", out: str = "AttributedLine") -> DataFrame:
    """The line of ``__previous``, or the row's own where there is none."""
    before = F.col(PREVIOUS)
    return seen.withColumn(out, F.when(before.isNull(), F.col(line)).otherwise(before[line])).drop(PREVIOUS)


def attributed_lines(
    df: DataFrame,
    call: Sequence[str],
    line: str = "LineNo",
    out: str = "AttributedLine",
    order: str = ORD,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """A change seen at an event was made by the line of the call's event before.

    The first event of a call keeps its own line.
    """
    return with_attributed_line(previous(df, call, [line], PREVIOUS, order, chunk_rows), line, out)


def numbered_iterations(
    df: DataFrame,
    loop: Sequence[str],
    is_head: str,
    out: str = "iteration",
    order: str = ORD,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Iteration of every event of a loop, counted at the events of the loop's head, from 0."""
    heads = F.col(is_head).cast("long")
    return running_sum(df, loop, heads, out, order, chunk_rows).withColumn(out, F.col(out) - 1)


def stable_loop_ends(
    df: DataFrame,
    loop: Sequence[str],
    observation: Sequence[str],
    iteration: str = "iteration",
    until_stable: int = ITERATIONS_UNTIL_STABLE,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Per loop the first iteration, ``__end``, that is no longer recorded.

    That is the one after ``until_stable`` iterations in a row without an
    observation the loop had not shown before. The loop's start counts as news.
    """
    firsts = df.groupBy(*loop, *observation).agg(F.min(iteration).alias("__news"))
    news = firsts.groupBy(*loop, "__news").agg(F.lit(1).alias("__one")).drop("__one")
    before = previous(news, loop, ["__news"], "__before", "__news", chunk_rows)
    last = F.coalesce(F.col("__before")["__news"], F.lit(-1).cast("long"))
    gap = F.col("__news") - last > until_stable
    return before.groupBy(*loop).agg(
        F.coalesce(F.min(F.when(gap, last + until_stable + 1)), F.max("__news") + until_stable + 1).alias("__end")
    )


def until_stable_loops(
    df: DataFrame,
    loop: Sequence[str],
    observation: Sequence[str],
    iteration: str = "iteration",
    is_head: str | None = None,
    until_stable: int = ITERATIONS_UNTIL_STABLE,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Drop the rows of a loop from the point on where it has become stable.

    Later changes in such a loop are missed on purpose. With ``is_head`` the
    event at the loop's head that finds it stable is still kept. Rows outside
    loops have a null iteration and stay.
    """
    inside = df.where(F.col(iteration).isNotNull())
    ends = stable_loop_ends(inside, loop, observation, iteration, until_stable, chunk_rows)
    joined = null_equal_join(df, ends, loop, "left")
    kept = F.col(iteration).isNull() | (F.col(iteration) < F.col("__end"))
    if is_head is not None:
        kept = kept | ((F.col(iteration) == F.col("__end")) & F.col(is_head))
    return joined.where(kept).drop("__end")


def flatten_updates(updates: DataFrame, order: str | None = ORD) -> DataFrame:
    """Observation rows of update batches.

    A batch has Filename, ClassModule, Class, FunctionName, LineNo, Category
    and ``names2types``, a map from variable to (module, type). What is stateful
    is stored without the place it was seen at: globals lose class, function
    and line, members function and line, returns their line.
    """
    category = F.col("Category")
    is_global = category == int(Category.GLOBAL_VARIABLE)
    is_member = category == int(Category.CLASS_MEMBER)
    is_return = category == int(Category.FUNCTION_RETURN)
    extra = [order] if order and order in updates.columns else []
    rows = updates.select(*SITE7[:-1], *extra, F.explode("names2types").alias("VarName", "__type"))
    return rows.select(
        "Filename",
        F.when(~is_global, F.col("ClassModule")).alias("ClassModule"),
        F.when(~is_global, F.col("Class")).alias("Class"),
        F.when(~(is_global | is_member), F.col("FunctionName")).alias("FunctionName"),
        F.when(is_global | is_member | is_return, F.lit(0)).otherwise(F.col("LineNo")).cast("long").alias("LineNo"),
        category.cast("long").alias("Category"),
        "VarName",
        F.col("__type")["module"].alias(TYPE2[0]),
        F.col("__type")["type"].alias(TYPE2[1]),
        *extra,
    ).select(*OBS9, *extra)
