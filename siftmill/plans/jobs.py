"""The jobs: observe, unify, place, evaluate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from siftmill.operators import changes, filters, hints, matching, placement
from siftmill.operators.keys import null_equal_join
from siftmill.operators.reduce import dedup
from siftmill.plans.pipeline import Chain
from siftmill.schemas import HINT6, OBS9, ORD
from siftmill.session import written
from siftmill.sources.files import changed_digests, digests
from siftmill.sources.python_code import content_facts, fact_errors, source_facts


def observe(
    events: DataFrame,
    call: Sequence[str],
    scope: Sequence[str],
    loop: Sequence[str] | None = None,
    own_classes: Sequence[str] = (),
    own_functions: Sequence[str] = (),
    order: str = ORD,
    is_head: str | None = None,
    root: str | None = None,
) -> DataFrame:
    """Observations of an event table.

    An event names a variable of a scope, its value and type at a line of a
    call. With ``root``, only events of files in that folder count. Lines are
    set back to the event before, unchanged values drop out, loops are cut off
    once stable, the observing tool's own rows are removed and the rest is made
    distinct.

    ``loop`` names the columns that tell loops apart. Iterations are counted at
    the events where ``is_head`` is true; what precedes the first lies outside.
    Without ``is_head`` the events have an ``iteration`` column.
    """
    rows = events if root is None else events.where(filters.is_inside(F.col("Filename"), root))
    if loop and is_head:
        rows = changes.numbered_iterations(rows, loop, is_head, order=order)
        rows = rows.withColumn("iteration", F.when(F.col("iteration") >= 0, F.col("iteration")))
    rows = changes.attributed_lines(rows, call, order=order)
    rows = changes.changed_values(rows, scope, "VarName", "Value", order)
    rows = rows.withColumn("LineNo", F.col("AttributedLine")).drop("AttributedLine", "Value")
    if loop:
        rows = changes.until_stable_loops(rows, loop, OBS9)
    rows = filters.drop_own_rows(rows, own_classes, own_functions)
    return dedup(rows, OBS9, order)


def unify(observations: DataFrame, chain: Chain, hierarchy: DataFrame | None = None) -> DataFrame:
    return chain(observations, hierarchy)


def extract_hints(sources: DataFrame) -> dict[str, DataFrame]:
    """``hints`` and ``errors`` of a source table, in which many files may have the same content.

    Python parses every different content once.
    """
    listed = written(digests(sources), "digests")
    facts = written(content_facts(sources), "facts")
    errors = fact_errors(facts).drop("project").withColumnRenamed("Filename", "digest").join(listed, "digest")
    return {
        "hints": hints.hints_at_paths(hints.source_hints(facts), listed),
        "errors": errors.select("project", F.col("path").alias("Filename"), "line", "error"),
    }


def place(
    sources: DataFrame, unified: DataFrame, strategy: str = "inline", strict: bool = True
) -> dict[str, DataFrame]:
    """What to write where: ``sites`` with hint and action, ``imports``, ``errors``.

    Files are parsed once: their facts are a written table.
    """
    applicable = placement.hintable(unified)
    facts = written(source_facts(sources.where(filters.is_hintable_file(F.col("path"))), spread=True), "facts")
    assigned = placement.assign_hints(hints.source_sites(facts), applicable, strict)
    return {
        "sites": placement.with_action(assigned, strategy),
        "imports": placement.import_plan(applicable),
        "errors": fact_errors(facts),
    }


def evaluate(
    original: DataFrame,
    generated: DataFrame,
    observations: DataFrame,
    timings: DataFrame | None = None,
    filenames: DataFrame | Mapping[str, str] | None = None,
    strict: bool = True,
) -> dict[str, DataFrame]:
    """Compare the hints of two source trees.

    A file is one of a project: equal paths of different projects are compared
    each on their own, and ``metrics``, ``files`` and ``errors`` name the
    project. Observations apply to the files of their ``project``, where they
    have that column, and otherwise to every project's file of that name.

    Files are compared by digest. Of the observed ones that differ, every
    different content is parsed once, over both sides and all projects; its facts
    and hints are written tables, and files get them by digest. Gives
    ``metrics``, ``totals``, ``files``, ``errors`` and, if handed in,
    ``timings``.
    """
    own = [c for c in ("project",) if c in observations.columns]
    observed = observations.groupBy(*own, F.col("Filename").alias("path")).agg(F.lit(1).alias("__one")).drop("__one")
    before = null_equal_join(digests(original), observed, [*own, "path"], "left_semi")
    after = null_equal_join(digests(generated), observed, [*own, "path"], "left_semi")
    changed = written(changed_digests(before, after, strict), "changed")
    sides = F.explode(F.array(
        F.struct(F.lit("original").alias("side"), F.col("digest")),
        F.struct(F.lit("generated").alias("side"), F.col("other_digest").alias("digest")),
    ))
    listed = changed.select("project", "path", sides.alias("s")).select("project", "path", "s.*")
    wanted = listed.select(F.col("digest").alias("path")).distinct()
    both = original.select("content").unionByName(generated.select("content"))
    facts = written(content_facts(both, wanted), "facts")
    found = hints.hints_at_paths(written(hints.source_hints(facts), "hints"), listed)
    errors = fact_errors(facts).drop("project").withColumnRenamed("Filename", "digest").join(listed, "digest")
    metrics = matching.match_hints(
        found.where(F.col("side") == "original").drop("side"),
        found.where(F.col("side") == "generated").drop("side"),
        filenames=filenames,
        keys=["project", *HINT6],
    )
    results = {
        "metrics": metrics,
        "totals": matching.total_scores(metrics),
        "files": matching.file_rates(metrics, ["project", "Filename"]),
        "errors": errors.select("side", "project", F.col("path").alias("Filename"), "line", "error"),
    }
    if timings is not None:
        results["timings"] = timings
    return results
