"""Which hint goes to which place in the source, and what is done there.

A site is a place that can carry a hint. Every kind of site has its own rule of
which observation belongs to it. All rules are brought to one key, so that one
equi-join serves them all: columns a rule does not compare are null on both
sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftmill.functions.names import outermost, path_to_module, union_members
from siftmill.operators.filters import is_hintable_file, needs_import, rename_none_type
from siftmill.operators.keys import null_equal_join
from siftmill.schemas import Category

PARAM, RETURN = int(Category.FUNCTION_PARAMETER), int(Category.FUNCTION_RETURN)
LOCAL, MEMBER, GLOBAL = int(Category.LOCAL_VARIABLE), int(Category.CLASS_MEMBER), int(Category.GLOBAL_VARIABLE)

# kind: param, return, assign, annassign, augassign
# scope: module (outside functions and classes), class, function
# target: name or attr, for the three kinds of assignment
SITES = T.StructType(
    [
        T.StructField("Filename", T.StringType(), False),
        T.StructField("SiteNo", T.LongType(), False),
        T.StructField("StatementNo", T.LongType(), False),
        T.StructField("Kind", T.StringType(), False),
        T.StructField("Target", T.StringType(), True),
        T.StructField("Scope", T.StringType(), False),
        T.StructField("FunctionName", T.StringType(), True),
        T.StructField("EnclosingClasses", T.ArrayType(T.StringType()), False),
        T.StructField("LineNo", T.LongType(), False),
        T.StructField("VarName", T.StringType(), False),
        T.StructField("DeclaredGlobal", T.BooleanType(), False),
        T.StructField("HasHint", T.BooleanType(), False),
        T.StructField("HasValue", T.BooleanType(), False),
        T.StructField("TargetCount", T.LongType(), False),
    ]
)

_KEY = ["Filename", "__category", "__line", "__name", "__function", "__module", "__class"]


def _only(condition: Column, column: Column) -> Column:
    return F.when(condition, column)


def site_category(df: DataFrame) -> Column:
    """Category of the observations that belong to a site, null for a site that gets none."""
    assigned = F.col("Kind").isin("assign", "annassign", "augassign")
    name = F.col("Target") == "name"
    return (
        F.when(F.col("Kind") == "param", PARAM)
        .when(F.col("Kind") == "return", RETURN)
        .when(assigned & (F.col("Target") == "attr"), MEMBER)
        .when(assigned & name & (F.col("Scope") == "module"), GLOBAL)
        .when(assigned & name & ~F.col("DeclaredGlobal"), LOCAL)
        .cast("long")
    )


def _site_keys(sites: DataFrame) -> DataFrame:
    """One row per site and class that may own its observation."""
    category = F.col("__category")
    classes = F.col("EnclosingClasses")
    own = F.when(F.size(classes) > 0, F.slice(classes, 1, 1)).otherwise(F.array(F.lit(None).cast("string")))
    every = F.when(F.size(classes) > 0, F.array_distinct(classes)).otherwise(F.array(F.lit(None).cast("string")))
    nothing = F.array(F.lit(None).cast("string"))
    owners = F.when(category == RETURN, own).when(category.isin(LOCAL, MEMBER), every).otherwise(nothing)
    keyed = sites.where(category.isNotNull()).select(
        "Filename",
        "SiteNo",
        "__category",
        _only(category.isin(PARAM, LOCAL), F.col("LineNo")).alias("__line"),
        F.col("VarName").alias("__name"),
        _only(category == PARAM, F.col("FunctionName")).alias("__function"),
        F.explode(owners).alias("__class"),
    )
    return keyed.withColumn("__module", _only(F.col("__class").isNotNull(), path_to_module(F.col("Filename"))))


def _observation_keys(observations: DataFrame) -> DataFrame:
    """Observations on the sites' key, one row per key."""
    category, module, owner = F.col("Category"), F.col("ClassModule"), F.col("Class")
    at_zero = category.isin(PARAM, LOCAL) | (F.col("LineNo") == 0)
    ownerless = (category != GLOBAL) | (module.isNull() & owner.isNull())
    # an owner is compared as a pair, one half alone belongs to no site
    whole = (category == PARAM) | (module.isNull() == owner.isNull())
    owned = category.isin(RETURN, LOCAL, MEMBER)
    hint = F.struct(F.col("TypeModule").alias("module"), F.col("Type").alias("type"))
    keyed = observations.where(at_zero & ownerless & whole).select(
        "Filename",
        category.cast("long").alias("__category"),
        _only(category.isin(PARAM, LOCAL), F.col("LineNo")).alias("__line"),
        F.col("VarName").alias("__name"),
        _only(category == PARAM, F.col("FunctionName")).alias("__function"),
        _only(owned, module).alias("__module"),
        _only(owned, owner).alias("__class"),
        hint.alias("__hint"),
    )
    return keyed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("__count"), F.min("__hint").alias("__hint"))


def assign_hints(sites: DataFrame, observations: DataFrame, strict: bool = False) -> DataFrame:
    """Sites with the hint they get: ``HintModule``, ``Hint``, ``HintCount``.

    More than one observation for a site is a conflict: ``HintCount`` tells,
    ``strict`` makes it an error. The hint is then the smallest of them.
    """
    placed = sites.withColumn("__category", site_category(sites))
    # both joins are shuffled: Spark guesses what an exploded or compressed table
    # takes from its files, and would collect a side of any size on the driver
    keyed = _observation_keys(rename_none_type(observations)).hint("merge")
    found = (
        null_equal_join(_site_keys(placed).hint("merge"), keyed, _KEY)
        .groupBy("Filename", "SiteNo")
        .agg(F.sum("__count").alias("__count"), F.min("__hint").alias("__hint"))
    )
    joined = placed.join(found.hint("merge"), ["Filename", "SiteNo"], "left")
    count = F.coalesce(F.col("__count"), F.lit(0).cast("long"))
    if strict:
        where = F.concat_ws(":", F.col("Filename"), F.col("LineNo"), F.col("VarName"))
        message = F.concat(F.lit("more than one hint for "), where)
        count = F.when(count > 1, F.raise_error(message).cast("long")).otherwise(count)
    return joined.select(
        *sites.columns,
        F.col("__hint")["module"].alias("HintModule"),
        F.col("__hint")["type"].alias("Hint"),
        count.alias("HintCount"),
    )


def hint_conflicts(assigned: DataFrame) -> DataFrame:
    return assigned.where(F.col("HintCount") > 1)


def with_action(assigned: DataFrame, strategy: str = "inline") -> DataFrame:
    """What is done at a site: annotate, declare, replace, strip, remove, keep or none.

    ``inline`` leaves hints of parameters and returns alone, but replaces or
    strips annotated assignments. ``eval_inline`` clears all hints first, so
    that only observed ones remain. An assignment to several targets cannot
    carry a hint: its hinted targets are declared before it.
    """
    if strategy not in ("inline", "eval_inline"):
        raise LookupError(f"unknown strategy {strategy}")
    kind, hinted = F.col("Kind"), F.col("Hint").isNotNull()
    callable_site = kind.isin("param", "return")
    alone = F.col("TargetCount") == 1
    if strategy == "inline":
        existing = F.when(F.col("HasHint"), "keep").when(hinted, "annotate").otherwise("none")
        annotated = F.when(hinted, "replace").when(F.col("HasValue"), "strip").otherwise("remove")
    else:
        existing = (
            F.when(F.col("HasHint") & hinted, "replace")
            .when(F.col("HasHint"), "strip")
            .when(hinted, "annotate")
            .otherwise("none")
        )
        annotated = F.when(~F.col("HasValue"), "remove").when(hinted, "replace").otherwise("strip")
    action = (
        F.when(callable_site, existing)
        .when(kind == "annassign", annotated)
        .when(~hinted, "none")
        .when((kind == "assign") & alone, "annotate")
        .otherwise("declare")
    )
    return assigned.withColumn("Action", action)


def import_plan(observations: DataFrame) -> DataFrame:
    """What every file has to import for its hints: distinct (Filename, Module, Name)."""
    members = union_members(F.col("TypeModule"), F.col("Type"))
    pairs = needs_import(observations).select("Filename", F.explode(members).alias("m"))
    module, name = F.col("m.module"), outermost(F.col("m.type"))
    importable = module.rlike(r"(?U)\A[^\W\d]\w*(\.[^\W\d]\w*)*\z")
    return (
        pairs.where((module != "") & importable)
        .groupBy("Filename", module.alias("Module"), name.alias("Name"))
        .agg(F.lit(1).alias("__one"))
        .drop("__one")
    )


def import_statements(plan: DataFrame) -> DataFrame:
    """One statement per file and module; a module's names are few."""
    names = F.array_join(F.sort_array(F.collect_set("Name")), ", ")
    return plan.groupBy("Filename", "Module").agg(
        F.concat(F.lit("from "), F.col("Module"), F.lit(" import "), names).alias("Statement")
    )


def hintable(observations: DataFrame, file: str = "Filename") -> DataFrame:
    """Observations of files that may be annotated."""
    return observations.where(is_hintable_file(F.col(file)))
