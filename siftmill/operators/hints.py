"""Hints and sites from the facts of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftmill.functions.typenames import normalize_type
from siftmill.schemas import ORD, Category

_FILE = ["project", "path"]
_NAME = r"(?U)[^\W\d]\w*(?:\.[^\W\d]\w*)*"
_STARTS_NAME = r"(?U)^[^\W\d]"


def definitions(facts: DataFrame) -> DataFrame:
    """What names mean, per file: ``names``, a map from name to its definitions.

    A file's imports and classes are bounded by the file.
    """
    seq = F.col("seq")
    kind = F.col("kind")
    alias = F.when(kind == "alias", F.struct(seq.alias("seq"), F.col("text").alias("module")))
    per_name = (
        facts.where(kind.isin("from", "alias", "class"))
        .groupBy(*_FILE, "name")
        .agg(
            F.min(F.when(kind == "class", seq)).alias("class_seq"),
            F.min(F.when(kind == "from", seq)).alias("from_seq"),
            F.min_by(F.when(kind == "from", F.col("text")), F.when(kind == "from", seq)).alias("from_module"),
            F.sort_array(F.collect_list(alias)).alias("aliases"),
        )
    )
    entry = F.struct("name", F.struct("class_seq", "from_seq", "from_module", "aliases"))
    return per_name.groupBy(*_FILE).agg(F.map_from_entries(F.collect_list(entry)).alias("names"))


def _known(entry: Column, field: str, seq: Column) -> Column:
    return F.coalesce(entry[field] < seq, F.lit(False))


def _module_of_head(name: Column, names: Column, seq: Column) -> Column:
    """Replace the first part of a dotted name by what it was imported as."""
    head = F.substring_index(name, ".", 1)
    rest = F.substring(name, F.length(head) + 1, F.length(name))
    entry = F.try_element_at(names, head)
    alias = F.try_element_at(F.filter(entry["aliases"], lambda a: a["seq"] < seq), F.lit(-1))["module"]
    imported = F.concat(entry["from_module"], F.lit("."), name)
    return F.when(alias.isNotNull(), F.concat(alias, rest)).when(_known(entry, "from_seq", seq), imported).otherwise(name)


def _resolve(name: Column, names: Column, seq: Column) -> Column:
    """Full name of a name in a hint, by what the file defined before.

    A class of the file wins, then the first import of the name; then the first
    part of a dotted name is looked up, as an alias first.
    """
    entry = F.try_element_at(names, name)
    imported = F.concat(entry["from_module"], F.lit("."), name)
    plain = (
        F.when(_known(entry, "class_seq", seq), name)
        .when(_known(entry, "from_seq", seq), _module_of_head(imported, names, seq))
        .otherwise(name)
    )
    return F.when(name.contains("."), _module_of_head(name, names, seq)).otherwise(plain)


def qualify(hints: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """Put full names into the hint text. One join per file, the rest stays in the row."""
    parts = F.regexp_extract_all(F.col(text), F.lit(rf"{_NAME}|[\W\d]+"), F.lit(0))
    joined = hints.join(names, _FILE, "left")
    known = F.coalesce(F.col("names"), F.create_map().cast(joined.schema["names"].dataType))
    full = F.array_join(
        F.transform(parts, lambda p: F.when(p.rlike(_STARTS_NAME), _resolve(p, known, F.col("seq"))).otherwise(p)), ""
    )
    return joined.withColumn(text, full).drop("names")


def line_offsets(hints: DataFrame) -> DataFrame:
    """Stand in for the line: the smallest offset of the annotated assignments on it.

    A window's rows are those of one line of one file.
    """
    line = Window.partitionBy(*_FILE, "line")
    is_global = F.col("category") == int(Category.GLOBAL_VARIABLE)
    offset = F.when(F.col("col").isNull() | is_global, F.lit(0)).otherwise(F.min("col").over(line))
    return hints.withColumn("ColumnOffset", offset.cast("long"))


def merge_globals(hints: DataFrame, text: str = "text") -> DataFrame:
    """One row per global of a file with all its hints as members; other rows stay single."""
    is_global = F.col("category") == int(Category.GLOBAL_VARIABLE)
    single = F.when(~is_global, F.col("seq"))
    united = F.array_join(F.sort_array(F.collect_set(text)), " | ")
    return (
        hints.withColumn("__single", single)
        .groupBy(*_FILE, "class", "function", "ColumnOffset", "category", "name", "__single")
        .agg(F.when(F.count(text) > 0, united).alias(text), F.min("seq").alias("seq"))
        .drop("__single")
    )


def source_hints(facts: DataFrame) -> DataFrame:
    """Hint rows of all files: project, the seven hint columns, and the order (file, place).

    The facts are shuffled once, by file. All that follows works within a file
    and is planned without another shuffle. The number of partitions is given,
    as they are small in bytes but not in work and would be merged.
    """
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_file = facts.withColumn("project", F.coalesce("project", F.lit(""))).repartition(partitions, *_FILE)
    # a hint that cannot be read still takes part in the offsets of its line
    read = F.col("kind") == "hint"
    unread = (F.col("kind") == "error") & F.col("col").isNotNull()
    offsets = line_offsets(by_file.where(read | unread)).where(read & F.col("category").isNotNull())
    merged = merge_globals(qualify(offsets, definitions(by_file)))
    return merged.select(
        F.nullif("project", F.lit("")).alias("project"),
        F.col("path").alias("Filename"),
        F.col("class").alias("Class"),
        F.col("function").alias("FunctionName"),
        "ColumnOffset",
        F.col("category").alias("Category"),
        F.col("name").alias("VarName"),
        normalize_type(F.col("text")).alias("Type"),
        F.struct(F.col("path").alias("file"), F.col("seq").alias("place")).alias(ORD),
    )


def hints_at_paths(hints: DataFrame, files: DataFrame) -> DataFrame:
    """Hints of contents, whose file name is a digest, for all files (project, path, digest) with that content."""
    own = hints.drop("project").withColumnRenamed("Filename", "digest").withColumn(ORD, F.col(f"{ORD}.place"))
    joined = files.join(own, "digest")
    rest = [c for c in joined.columns if c not in ("digest", "project", "path", ORD)]
    return joined.select("project", F.col("path").alias("Filename"), *rest, F.struct(F.col("path").alias("file"), F.col(ORD).alias("place")).alias(ORD))


def source_sites(facts: DataFrame) -> DataFrame:
    """Places that can carry a hint, in the layout ``operators.placement`` works on."""
    return facts.where(F.col("kind").startswith("site:")).select(
        F.col("path").alias("Filename"),
        F.col("seq").alias("SiteNo"),
        F.col("statement").alias("StatementNo"),
        F.substr(F.col("kind"), F.lit(len("site:") + 1)).alias("Kind"),
        F.col("target").alias("Target"),
        F.col("scope").alias("Scope"),
        F.col("function").alias("FunctionName"),
        F.col("enclosing").alias("EnclosingClasses"),
        F.col("line").alias("LineNo"),
        F.col("name").alias("VarName"),
        F.col("declared_global").alias("DeclaredGlobal"),
        F.col("has_hint").alias("HasHint"),
        F.col("has_value").alias("HasValue"),
        F.col("target_count").alias("TargetCount"),
    )
