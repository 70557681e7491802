"""Exact deduplication by full content, safe against hot texts."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftmill.session import written

SALTS = 64


@F.pandas_udf(StringType())
def ascii_lower(texts: pd.Series) -> pd.Series:
    """Lower case of A-Z only; every other character stays. Null is empty."""
    return texts.map(lambda text: "" if text is None else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


@F.pandas_udf(StringType())
def normalised_sha256(texts: pd.Series) -> pd.Series:
    """``sha256_hex(ascii_lower(text))`` without sending the lowered text back."""
    return texts.map(lambda text: hashlib.sha256(b"" if text is None else text.encode("utf-8", "surrogatepass").lower()).hexdigest())


def duplicate_groups(docs: DataFrame, *, text: Column, digest=sha256_hex, id_col: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row per different text: digest, text, keep_id (largest id), group_size.

    Three steps, each comparing whole texts, because the text is part of every
    grouping key: the map side of the first aggregate combines what one task
    has read; its reduce side merges the copies of one salt, so that the copies
    of a hot text meet in ``salts`` tasks; the second aggregate combines the
    winners of the salts. It gets ``salts`` rows per text at most.
    """
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    salted = rows.select("id", "text", digest(F.col("text")).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    local = salted.groupBy("digest", "salt", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return local.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when they are identical after lower-casing A-Z. Of equal
    texts the row with the largest id stays. A null text counts as empty. Rows
    that repeat the winning id are the same document and stay with it; a null id
    loses against any other, and wins where a group has no other. An empty
    table gives an empty result; other columns are not looked at.

    Rows find their group by digest. Should two different texts share a digest,
    which the grouping notices as it compares whole texts, the rows of that
    digest find their group by the text itself.
    """
    groups = duplicate_groups(docs, text=ascii_lower(F.col(text_col)), digest=digest, id_col=id_col, salts=salts)
    by_digest = groups.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )
    winners = written(by_digest, "exact-winners")
    own = normalised_sha256(F.col(text_col)) if digest is sha256_hex else digest(ascii_lower(F.col(text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), own.alias("digest"))
    single = rows.join(winners.filter("texts = 1").drop("texts"), "digest")
    result = _with_verdict(single)
    clashing = winners.filter("texts > 1").select("digest")
    if not clashing.isEmpty():
        result = result.unionByName(_with_verdict(_by_text(docs, groups, clashing, id_col, text_col, digest)))
    return result


def _by_text(docs, groups, clashing, id_col, text_col, digest) -> DataFrame:
    lowered = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("text"))
    rows = lowered.withColumn("digest", digest(F.col("text"))).join(clashing, "digest", "left_semi")
    return rows.join(groups.join(clashing, "digest", "left_semi"), ["digest", "text"]).drop("text")


def _with_verdict(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
