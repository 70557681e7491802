"""A corpus pipeline: five stages over ``documents``, each an operator of ``siftmill.llm``.

Every stage takes (spark, docs, sf_dir) and works on all documents its
predecessor kept. The first four return the kept rows with the columns they had;
the last returns packed pieces. Rows are kept or dropped by document id, which is
taken as unique: of rows that share one, all stay if one of them passes, and
each is packed. A null id is an id like any other.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill import tune
from siftmill.llm import exact, langid, packing, quality, simhash
from siftmill.session import written

VOCABULARY = "word_bpe_49k.json"
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: without letters or text, or with a score below the limit."""
    tune(spark)
    predict = langid.predictor(spark, langid.train(docs.filter(~langid.held_out())))
    return docs.filter(predict(F.col("text"))["score"] >= LEAST_LANGUAGE_SCORE)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the fixed rules or a rule with a risk-controlled limit."""
    tune(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _only(docs, quality.quality_verdicts(docs, labels).filter("kept"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the document with the largest id."""
    tune(spark)
    return _only(docs, exact.exact_duplicates(docs).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each component of near duplicates, the document with the smallest id."""
    tune(spark)
    return _only(docs, simhash.near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens: one row per piece."""
    tune(spark)
    pieces = packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an id in ``kept``; columns and names stay as they are."""
    ids = kept.select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept_id"]), "left_semi")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("packing", pack),
]

# The stages use models, token ids and connected components, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
