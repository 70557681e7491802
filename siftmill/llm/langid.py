"""Language identification: naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from siftmill.llm.pools import slices

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 16
SMOOTHING = 0.1
ROWS_PER_LANGUAGE = 2_000  # labelled rows a language is learned from
CHUNK = 1 << 16  # characters scored at once
SMALL_TABLE = 100_000  # rows of a table of languages that is broadcast

_BMP_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])
_RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


@dataclass(frozen=True)
class Model:
    """Languages in order, and a row of log probabilities of all buckets for each: 256 KB a language."""

    languages: tuple[str, ...]
    log_prob: np.ndarray  # languages x buckets, float32


def _letters(lowered: str) -> np.ndarray:
    """Code points, with a space for everything that is no letter."""
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _BMP_LETTER[np.minimum(points, 0xFFFF)]
    for at in np.flatnonzero(points > 0xFFFF):
        letter[at] = chr(points[at]).isalpha()
    return np.where(letter, points, np.uint32(32))


def ngram_buckets(points: np.ndarray, rows: np.ndarray | None = None, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, all orders one after the other, and where each n-gram starts.

    N-grams of blanks only are left out, and those that go across a change in
    ``rows``, the number of each point's text. Those that end within the first
    ``known`` points were given before.
    """
    blank = points == 32
    grams, empty = points, blank
    found, starts = [], []
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            if len(grams) < 2:
                break
            grams = grams[:-1] * np.uint32(0x01000193) + points[order - 1 :]
            empty = empty[:-1] & blank[order - 1 :]
        if order in ORDERS:
            counted = ~empty
            counted[: max(0, known - order + 1)] = False
            if rows is not None:
                counted &= rows[: len(grams)] == rows[order - 1 :]
            start = np.flatnonzero(counted)
            mixed = (grams[start] ^ np.uint32(order * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            found.append(mixed >> np.uint32(32 - BUCKET_BITS))
            starts.append(start)
    return np.concatenate(found), np.concatenate(starts)


def _in_chunks(lowered: str) -> Iterator[np.ndarray]:
    """Points of a text between two blanks, some at a time; each part begins with the last three of the one before."""
    carried = np.array([32], np.uint32)
    for at in range(0, max(1, len(lowered)), CHUNK):
        points = _letters(lowered[at : at + CHUNK])
        if at + CHUNK >= len(lowered):
            points = np.append(points, np.uint32(32))
        joined = np.concatenate((carried, points))
        yield joined
        carried = joined[-(max(ORDERS) - 1) :]


def text_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text of any length: the same ones however it is cut into chunks."""
    known = 0
    for points in _in_chunks(text.lower()):
        yield ngram_buckets(points, known=known)[0]
        known = min(len(points), max(ORDERS) - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each language has each bucket in this task's rows: one row for a language."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, texts in slices(batch):
            for lang, text in zip(part.column("lang").to_pylist(), texts):
                total = totals.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for buckets in text_buckets(text):
                    total += np.bincount(buckets, minlength=len(total))
    for lang, total in totals.items():
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen])], ["lang", "bucket", "n"])


def train(labelled: DataFrame, *, rows_per_language: int = ROWS_PER_LANGUAGE, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Model of the languages of ``labelled``; rows without text or language are skipped.

    It is fitted on a sample of about ``rows_per_language`` rows of each
    language, those with the smallest hashes of id and text, so that rows that share an
    id are not all taken or all left; all rows where there are fewer. Counts of
    n-grams are summed by Spark to one row a language, and the driver takes
    these one by one. Any number of languages is learned; each costs 256 KB on
    the driver and in every worker. No rows at all give a model that knows no language.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((0, 1 << BUCKET_BITS), np.float32))
    scale = 1 << 30
    shares = [(lang, min(scale, scale * rows_per_language // sizes[lang] + 1)) for lang in languages]
    shares = labelled.sparkSession.createDataFrame(shares, "lang string, share bigint")
    if len(languages) <= SMALL_TABLE:
        shares = F.broadcast(shares)  # counted just now
    place = F.pmod(F.xxhash64("id", "text"), F.lit(scale))
    sample = rows.withColumn("place", place).join(shares, "lang").filter("place < share").select("lang", "text").repartition(16)
    summed = sample.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_language = summed.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n"))
    counts = np.full((len(languages), 1 << BUCKET_BITS), SMOOTHING, np.float32)
    position = {lang: i for i, lang in enumerate(languages)}
    for row in by_language.toLocalIterator():
        counts[position[row["lang"]], row["buckets"]] += np.array(row["n"], np.float32)
    sums = counts.sum(axis=1, dtype=np.float64)
    np.log(counts, out=counts)
    return Model(languages, counts - np.log(sums).astype(np.float32)[:, None])


def _groups(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``CHUNK`` characters together; longer ones are alone."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        if at > start and size + len(text) > CHUNK:
            yield start, at
            start, size = at, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def score_texts(texts: Sequence[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the summed log probabilities of each language, the number of n-grams, and whether it has a letter.

    The batch is a sparse matrix, texts by buckets, in compressed rows; it is
    multiplied with the languages' log probabilities, one language at a time.
    """
    texts = [text or "" for text in texts]
    totals, grams, lettered = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)

    def add(rows: np.ndarray, buckets: np.ndarray) -> None:
        # rows ascend: where each begins is all that compressed rows need
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
        if not len(first):
            return
        own = rows[first]
        for language, log_prob in enumerate(model.log_prob):
            totals[own, language] += np.add.reduceat(log_prob[buckets], first, dtype=np.float64)
        grams[own] += np.diff(np.append(first, len(rows)))

    for start, end in _groups(texts):
        if end == start + 1:
            known = 0
            for points in _in_chunks(texts[start].lower()):
                buckets, _ = ngram_buckets(points, known=known)
                known = min(len(points), max(ORDERS) - 1)
                lettered[start] |= bool((points != 32).any())
                add(np.full(len(buckets), start), buckets)
            continue
        lowered = [text.lower() for text in texts[start:end]]
        points = _letters(f" {'  '.join(lowered)} ")
        rows = np.repeat(np.arange(start, end), [len(text) + 2 for text in lowered])
        lettered[rows[points != 32]] = True
        buckets, places = ngram_buckets(points, rows)
        order = np.argsort(rows[places], kind="stable")
        add(rows[places][order], buckets[order])
    return totals, grams, lettered


def predict_texts(texts: Sequence[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Languages and scores of texts; ``und`` and 0 without letters or model.

    All languages are equally likely beforehand; of equals the first by name is
    taken. The score is the language's probability after dividing all evidence
    by the square root of the number of n-grams, as neighbouring n-grams are
    far from independent.
    """
    if not model.languages or not len(texts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    totals, grams, lettered = score_texts(texts, model)
    evidence = np.exp((totals - totals.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(grams, 1))[:, None])
    best = evidence.argmax(axis=1)
    scores = np.where(lettered, evidence[np.arange(len(best)), best] / evidence.sum(axis=1), 0.0)
    return [model.languages[i] if known else UNKNOWN for i, known in zip(best.tolist(), lettered.tolist())], scores


def predictor(spark, model: Model):
    """Function of a text column giving a struct of lang_pred and score; the model is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        languages, scores = [], [np.zeros(0)]
        for _, part in slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            found = predict_texts(part, shared.value)
            languages += found[0]
            scores.append(found[1])
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 3, is 1. A null id is held out, too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify_languages(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    Whole texts are scored, very long ones in chunks that change no n-gram. Null,
    empty and letterless texts are ``und``. Of languages that score equally the
    first by name is taken. Rows are independent, so repeated rows, null ids and
    other columns change nothing; an empty table gives an empty result.
    """
    predict = predictor(docs.sparkSession, model)
    return docs.select(F.col(id_col).alias("doc_id"), predict(F.col(text_col)).alias("p")).select("doc_id", "p.lang_pred", "p.score")
