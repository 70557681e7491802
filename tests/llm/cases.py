"""Small tables with everything that may go wrong in a table of documents."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

PROSE = "the quick brown fox jumps over the lazy dog and runs away into the dark green forest near the old river bank"


def rows():
    long_text = " ".join(f"w{i % 997} and-{i}" for i in range(30_000))
    texts = [
        (1, PROSE, "en"),
        (2, PROSE, "en"),
        (2, PROSE, "en"),  # a repeated row
        (3, PROSE.upper(), None),
        (4, None, "en"),
        (5, "", "de"),
        (6, " \t\n\x0b\x0c\r ", "fr"),
        (7, long_text, "en"),
        (8, "12345 67 !!! ###", "en"),
        (9, "Ä ÖÜ ä Straße É é   日本語 \U0001f600", "de"),
        (10, "one line\none line\none line\nother", "xx"),
        (11, "der die das und ist nicht ein eine von mit sich auf für den dem", "de"),
        (12, "a b c", "en"),
        (None, "a text without an id of its own " * 3, "en"),
        (None, None, None),
        (13, "x" * 50_000, "en"),
        (14, PROSE + " again", "en"),
    ]
    return [(i, text, lang, "s0", len(text or "")) for i, text, lang in texts]


def documents(spark, given=None):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(frame, names):
    """The table with further columns that are named like an operator's own."""
    from pyspark.sql import functions as F

    return frame.withColumns({name: F.lit("clash") for name in names if name not in frame.columns})


def as_set(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
