from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from siftmill.llm import langid
from siftmill.llm.queries import op2_language_id


def model(spark):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("the cat and the dog with that", "en"), ("der hund und die katze nicht", "de"), ("le chat et les chiens avec", "fr")] * 5)]
    return langid.train(cases.documents(spark, rows))


def test_edge_cases(spark):
    known = model(spark)
    assert known.languages == ("de", "en", "fr")
    docs = cases.clashing(cases.documents(spark), ("p", "lang_pred", "score", "held_out"))
    found = {(r["doc_id"]): r for r in langid.identify_languages(docs, known).filter("doc_id is not null").collect()}
    for i in (4, 5, 6, 8):  # null, empty, white space, no letter
        assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    assert found[11]["lang_pred"] == "de" and found[1]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert langid.identify_languages(cases.empty(spark), known).collect() == []


def test_nothing_to_learn_from(spark):
    known = langid.train(cases.empty(spark))
    assert {r["lang_pred"] for r in langid.identify_languages(cases.documents(spark), known).collect()} == {"und"}


def test_counts_against_brute_force(spark):
    """Log probabilities are those of the n-grams counted one by one."""
    rows = [(1, "Ab c", "x", "s", 0), (2, "ab", "x", "s", 0), (3, "zz", "y", "s", 0), (4, None, "y", "s", 0), (5, "q", None, "s", 0)]
    known = langid.train(cases.documents(spark, rows))
    for column, texts in enumerate((["ab c", "ab"], ["zz"])):
        counts = np.zeros(1 << langid.BUCKET_BITS)
        for text in texts:
            padded = f" {text} "
            for order in langid.ORDERS:
                for at in range(len(padded) - order + 1):
                    gram = padded[at : at + order]
                    if gram.strip():
                        counts[_bucket(gram)] += 1
        counts += langid.SMOOTHING
        assert np.allclose(known.log_prob[column], np.log(counts / counts.sum()), atol=1e-5)


def _bucket(gram):
    value = ord(gram[0])
    for c in gram[1:]:
        value = (value * 0x01000193 + ord(c)) % (1 << 32)
    value = (value ^ (len(gram) * 0x9E3779B9 % (1 << 32))) * 0x85EBCA6B % (1 << 32)
    value = (value ^ (value >> 15)) * 0xC2B2AE35 % (1 << 32)
    return value >> (32 - langid.BUCKET_BITS)


TEXTS = ["der hund und die katze " * 50, "a", "", None, " \t", "x" * 1000, "ΣΑΣ ΟΔΟΣ. é😀日本 İ" * 40, "12 34", "ab cd", "the"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 100, 1 << 18])
def test_chunks_change_nothing(monkeypatch, chunk):
    """However a text is cut, its n-grams are those of the whole, counted one by one."""
    monkeypatch.setattr(langid, "CHUNK", chunk)
    for text in TEXTS:
        padded = f" {''.join(c if c.isalpha() else ' ' for c in (text or '').lower())} "
        grams = [padded[at : at + n] for n in langid.ORDERS for at in range(len(padded) - n + 1)]
        wanted = Counter(_bucket(gram) for gram in grams if gram.strip(" "))
        assert Counter(np.concatenate(list(langid.text_buckets(text or ""))).tolist()) == wanted


@pytest.mark.parametrize("chunk", [1, 10, 100, 1 << 18])
def test_batches_against_one_text_at_a_time(monkeypatch, chunk):
    rnd = np.random.default_rng(1)
    model = langid.Model(("a", "b", "c"), np.log(rnd.random((3, 1 << langid.BUCKET_BITS))).astype(np.float32))
    wanted = [np.concatenate(list(langid.text_buckets(text or ""))) for text in TEXTS]
    monkeypatch.setattr(langid, "CHUNK", chunk)
    totals, grams, lettered = langid.score_texts(TEXTS, model)
    assert grams.tolist() == [len(buckets) for buckets in wanted]
    assert np.allclose(totals, [model.log_prob[:, buckets].sum(axis=1, dtype=np.float64) for buckets in wanted])
    assert lettered.tolist() == [any(c.isalpha() for c in text or "") for text in TEXTS]
    languages, scores = langid.predict_texts(TEXTS, model)
    assert [x == "und" for x in languages] == [not x for x in lettered.tolist()] and (scores[~lettered] == 0).all()


def test_many_languages(spark):
    """As many languages as there are labels, 600 here; each text finds its own."""
    words = ["".join(chr(97 + (i // 26**k + 7 * k) % 26) for k in range(5)) for i in range(600)]
    rows = [(i, f"{w} {w[::-1]} {w}", f"l{i}", "s", 0) for i, w in enumerate(words)]
    docs = cases.documents(spark, rows)
    known = langid.train(docs)
    assert len(known.languages) == 600
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(docs, known).collect()}
    assert sum(found[i] == f"l{i}" for i in range(600)) > 590


def test_rows_that_share_an_id_are_sampled_by_their_texts(spark):
    rows = [(1, f"wort nummer {i} und", "de", "s", 0) for i in range(400)]
    docs = cases.documents(spark, rows)
    one = langid.train(docs, rows_per_language=100)
    all_rows = langid.train(docs, rows_per_language=400)
    counts = [np.exp(-m.log_prob[0].min()) for m in (one, all_rows)]  # grows with the n-grams learned from
    assert 0.1 < counts[0] / counts[1] < 0.5


def test_ties(spark):
    rows = [(1, "gleich", "b", "s", 0), (2, "gleich", "a", "s", 0)]
    known = langid.train(cases.documents(spark, rows))
    assert langid.predict_texts(["gleich"], known)[0] == ["a"]


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    found = op2_language_id(spark, sf_dir).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_held_out_rows(spark):
    import zlib

    ids = spark.range(50).select(F.col("id").alias("doc_id"), langid.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in ids)
