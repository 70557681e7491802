import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

import cases
from siftmill.llm import token_count
from siftmill.llm.queries import op8_token_count

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=MODEL)
LETTERS = ["a", "b", "the", " ", "  ", "\n", "é", "日本", "\U0001f600", "\x00", "▁", "e", "s", "tion", "<0x0A>", "́"]


@pytest.mark.parametrize("letters", [LETTERS, ["a"], ["a", "aa", "e"], [" ", "a"], ["e", "s", "st", "er"]])
def test_spliced_chunks_against_whole_texts(letters):
    counter = token_count.PieceCounter(MODEL, chunk=64, overlap=4)
    rng = random.Random(len(letters))
    for _ in range(150):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 600)))
        assert counter.count(text) == len(LIBRARY.encode(text)), text


def test_overlaps_are_widened_where_nothing_aligns():
    counter = token_count.PieceCounter(MODEL, chunk=32, overlap=1)
    text = "=" * 500 + " and then " + "aaaa" * 100
    assert counter.count(text) == len(LIBRARY.encode(text))
    assert counter.widened > 0


def test_huge_text_takes_the_spliced_way():
    counter = token_count.PieceCounter(MODEL)
    text = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
    assert counter._spliced(text) == len(LIBRARY.encode(text)) == counter.count(text)


def test_edge_cases(spark):
    docs = cases.clashing(cases.documents(spark), ("n_bytes", "n_tokens", "over_limit"))
    found = token_count.count_tokens(docs, MODEL)
    expected = [(i, len((t or "").encode()), len(LIBRARY.encode(t or "")), len(LIBRARY.encode(t or "")) > 4096) for i, t, *_ in cases.rows()]
    assert cases.as_set(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expected, key=repr)
    assert token_count.count_tokens(cases.empty(spark), MODEL).collect() == []


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r["doc_id"]: r["n_tokens"] for r in op8_token_count(spark, sf_dir).collect()}
    assert found == {i: len(LIBRARY.encode(t)) for i, t in texts.items()}
