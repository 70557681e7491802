import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import cases
from siftmill.llm import word_bpe
from siftmill.llm.queries import op7_word_bpe
from siftmill.llm.word_bpe import Transducer, WordCodec

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
LEXICON = word_bpe.compile_lexicon("the and of thing things sing sings 'tis it's straße σας a,b <|endoftext|> two words a\x1cb".split(" "), VOCABULARY)


def same(codec, texts):
    ids, bounds = codec.encode(texts)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        expected = LIBRARY.encode(text or "", add_special_tokens=False).ids
        own = ids[a:b].tolist()
        assert own == expected, text
        assert codec.decode(own) == LIBRARY.decode(expected, skip_special_tokens=False), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab sΣİ'\x1c\x85́ <|>"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_as_the_library(texts):
    same(WordCodec(VOCABULARY, LEXICON), texts)


def test_special_tokens_and_known_words():
    same(WordCodec(VOCABULARY, LEXICON), ["<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "Things AND sings it's", "ΣΑΣ Σας", "x\x1cy\x1ez", None, "", "x" * 5000])


def test_transducer_against_a_dictionary():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) + rng.choice(["", "ing", "ings", "é"]) for _ in range(3000)})
    machine = Transducer.compile((w.encode(), [i, i + 1][: i % 3]) for i, w in enumerate(words))
    numbers = machine.numbers([w.encode() for w in words] + [b"", b"zz", b"abcabcabcabc", words[0].encode() + b"!"])
    order = sorted(range(len(words)), key=lambda i: words[i].encode())
    assert [order[n] for n in numbers[: len(words)]] == list(range(len(words)))
    assert (numbers[len(words) :] == -1).all()
    for i, number in enumerate(numbers[: len(words)]):
        at = slice(machine.starts[number], machine.starts[number + 1])
        assert machine.ids[at].tolist() == [i, i + 1][: i % 3]
    # endings are shared: far fewer states than letters
    assert len(machine.final) < 0.5 * sum(map(len, words))


def test_file_is_mapped(tmp_path):
    path = tmp_path / "words.fst"
    path.write_bytes(LEXICON.to_bytes())
    mapped = Transducer.mapped(str(path))
    words = [b"the", b"sings", b"nothing"]
    assert mapped.numbers(words).tolist() == LEXICON.numbers(words).tolist()
    assert type(mapped.arcs).__name__ == "memmap"


def test_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(word_bpe, "MEMO_WORDS", 5)
    codec = WordCodec(VOCABULARY, LEXICON)
    for i in range(20):
        same(codec, [f"word{i} thing{i} the", "and"])
    assert len(codec.parts) < 12


def test_edge_cases(spark):
    docs = cases.clashing(cases.documents(spark), ("ids", "decoded", "word", "n"))
    found = word_bpe.encode_documents(docs, VOCABULARY, share=1 << 12).collect()
    texts = {(i, t or "") for i, t, *_ in cases.rows()}
    assert len(found) == len(cases.rows())
    expected = sorted(((i, LIBRARY.encode(t, add_special_tokens=False).ids) for i, t in texts), key=repr)
    unique = sorted({(r["doc_id"], tuple(r["ids"])) for r in found}, key=lambda x: repr((x[0], list(x[1]))))
    assert [(i, list(ids)) for i, ids in unique] == sorted(expected, key=repr)
    assert word_bpe.encode_documents(cases.empty(spark), VOCABULARY).collect() == []


def test_digests_of_a_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_word_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        assert [row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]] == [len(ids), *digests]


def test_long_words_are_merged_like_short_ones(monkeypatch):
    """Words of any length go through the merges; the library is not asked."""
    codec = WordCodec(public_tokenizers.path("word_bpe_49k.json"))
    library, codec.library = codec.library, None
    rnd = random.Random(8)
    texts = ["x" * 5000, "ab" * 3000, "aaab" * 2000, "=" * 999, "日本" * 700, "".join(rnd.choices("abcdefghijklmnop", k=4000))]
    ids, bounds = codec.encode(texts)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


def test_marks_that_the_library_orders_otherwise():
    codec = WordCodec(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("a\u0899\u0337b", "a\u0337\u0899b \u0301x", "e\u0301 e\u0327\u0301"):
        ids, _ = codec.encode([text, "plain"])
        assert ids.tolist() == [i for t in (text, "plain") for i in codec.library.encode(t, add_special_tokens=False).ids]


def test_memory_holds_words_not_stretches(monkeypatch):
    """Words in ever new company are remembered once, and merged once while rarer ones are forgotten."""
    words = [a + b for a in "bcdfghjklm" for b in ("arn", "oth", "emp")]
    codec = WordCodec(VOCABULARY)
    same(codec, [" ".join(f"{a}{sign}{b}" for b in words for sign in ("-", "...", "'s_")) for a in words])
    assert len(codec.parts) <= len(words) + 5
    merged = []
    merge = codec.merges.merge
    monkeypatch.setattr(codec.merges, "merge", lambda own: merged.extend(own) or merge(own))
    monkeypatch.setattr(word_bpe, "MEMO_WORDS", 100)
    for i in range(12):
        rare = ["".join(chr(ord("a") + int(c)) for c in f"{i:02}{j:02}") for j in range(60)]
        same(codec, [" ".join([*rare, *words, *(words if i < 11 else [f"{a}!{a}" for a in words])])])
    assert len(codec.parts) <= 100 + 60 + 5
    assert not set(merged) & {word.encode() for word in words}


def test_words_begin_and_end_as_in_the_library():
    texts = ["'s", "s", "''s", "!'s", "x's't", "it'", "s've", "'re've'll'd'm", "'resten 'llama 'dare", "'S 'RE 'ſ", "don't've", "a1'2b", "'́s 'ś", " \u0085x\x1c's\x1fy᠎", "", "'", "re", None, "İ's ΑΣ'Σ"]
    codec = WordCodec(VOCABULARY, LEXICON)
    same(codec, texts)
    same(codec, [*texts, "<|endoftext|>'s <|endoftext|>", "a͸b 's", " <|endoftext|>", ""])
    same(codec, [])
    same(codec, [None, "", " \n"])
