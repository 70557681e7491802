import codecs
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import cases
from siftmill.llm import byte_bpe, queries

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(FILE)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = byte_bpe.ByteCodec(FILE, public_tokenizers.PATTERN)

SIGNS = ["a", "b", "ab", "the", "ing", "é", "日本", "\U0001f600", " ", "  ", "\n", "\t", "1", "12", "'s", "'", "x" * 20, "=", "==", "-", "\x00", "́", "\x1c", "\xa0", "<|endoftext|>"]


def plain_merge(data, ranks):
    """Encoding by its definition: the pair of lowest rank first, of equals the leftmost."""
    if data in ranks:
        return [ranks[data]]
    parts = [bytes([b]) for b in data]
    while len(parts) > 1:
        ranked = [(ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        best, at = min(ranked)
        if best == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def test_against_the_library():
    rnd = random.Random(4)
    texts = ["".join(rnd.choices(SIGNS, k=rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rnd.choices("abcdefghij", k=rnd.randint(0, 200))) for _ in range(500)]
    texts += [cases.PROSE, "", None, *[t for _, t, *_ in cases.rows()]]
    ids, bounds = CODEC.encode(texts)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == LIBRARY.encode_ordinary(text or ""), text
        assert CODEC.decode(ids[a:b]) == (text or "")


@pytest.mark.parametrize("piece", ["x", "ab", "aaab", "=", " ", "\n", "abcdefgh", "日本", "'s", "a" * 17 + "b"])
def test_long_pieces(piece):
    text = piece * (20_000 // len(piece))
    assert CODEC.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)
    long = piece * (2_000_000 // len(piece))  # read in parts
    assert CODEC.decode(CODEC.encode([long])[0]) == long


@pytest.mark.parametrize("seed", range(60))
def test_small_vocabularies_against_the_definition(seed):
    """Vocabularies of any shape, tokens that merging never reaches among them."""
    rnd = random.Random(seed)
    letters = "abc"[: rnd.randint(1, 3)].encode()
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 256 + rnd.randint(1, 25):
        token = bytes(rnd.choices(letters, k=rnd.randint(2, 6)))
        ranks.setdefault(token, len(ranks))
    machine = byte_bpe.MergeTransducer(byte_bpe.Vocabulary(ranks), max_states=rnd.choice([3, 20, 10_000]), window=rnd.choice([0, 1, 5, 4096]))
    for _ in range(150):
        data = bytes(rnd.choices(letters, k=rnd.randint(1, 40)))
        out = []
        machine.feed(data, out)
        assert out == plain_merge(data, ranks), data


def test_forgetting_states_changes_nothing():
    machine = byte_bpe.MergeTransducer(CODEC.transducer.vocabulary, max_states=50)
    for text in [cases.PROSE, "x" * 500, "Straße" * 30, "日本語" * 50]:
        out = []
        machine.feed(text.encode(), out)
        assert out == plain_merge(text.encode(), RANKS)
        assert len(machine.states) <= 50


def test_tokens_wait_for_few_bytes():
    """However long the text, all but the last few tokens are settled at any time."""
    machine = byte_bpe.MergeTransducer(CODEC.transducer.vocabulary, window=0)
    waiting = []
    agreed = machine._agreed
    machine._agreed = lambda number, last: waiting.append(len(last)) or agreed(number, last)
    for unit in ["a", "ab", "the", "abcdefgh", "=", "-=", "日本"]:
        out = []
        machine.feed((unit * 2000).encode(), out)
        assert out == LIBRARY._encode_single_piece((unit * 2000).encode())
    longest = max(map(len, RANKS))
    assert max(map(len, machine.states)) <= longest + 1
    assert max(waiting) <= 4 * longest
    assert len(machine.states) < 20_000


def test_memory_bounds_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 5)
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 50)
    monkeypatch.setattr(byte_bpe, "PIECES_AT_ONCE", 3)
    codec = byte_bpe.ByteCodec(FILE, public_tokenizers.PATTERN)
    for text in [cases.PROSE, "a b c " * 100, "word" * 40, ""]:
        assert codec.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.binary(max_size=12), st.lists(st.integers(0, 12), max_size=3))
def test_utf8_machine_against_the_standard_decoder(data, cuts):
    machine, begun, out = byte_bpe.Utf8Machine(), b"", ""
    library, expected = codecs.getincrementaldecoder("utf-8")("replace"), ""
    bounds = [0, *sorted(min(c, len(data)) for c in cuts), len(data)]
    for a, b in zip(bounds, bounds[1:]):
        text, begun = machine.feed(begun, data[a:b])
        out, expected = out + text, expected + library.decode(data[a:b])
        assert out.startswith(expected)  # the library waits longer for some that can't become characters
    assert out + ("�" if begun else "") == expected + library.decode(b"", final=True)


def test_all_lead_and_second_bytes():
    machine = byte_bpe.Utf8Machine()
    for first in range(256):
        for second in range(256):
            for tail in (b"", b"\x80", b"\xbf\x80", b"a"):
                data = bytes([first, second]) + tail
                text, begun = machine.feed(b"", data)
                assert text + ("�" if begun else "") == data.decode("utf-8", "replace"), data


def test_streaming_decode_of_split_characters():
    text = "日本語 \U0001f600 é " * 20
    ids = LIBRARY.encode_ordinary(text)
    begun, out = b"", ""
    for i in ids:
        more, begun = CODEC.decoder.feed(begun, [i])
        out += more
        assert text.startswith(out)
    assert out == text and begun == b""
    rnd = random.Random(6)
    for _ in range(500):
        some = [rnd.choice(ids) if rnd.random() < 0.5 else rnd.randrange(256) for _ in range(rnd.randint(0, 12))]
        data = LIBRARY.decode_bytes(some)
        import numpy as np

        assert CODEC.decode(np.array(some, int)) == data.decode("utf-8", "replace")


def test_documents(spark, tmp_path):
    docs = cases.clashing(cases.documents(spark), ("ids", "tokens", "n_tokens", "decoded"))
    found = byte_bpe.encode_documents(docs, FILE, public_tokenizers.PATTERN)
    expected = [(i, LIBRARY.encode_ordinary(text or "")) for i, text, *_ in cases.rows()]
    expected = sorted(((i, len(ids), b"".join(n.to_bytes(4, "little") for n in ids), text or "") for (i, ids), (_, text, *_) in zip(expected, cases.rows())), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.tokens), r.decoded) for r in found.collect()), key=repr) == expected
    cases.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    digests = sorted(((i, n, hashlib.sha256(t).hexdigest(), hashlib.sha256(x.encode()).hexdigest()) for i, n, t, x in expected), key=repr)
    assert cases.as_set(queries.op13_byte_bpe(spark, str(tmp_path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == digests
    assert byte_bpe.encode_documents(cases.empty(spark), FILE, public_tokenizers.PATTERN).collect() == []


def test_vocabularies_that_lack_bytes_and_patterns_with_groups_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0})
    with pytest.raises(ValueError):
        byte_bpe.ByteCodec(FILE, r"(a)|b")
