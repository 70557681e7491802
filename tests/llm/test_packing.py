import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import cases
from siftmill.llm import packing
from siftmill.llm.queries import op1_packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def checked(rows, length=packing.LENGTH):
    """Pieces make up documents and sequences without gaps; gives the padding's share."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for row in rows:
        sequences[row["sequence_id"]].append(row)
        documents[row["doc_id"]].append(row)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([0] + [p["length"] for p in pieces])
        assert [p["offset"] for p in pieces] == ends[:-1].tolist() and ends[-1] <= length and all(p["length"] for p in pieces)
    used = sum(r["length"] for r in rows)
    return 1 - used / (length * max(len(sequences), 1)), documents


def expected_ids(text):
    return np.array(Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids + [packing.SEPARATOR], "<u4")


def test_edge_cases(spark):
    given = [r for r in cases.rows() if r[0] is not None]
    docs = cases.clashing(cases.documents(spark, given), ("start", "length", "tokens", "sequence_id", "offset", "doc_tokens"))
    _, documents = checked(packing.pack_documents(docs.coalesce(1), VOCABULARY).collect())
    texts = {i: text for i, text, *_ in given}
    assert set(documents) == set(texts)
    for doc, pieces in documents.items():
        ids = expected_ids(texts[doc])
        copies = sum(1 for r in given if r[0] == doc)
        assert all(p["doc_tokens"] == len(ids) for p in pieces)
        covered = np.zeros(len(ids), int)
        for p in pieces:
            piece = ids[p["start"] : p["start"] + p["length"]]
            assert bytes(p["tokens"]) == piece.tobytes()
            covered[p["start"] : p["start"] + p["length"]] += 1
        assert (covered == copies).all()
    assert packing.pack_documents(cases.empty(spark), VOCABULARY).collect() == []
    assert packing.pack_documents(cases.documents(spark), VOCABULARY).filter("doc_id is null").count() > 0


def slow_level(counts, size, length):
    """The level with the smallest sum of squares after placing, tried one by one."""
    best = None
    for level in range(length - size, -1, -1):
        if level and not counts[level]:
            continue
        after = counts.copy()
        if level:
            after[level] -= 1
        if level + size < length:
            after[level + size] += 1
        value = int((after[1:length] ** 2).sum())
        if best is None or value < best[0]:
            best = (value, level)
    return best[1]


def test_placing_against_brute_force():
    rng = random.Random(5)
    packer = packing.SumOfSquares(40)
    for _ in range(600):
        size = rng.randint(1, 40)
        assert packer.level_for(size) == slow_level(packer.counts, size, 40)
        packer.place(packing.Piece(0, 0, np.zeros(size, np.int32), size))
        assert packer.n_open == sum(map(len, packer.open.values())) == packer.counts.sum()


def test_draining_leaves_one_open_sequence():
    rng = random.Random(6)
    docs = [(i, np.full(rng.randint(1, 300), i, np.int32)) for i in range(2000)]
    for max_open in (10**9, 5):
        sequences = list(packing.pack_pieces(iter(docs), 100, max_open))
        gaps = [100 - sum(len(p.ids) for p in s) for s in sequences]
        assert min(gaps) >= 0
        if max_open > 5:
            assert sum(g > packing.SLACK for g in gaps) <= 1
        seen = defaultdict(list)
        for sequence in sequences:
            for p in sequence:
                seen[p.doc].append((p.start, len(p.ids)))
        for i, ids in docs:
            at = 0
            for start, size in sorted(seen[i]):
                assert start == at
                at += size
            assert at == len(ids)


def test_whole_table_with_little_padding(spark):
    rows = op1_packing(spark, "/root/testdata/sf0.01").collect()
    padding, documents = checked(rows)
    assert padding < 0.01
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert set(documents) == set(texts)
    library = Tokenizer.from_file(VOCABULARY)
    for doc, pieces in documents.items():
        ids = np.array(library.encode(texts[doc], add_special_tokens=False).ids + [1], "<u4")
        assert sum(p["length"] for p in pieces) == len(ids)
        assert all(zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in pieces)
