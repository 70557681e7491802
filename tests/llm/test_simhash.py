import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import cases
from siftmill.llm import simhash
from siftmill.llm.components import connected_components


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest reachable id, by comparing all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(prints.items(), 2):
        if (a ^ b).bit_count() <= simhash.RADIUS:
            high, low = sorted((find(i), find(j)), reverse=True)
            root[high] = low
    return {i: find(i) for i in prints}


def test_masks_cover_every_choice_of_bits():
    masks = simhash.covering_masks()
    assert len(masks) == 31
    rng = random.Random(3)
    for _ in range(5000):
        flipped = sum(1 << i for i in rng.sample(range(64), simhash.RADIUS))
        assert any(mask & flipped == 0 for mask in masks)
    # fewer bits: exhaustively, radius 2 over 10 bits
    small = simhash.covering_masks(2, 10)
    assert all(any(m & (1 << i | 1 << j) == 0 for m in small) for i in range(10) for j in range(10))


def test_fingerprints(spark):
    for _, text, *_ in cases.rows():
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(" \n") == simhash.fingerprint(None) == 0


def test_fingerprint_hash_is_that_of_spark(spark):
    text = "four words of text"
    assert spark.range(1).select(F.xxhash64(F.lit(text)) == F.lit(simhash._signed(simhash.fingerprint(text)))).first()[0]


@pytest.mark.parametrize("compared", [4096, 8, 2])
def test_links_against_all_pairs(spark, monkeypatch, compared):
    """Clusters of walks: chains of near values whose ends are far apart; small limits force the way of large buckets."""
    rng = random.Random(compared)
    values = set()
    for _ in range(6):
        value = rng.getrandbits(64)
        for _ in range(40):
            values.add(value)
            value ^= sum(1 << i for i in rng.sample(range(64), rng.choice([1, 2, 4, 5, 9])))
    prints = dict(enumerate(sorted(values)))
    nodes = spark.createDataFrame([(i, simhash._signed(v)) for i, v in prints.items()], "id bigint, fp bigint")

    def limited(batches):
        simhash.COMPARED = compared
        return linked(batches)

    linked = simhash._linked
    monkeypatch.setattr(simhash, "_linked", limited)
    found = {r["node"]: r["root"] for r in connected_components(simhash.near_links(nodes)).collect()}
    assert {i: found.get(i, i) for i in prints} == components(prints)


def test_documents_against_brute_force(spark):
    rows = [r for r in cases.rows() if r[0] is not None]
    rows += [(100 + i, cases.PROSE + f" {i}", "en", "s", 0) for i in range(5)] + [(200, "", "en", "s", 0)]
    docs = cases.clashing(cases.documents(spark, rows), ("fp", "id", "component_id", "root", "node", "table", "key"))
    expected = components({i: slow_fingerprint(text) for i, text, *_ in rows})
    found = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex(F.col("fp")).alias("fp"), "component_id").collect()
    assert len(found) == len(rows)
    prints = {i: f"{slow_fingerprint(text):016x}" for i, text, *_ in rows}
    assert all(r["component_id"] == expected[r["doc_id"]] and r["fp"] == prints[r["doc_id"]] for r in found)


def test_null_ids_and_empty_table(spark):
    found = simhash.near_duplicates(cases.documents(spark)).filter("doc_id is null").collect()
    # the text that only a null id has is of no component; the null text belongs to the empty ones
    assert sorted((r["component_id"] for r in found), key=repr) == [4, None]
    assert simhash.near_duplicates(cases.empty(spark)).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(200)] + [(5, 5)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in connected_components(frame).collect()}
    assert found == {i: 0 for i in range(301)} | {1000: 1000} | {2000 + i: 1000 for i in range(200)}
    assert connected_components(frame.limit(0)).collect() == []
