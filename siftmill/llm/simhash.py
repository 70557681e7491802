"""Near duplicates by SimHash, found by covering locality-sensitive hashing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from siftmill.llm.components import connected_components
from siftmill.session import written

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
# Largest bucket whose members are compared with each other, in one task's
# memory; members of larger ones meet in their shared neighbours instead.
COMPARED = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, A-Z lower-cased.

    Words are what white space (0x20, 0x09-0x0D) leaves. Fewer words than a
    shingle has: the whole sequence is one. No words: zero.
    """
    # bytes.lower() and bytes.split() know exactly A-Z and these six characters
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = len(words) - shingle + 1
    spans = zip(starts[:count].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.fromiter((hashed(joined[a:b], seed) for a, b in spans), np.uint64, count)
    votes = np.zeros(BITS, np.int64)
    for part in range(0, count, 1 << 16):  # a bit matrix of bounded size
        bits = np.unpackbits(hashes[part : part + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > count).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed numbers of 64 bits."""
    found = np.fromiter((fingerprint(text) for text in texts), np.uint64, len(texts))
    return pd.Series(found.view(np.int64))


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks of which, for any ``radius`` bit positions, one has none of them.

    Bit i gets a vector v(i) of radius + 1 bits, other than zero. There is one
    mask for each vector a other than zero: the bits with odd a·v(i). The
    vectors of ``radius`` positions span at most ``radius`` dimensions, so some
    a is orthogonal to all of them: two fingerprints that differ there agree
    under the mask of that a. Dealing the vectors out in turn gives each about
    as many bits, and every mask about half of all.
    """
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << i for i in range(bits) if (a & (i % vectors + 1)).bit_count() % 2)
        for a in range(1, vectors + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of compared buckets; members (a, null) of larger ones.

    The rows come sorted by table and key. What is kept of them is the bucket
    that may go on, until it is too large to be compared.
    """
    rest = pa.table({"id": pa.array([], pa.int64()), "fp": pa.array([], pa.int64()), "table": pa.array([], pa.int32()), "key": pa.array([], pa.int64())})
    large = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rest = pa.concat_tables([rest, pa.Table.from_batches([batch]).cast(rest.schema)])
        if not rest.num_rows:
            continue
        ids, prints, table, key = (rest[c].to_numpy() for c in ("id", "fp", "table", "key"))
        edge = np.flatnonzero(np.concatenate(([True], (table[1:] != table[:-1]) | (key[1:] != key[:-1]), [True])))
        open_size = 0 if batch is None or edge[-1] - edge[-2] > COMPARED else int(edge[-1] - edge[-2])
        if open_size:
            edge = edge[:-1]
        left, right, members = [], [], []
        for start, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if end - start > COMPARED or (table[start], key[start]) == large:
                large = (table[start], key[start])
                members.append(ids[start:end])
            elif end - start > 1:
                for a, b in _forest(prints[start:end].view(np.uint64)):
                    left.append(ids[start + a])
                    right.append(ids[start + b])
        rest = rest.slice(rest.num_rows - open_size)
        if left:
            yield _pairs(left, right, "a", "b")
        if members:
            found = np.concatenate(members)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.nulls(len(found), pa.int64())], ["a", "b"])


def _pairs(left, right, first: str, second: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], [first, second])


def _forest(prints: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of positions that connect all fingerprints within the radius."""
    unseen = np.arange(len(prints))
    while len(unseen) > 1:
        root, unseen = unseen[0], unseen[1:]
        front = np.array([root])
        while len(front) and len(unseen):
            near = np.zeros(len(unseen), bool)
            for at in range(0, len(front), 64):
                part = prints[front[at : at + 64], None] ^ prints[unseen][None, :]
                near |= (np.bitwise_count(part) <= RADIUS).any(axis=0)
            front, unseen = unseen[near], unseen[~near]
            for node in front.tolist():
                yield root, node


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All values within half the radius of each fingerprint, with its id."""
    flips = [sum(1 << i for i in chosen) for n in range(RADIUS // 2 + 1) for chosen in itertools.combinations(range(BITS), n)]
    flips = np.array(flips, np.uint64)
    for batch in batches:
        ids, prints = batch.column("id").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(ids), 32):
            values = prints[at : at + 32, None] ^ flips[None, :]
            yield _pairs(values.ravel().view(np.int64), np.repeat(ids[at : at + 32], len(flips)), "value", "id")


def near_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all ids whose fingerprints differ in at most ``RADIUS`` bits.

    ``nodes`` has one row per different fingerprint: id, fp. The links span the
    same components as all such pairs would; pairs of an already connected
    bucket are not listed. Every fingerprint is put into one bucket of each of
    the 2^(radius+1) - 1 covering tables. Buckets are sorted runs read in a
    stream; small ones are compared. In a larger one, two members differ in at
    most four bits if and only if some value differs from both in at most two,
    so each member names its neighbours within two bits and the members that
    share one are linked: the work grows with the bucket, not with its square.
    Members of several large buckets are taken once, for all of them.
    """
    masks = covering_masks()
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    dealt = nodes.select("id", "fp", F.inline(keys))
    spread = dealt.repartition("table", "key").sortWithinPartitions("table", "key")
    links = written(spread.mapInArrow(_linked, "a bigint, b bigint"), "simhash-links")
    direct = links.filter("b is not null")
    members = links.filter("b is null").select(F.col("a").alias("id")).distinct()
    if members.isEmpty():
        return direct
    shared = nodes.join(members, "id").select("id", "fp").mapInArrow(_neighbours, "value bigint, id bigint")
    least = shared.groupBy("value").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    through = shared.join(least, "value").filter("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    return direct.unionByName(through.distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed 64 bits), component_id.

    ``component_id`` is the smallest id that can be reached over links of
    fingerprints differing in at most ``RADIUS`` bits, the row's own included.
    Null and empty texts and texts of white space have fingerprint zero, which
    is linked like any other. Rows with equal fingerprints are collapsed before
    anything else, so copies cost nothing beyond that. A null id counts as no
    document of its own: it gets its group's component, or null in a group
    without ids. An empty table gives an empty result.
    """
    rows = written(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp")), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    known = nodes.filter("id is not null")
    roots = connected_components(near_links(known))
    labels = nodes.join(roots, nodes["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
