"""Spelling variants: words one edit apart, found by edits probed against Bloom filters.

All edits of a word that may lead to another are generated and hashed, without
their texts, and probed against filters of the vocabulary. Only what a filter
knows becomes text, is shuffled, and joins the vocabulary, which drops the
filters' false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.session import written

LETTERS = "A-Za-zÀ-ÿ"
LAST_SHARD = 48  # words of this length and more share a filter
BITS_PER_WORD = 16
BLOCK_BITS = 512
LANES = BLOCK_BITS // 64
PROBES = 3
MAX_BLOCKS = 1 << 19  # of the filters broadcast at once: 32 MB
EDITS_AT_ONCE = 1 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, drop_every: int | None = None, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: runs of letters of all texts, A-Z in lower case, and how often each is found.

    With ``drop_every``, a run whose hash h = crc32("<id>:<run>") it divides
    loses the letter at h % length. Words with fewer than ``least_length``
    letters or found fewer than ``least_count`` times are left out.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([{letters}]+)"), 1))
    runs = docs.select(F.col(id_col).cast("string").alias("id"), run.alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    # lower() lowers more than A-Z, and is much faster than translate()
    lowered = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _UPPER.lower()))
    words = runs.select("id", lowered.alias("word"))
    if drop_every is not None:
        hashed = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
        at = F.expr("cast(h % char_length(word) as int)")
        shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        words = hashed.select(F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("word")).alias("word"))
    long_enough = words.filter(F.char_length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


# Additive constant and multipliers of the splitmix64 generator.
_GAMMA, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * _GAMMA
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _letter_hash(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Hash of a letter at a place; a word's is the exclusive or of its letters', so an edit changes few terms."""
    return _mixed((place.astype(np.uint64) << np.uint64(21)) | letter.astype(np.uint64))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the words of each length, with a matrix of their code points."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        numbers = np.flatnonzero(sizes == size)
        flat = "".join([words[i] for i in numbers]).encode("utf-32-le", "surrogatepass")
        yield numbers, np.frombuffer(flat, np.uint32).reshape(len(numbers), int(size))


class Sharding:
    """Where each length's filter lies in one numbered row of blocks."""

    def __init__(self, words_by_shard: dict[int, int]):
        blocks = np.zeros(LAST_SHARD + 1, np.int64)
        for shard, words in words_by_shard.items():
            blocks[shard] = -(-words * BITS_PER_WORD // BLOCK_BITS)
        self.blocks = blocks
        self.starts = np.cumsum(blocks) - blocks
        self.total = int(blocks.sum())

    def block(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Block of each hash in the filter of words of this length; -1 without such a filter."""
        shard = min(length, LAST_SHARD)
        if not self.blocks[shard]:
            return np.full(hashes.shape, -1)
        within = ((hashes >> np.uint64(32)) * np.uint64(self.blocks[shard])) >> np.uint64(32)
        return within.astype(np.int64) + self.starts[shard]


def _bit(hashes: np.ndarray, probe: int) -> np.ndarray:
    """Which bit of a block the given probe looks at: nine bits each of the half that did not choose the block."""
    return (hashes >> np.uint64(9 * probe)) & np.uint64(BLOCK_BITS - 1)


class BlockRange:
    """The blocks from ``first`` on of all filters, as many as fit: one round of probing."""

    def __init__(self, sharding: Sharding, first: int, lanes: np.ndarray):
        self.sharding, self.first, self.lanes = sharding, first, lanes

    @classmethod
    def empty(cls, sharding: Sharding, first: int, most: int) -> BlockRange:
        count = min(most, sharding.total - first)
        return cls(sharding, first, np.zeros(count * LANES, np.uint64))

    def _lane(self, block: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return block * LANES + (bit >> np.uint64(6)).astype(np.int64)

    def add(self, length: int, hashes: np.ndarray) -> None:
        block = self.sharding.block(length, hashes) - self.first
        inside = (block >= 0) & (block * LANES < len(self.lanes))
        block, bits = block[inside], hashes[inside]
        for probe in range(PROBES):
            bit = _bit(bits, probe)
            np.bitwise_or.at(self.lanes, self._lane(block, bit), np.uint64(1) << (bit & np.uint64(63)))

    def known(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that the filter has; what is not given here is in no word of this range."""
        block = self.sharding.block(length, hashes) - self.first
        left = np.flatnonzero((block >= 0) & (block * LANES < len(self.lanes)))
        block, bits = block[left], hashes[left]
        for probe in range(PROBES):
            bit = _bit(bits, probe)
            hit = (self.lanes[self._lane(block, bit)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
            left, block, bits = left[hit], block[hit], bits[hit]
        return left

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the blocks that are not empty, and their lanes."""
        lanes = self.lanes.reshape(-1, LANES)
        used = np.flatnonzero(lanes.any(axis=1))
        return used + self.first, lanes[used]


def word_hashes(letters: np.ndarray) -> np.ndarray:
    places = np.arange(letters.shape[1])
    return np.bitwise_xor.reduce(_letter_hash(places[None, :], letters), axis=1)


def deletions(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words with one letter less: row, place and hash; each result once."""
    count, size = letters.shape
    places = np.arange(size)
    here = _letter_hash(places[None, :], letters)
    moved = _letter_hash(places[None, :] - 1, letters)  # place -1 of the first letter is never used
    before = np.zeros((count, size + 1), np.uint64)
    np.bitwise_xor.accumulate(here, axis=1, out=before[:, 1:])
    after = np.zeros((count, size + 1), np.uint64)
    after[:, :size] = np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1]
    hashes = before[:, :size] ^ after[:, 1:]
    # of equal letters in a row, leaving out any gives the same
    first = np.ones((count, size), bool)
    first[:, 1:] = letters[:, 1:] != letters[:, :-1]
    row, place = np.nonzero(first)
    return row, place, hashes[row, place]


def replacements(letters: np.ndarray, hashes: np.ndarray, alphabet: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words with a letter of a higher code point at a place: row, number of the letter and hash."""
    without = hashes ^ _letter_hash(np.array(place), letters[:, place])
    row, letter = np.nonzero(alphabet[None, :] > letters[:, place, None])
    return row, letter, without[row] ^ _letter_hash(np.array(place), alphabet)[letter]


def candidates(words: list[str], filters: BlockRange, alphabet: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Numbers of words and the edited words that the filters may have.

    Being one edit apart goes both ways, so of every pair one direction is
    enough: from the longer word by deletion, and between words of one length
    by a letter of a higher code point.
    """
    numbers: list[np.ndarray] = []
    edited: list[str] = []
    for own, matrix in by_length(words):
        size = matrix.shape[1]
        step = max(1, EDITS_AT_ONCE // max(1, size))
        for at in range(0, len(own), step):
            letters, rows = matrix[at : at + step], own[at : at + step]
            row, place, hashes = deletions(letters)
            hits = filters.known(size - 1, hashes)
            numbers.append(rows[row[hits]])
            edited.extend(words[n][:p] + words[n][p + 1 :] for n, p in zip(numbers[-1].tolist(), place[hits].tolist()))
        step = max(1, EDITS_AT_ONCE // max(1, len(alphabet)))
        for at in range(0, len(own), step):
            letters, rows = matrix[at : at + step], own[at : at + step]
            whole = word_hashes(letters)
            for place in range(size):
                row, letter, hashes = replacements(letters, whole, alphabet, place)
                hits = filters.known(size, hashes)
                numbers.append(rows[row[hits]])
                others = alphabet[letter[hits]].tolist()
                edited.extend(words[n][:place] + chr(c) + words[n][place + 1 :] for n, c in zip(numbers[-1].tolist(), others))
    return (np.concatenate(numbers) if numbers else np.zeros(0, np.int64)), edited


def near_pairs(vocabulary: DataFrame, *, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """word, n, near, near_n for all ordered pairs of words one edit apart; ``vocabulary`` has word, n, each word once.

    The filters are split by word length and broadcast. However large the
    vocabulary, what is broadcast at once is bounded (``max_blocks``): several
    rounds then each probe one range of blocks, so that every edit is looked up
    in exactly one round. The join with the vocabulary by text is exact.
    """
    spark = vocabulary.sparkSession
    shard = F.least(F.char_length("word"), F.lit(LAST_SHARD))
    sizes = vocabulary.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("words")).collect()
    sharding = Sharding({row["shard"]: row["words"] for row in sizes})
    alphabet = np.array(sorted(ord(row[0]) for row in vocabulary.select(F.explode(F.regexp_extract_all("word", F.lit("(?s)."), 0))).distinct().collect()), np.uint32)
    found = None
    for first in range(0, max(1, sharding.total), max_blocks):
        shared = spark.sparkContext.broadcast((_filters(vocabulary, sharding, first, max_blocks), alphabet))

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            filters, alphabet = shared.value
            for batch in batches:
                words = batch.column("word").to_pylist()
                numbers, edited = candidates(words, filters, alphabet)
                own = batch.take(pa.array(numbers, pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column("word"), own.column("n"), pa.array(edited, pa.string())], ["word", "n", "near"])

        positives = vocabulary.select("word", "n").mapInArrow(probe, "word string, n bigint, near string")
        found = positives if found is None else found.unionByName(positives)
    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = found.join(known, "near")
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def _filters(vocabulary: DataFrame, sharding: Sharding, first: int, max_blocks: int) -> BlockRange:
    """One range of blocks with the words of the whole vocabulary: built by every task, combined by block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BlockRange.empty(sharding, first, max_blocks)
        for batch in batches:
            for _, letters in by_length(batch.column("word").to_pylist()):
                step = max(1, EDITS_AT_ONCE // max(1, letters.shape[1]))
                for at in range(0, len(letters), step):
                    own.add(letters.shape[1], word_hashes(letters[at : at + step]))
        blocks, lanes = own.rows()
        for at in range(0, len(blocks), 1 << 14):
            part = lanes[at : at + (1 << 14)].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(blocks[at : at + (1 << 14)]), *[pa.array(part[:, lane]) for lane in range(LANES)]], names)

    names = ["block", *[f"lane{lane}" for lane in range(LANES)]]
    rows = vocabulary.select("word").mapInArrow(build, ", ".join(f"{name} bigint" for name in names))
    combined = rows.groupBy("block").agg(*[F.bit_or(name).alias(name) for name in names[1:]]).toArrow()
    whole = BlockRange.empty(sharding, first, max_blocks)
    lanes = whole.lanes.reshape(-1, LANES)
    blocks = combined.column("block").to_numpy() - first
    for lane, name in enumerate(names[1:]):
        lanes[blocks, lane] = combined.column(name).to_numpy().astype(np.uint64)
    return whole


def spelling_variants(vocabulary: DataFrame, *, ratio: float = 2, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per word of ``vocabulary`` (word, n): word, form, root, n, n_near, form_n.

    Words are near if one letter inserted, deleted or replaced makes one the
    other. A word's form is its most frequent near word (of equals the smallest
    by code point) if that is found at least ``ratio`` (over 1) times as often;
    root is where following the forms ends, the word itself where it has none.

    Rows that repeat a word count as one with their counts added; rows without
    word or count are left out. Words of any length take part. An empty
    table gives an empty result; other columns are not looked at.
    """
    if ratio <= 1:
        raise ValueError("a form has to be found more often than its word")
    words = vocabulary.filter("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    words = written(words, "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_pairs(words, max_blocks=max_blocks).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    forms = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    forms = forms.withColumns({"form": F.when(is_form, F.col("form")), "form_n": F.when(is_form, F.col("form_n"))})
    forms = written(forms, "spelling-forms")
    roots = _roots(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """word, root: every link followed to its end, twice as far in each round.

    Counts at least double from word to form, so paths are short, a few
    rounds at most, and never a circle.
    """
    moved: Column = F.col("next").isNotNull()
    while True:
        onwards = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(links.join(onwards, "root", "left").select("word", F.coalesce("next", "root").alias("root"), moved.alias("moved")), "spelling-roots")
        links = stepped.drop("moved")
        if stepped.filter("moved").isEmpty():
            return links
