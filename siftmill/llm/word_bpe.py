"""Encoding and decoding with a word-level BPE vocabulary over a compiled lexicon.

The vocabulary splits text at white space first, so what stands between white
space is encoded by itself. Frequent ones of these words are compiled, with
their ids, into a minimal acyclic transducer; unseen ones are merged exactly.
"""

from __future__ import annotations

import io
import json
import os
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.pools import Numbers, Pool, slices, spread
from siftmill.session import shared_folder

LEXICON_SHARE = 1 << 19  # a word is frequent if it is found once in so many bytes
MEMO_WORDS = 200_000  # words a worker remembers; beyond, the half that came least is forgotten
MERGED_AT_ONCE = 1 << 14  # unseen words merged together
# The vocabulary's own rule for words, matched by the same Unicode classes:
# 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_STRETCH = regex.compile(r"\S+")


def normalise(word: str) -> str:
    """NFC and lower case, each character by itself as the vocabulary does it."""
    return unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()


class Transducer:
    """Minimal acyclic automaton over bytes whose arcs add up to a word's number.

    Words with a common ending share its states. The number leads to the word's
    ids. All parts are flat arrays, so that a file of them can be memory-mapped.
    """

    PARTS = ("arcs", "adds", "final", "classes", "starts", "ids")

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)

    @classmethod
    def compile(cls, entries: Iterable[tuple[bytes, list[int]]]) -> Transducer:
        """From different words, sorted here, each with its ids."""
        entries = sorted(entries)
        registry: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []

        def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
            # equal final flag and arcs: the same state, as all targets are settled
            key = (final, tuple(arcs))
            if key not in registry:
                registry[key] = len(states)
                states.append(key)
            return registry[key]

        # the path of the last word: final flag, settled arcs; byte towards the next
        path: list[list] = [[False, []]]
        taken: list[int] = []
        for word, _ in entries:
            common = 0
            while common < min(len(word), len(taken)) and word[common] == taken[common]:
                common += 1
            while len(taken) > common:
                final, arcs = path.pop()
                path[-1][1].append((taken.pop(), settle(final, arcs)))
            for byte in word[common:]:
                taken.append(byte)
                path.append([False, []])
            path[-1][0] = True
        while taken:
            final, arcs = path.pop()
            path[-1][1].append((taken.pop(), settle(final, arcs)))
        root = settle(*path[0])
        used = sorted({byte for _, arcs in states for byte, _ in arcs})
        classes = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
        classes[used] = np.arange(1, len(used) + 1)
        # targets are settled before their sources; the root comes last
        words = np.zeros(len(states), np.int64)
        table = np.full((len(states) + 1, len(used) + 1), len(states), np.int32)
        adds = np.zeros_like(table)
        for state, (final, arcs) in enumerate(states):
            passed = int(final)
            for byte, target in arcs:
                table[state, classes[byte]] = target
                adds[state, classes[byte]] = passed
                passed += words[target]
            words[state] = passed
        final = np.array([final for final, _ in states] + [False])
        assert root == len(states) - 1
        sizes = [len(ids) for _, ids in entries]
        flat = [i for _, ids in entries for i in ids]
        return cls(arcs=table, adds=adds, final=final, classes=classes, starts=np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), ids=np.array(flat, np.int32))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 for unknown ones; all words walk together, byte by byte."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        letters = self.classes[np.frombuffer(b"".join(words), np.uint8)]
        at = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        dead, root = len(self.final) - 1, len(self.final) - 2
        state, number = np.full(len(words), root), np.zeros(len(words), np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            alive = int(np.searchsorted(-sizes, -step))  # words longer than this step
            letter = letters[at[:alive] + step]
            number[:alive] += self.adds[state[:alive], letter]
            state[:alive] = self.arcs[state[:alive], letter]
            if (state[:alive] == dead).all():
                break
        found = np.empty(len(words), np.int64)
        found[order] = np.where(self.final[state], number, -1)
        return found

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        for part in self.PARTS:
            np.lib.format.write_array(out, np.ascontiguousarray(getattr(self, part)), version=(1, 0), allow_pickle=False)
        return out.getvalue()

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        """The arrays of a file, memory-mapped."""
        parts = {}
        with open(path, "rb") as file:
            for part in cls.PARTS:
                np.lib.format.read_magic(file)
                shape, _, kind = np.lib.format.read_array_header_1_0(file)
                parts[part] = np.memmap(path, kind, "r", file.tell(), shape) if np.prod(shape) else np.zeros(shape, kind)
                file.seek(int(np.prod(shape)) * kind.itemsize, 1)
        return cls(**parts)


class PairMerges:
    """Byte-pair merging of many words at once, with the vocabulary's merges."""

    def __init__(self, model: dict):
        ids = model["vocab"]
        suffix = model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(ids.values()) + 1
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs])
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        names = _byte_names()
        self.inner = np.array([ids[name] for name in names], np.int64)
        self.last = np.array([ids[name + suffix] for name in names], np.int64)
        self.none = len(made)  # rank of a pair that is never merged

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], self.none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has.

        In every round each word merges all its pairs of the lowest rank, from
        the left; words without a pair are done. (What a merge makes is part of
        later merges only, so doing all at once changes nothing.)
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[letters]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[letters[ends - 1]]
        numbers = np.arange(len(words))
        ranks = np.full(len(symbols), self.none)
        ranks[:-1] = self._rank(symbols[:-1], symbols[1:])
        ranks[ends - 1] = self.none
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(numbers):
            best = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
            open_ = best < self.none
            if not open_.all():
                stays = np.repeat(open_, sizes)
                done.append((numbers[~open_], sizes[~open_], symbols[~stays]))
                symbols, ranks = symbols[stays], ranks[stays]
                numbers, sizes, best = numbers[open_], sizes[open_], best[open_]
                if not len(numbers):
                    break
            word = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(ranks == best[word])
            # of pairs that overlap, as in a run of one symbol, every other one from the left
            first = np.concatenate(([True], at[1:] != at[:-1] + 1))
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[best[word[at]]]
            sizes = sizes - np.bincount(word[at], minlength=len(sizes))
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            symbols, ranks = symbols[kept], ranks[kept]
            at = at - np.arange(len(at))  # every merge before has taken one symbol away
            touched = np.concatenate((at[at > 0] - 1, at))
            touched = touched[touched + 1 < len(symbols)]
            ranks[touched] = self._rank(symbols[touched], symbols[touched + 1])
            ranks[np.cumsum(sizes) - 1] = self.none
        numbers, sizes, symbols = (np.concatenate(parts) for parts in zip(*done)) if done else (np.zeros(0, np.int64),) * 3
        back = np.argsort(numbers, kind="stable")
        after = np.cumsum(sizes)
        return spread(symbols, (after - sizes)[back], after[back])[0], sizes[back]


def _byte_names() -> list[str]:
    """The character that stands for each byte in the vocabulary's tokens.

    Printable bytes stand for themselves, the others for the characters from
    256 on, in order.
    """
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(byte if byte in printable else next(rest)) for byte in range(256)]


class WordCodec:
    """Encodes texts as the tokenizers library does with a word BPE file, and decodes.

    All texts are cut together into words: letters, one digit, or other signs in
    a row. Different words are looked up in the lexicon and merged if unseen;
    words seen are remembered, up to a bound. Stretches between white space that
    have special tokens or unassigned characters are left to the library.
    """

    def __init__(self, vocabulary: str, lexicon: Transducer | None = None):
        # a task has one core; the library's own threads would take those of other tasks
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        with open(vocabulary, encoding="utf-8") as file:
            rules = json.load(file)
        self.merges = PairMerges(rules["model"])
        self.special = [token["content"] for token in rules["added_tokens"]]
        names = self.library.get_vocab(with_added_tokens=True)
        self.tokens = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.tokens[i] = name
        # characters that Python's Unicode tables don't have yet may be letters elsewhere;
        # marks that the library's tables order in another way than Python's, or not at all
        norm = self.library.normalizer.normalize_str
        every = _every_character()
        self.unlike = np.fromiter((unicodedata.category(c) == "Cn" for c in every), bool, len(every))
        for c in filter(unicodedata.combining, every):
            self.unlike[ord(c)] |= any(norm(text) != normalise(text) for text in (f"a{c}\u0334", f"a\u0300{c}"))
        self.kinds = _kinds()
        self.lexicon = lexicon
        # words remembered, as UTF-8, their ids, and how often each came lately
        self.parts, self.part_ids, self.uses = Numbers(), Pool(), np.zeros(0, np.int64)

    def _turn(self) -> None:
        """Forgets the words that came least, and half of how often the others came."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: MEMO_WORDS // 2])
        ids, ends = self.part_ids.gather(kept)
        words = list(self.parts)
        self.parts, self.part_ids, self.uses = Numbers(), Pool(), self.uses[kept] // 2
        self.parts.update((words[old], new) for new, old in enumerate(kept.tolist()))
        self.part_ids.add(ids, np.diff(ends, prepend=0))

    def _foreign(self, text: str) -> bool:
        """Whether only the library may encode it."""
        return any(token in text for token in self.special) or (not text.isascii() and bool(self.unlike[_points(text)].any()))

    def _cut(self, texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """Words of all texts one after the other, as UTF-8, and where each text's words end."""
        texts = [normalise(text) for text in texts]
        points = _points("\n".join([*texts, ""]))
        kinds = self.kinds[points]
        first = kinds != np.concatenate(([_SPACE], kinds[:-1]))
        first |= kinds == _DIGIT
        first &= kinds != _SPACE
        # 's and the like are words if the apostrophe begins one; the text's last sign is white space
        at = np.flatnonzero(points == ord("'"))
        at = at[first[at]]
        for ending in _ENDINGS:
            own = at[at + len(ending) < len(points)]
            for i, letter in enumerate(ending):
                own = own[points[own + 1 + i] == ord(letter)]
            after = own + 1 + len(ending)
            first[own + 1] = False
            first[after[kinds[after] == _LETTER]] = True
        starts = np.flatnonzero(first)
        ends = np.searchsorted(starts, np.cumsum(np.fromiter((len(text) + 1 for text in texts), np.int64, len(texts))))
        signs = kinds != _SPACE
        points, first = points[signs], first[signs]
        data = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        at = np.flatnonzero(first)
        if len(data) > len(points):
            sizes = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            at = (np.cumsum(sizes, dtype=np.int64) - sizes)[at]
        offsets = np.append(at, len(data)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), ends

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words: from the lexicon where it has them, else merged."""
        known = np.full(len(words), -1) if self.lexicon is None else self.lexicon.numbers(words)
        seen, unseen = np.flatnonzero(known >= 0), np.flatnonzero(known < 0)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, ids, sizes
        if len(seen):
            starts, ends = self.lexicon.starts[known[seen]], self.lexicon.starts[known[seen] + 1]
            found.append((seen, spread(self.lexicon.ids, starts, ends)[0], ends - starts))
        for at in range(0, len(unseen), MERGED_AT_ONCE):
            part = unseen[at : at + MERGED_AT_ONCE]
            found.append((part, *self.merges.merge([words[i] for i in part.tolist()])))
        numbers, ids, sizes = (np.concatenate(x) for x in zip(*found))
        back, after = np.argsort(numbers, kind="stable"), np.cumsum(sizes)
        self.part_ids.add(spread(ids, (after - sizes)[back], after[back])[0], sizes[back])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that need no library, and where each text's ids end."""
        if len(self.parts) > MEMO_WORDS:
            self._turn()
        words, ends = self._cut(texts)
        coded = words.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.parts.__getitem__, different), np.int64, len(different))
        new, self.parts.new = self.parts.new, []
        if new:
            self._learn(new)
            self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int64)))
        at = coded.indices.to_numpy()
        self.uses[numbers] += np.bincount(at, minlength=len(different))
        numbers = numbers[at]
        ids, after = self.part_ids.gather(numbers)
        return ids, np.concatenate(([0], after))[ends]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids start (and the last's end)."""
        texts = [text or "" for text in texts]
        if not self._foreign("\n".join(texts)):
            ids, ends = self._encode(texts)
            return ids, np.concatenate(([0], ends)).astype(np.int64)
        # no word goes across white space: texts are cut there, and what is foreign goes to the library
        pieces, foreign, bounds = [], [], [0]
        for text in texts:
            if self._foreign(text):
                for other, run in groupby(_STRETCH.findall(text), self._foreign):
                    run = list(run) if other else [" ".join(run)]
                    pieces += run
                    foreign += [other] * len(run)
            else:
                pieces.append(text)
                foreign.append(False)
            bounds.append(len(pieces))
        alien = {piece: self.library.encode(piece, add_special_tokens=False).ids for piece in {p for p, other in zip(pieces, foreign) if other}}
        ids, ends = self._encode([p for p, other in zip(pieces, foreign) if not other])
        more = [alien[p] for p, other in zip(pieces, foreign) if other]
        sizes = np.concatenate((np.diff(ends, prepend=0), list(map(len, more)))).astype(np.int64)
        back, stops = np.argsort(np.argsort(foreign, kind="stable"), kind="stable"), np.cumsum(sizes)
        ids, ends = spread(np.concatenate((ids, *(np.array(x, np.int32) for x in more))), (stops - sizes)[back], stops[back])
        return ids, np.concatenate(([0], ends)).astype(np.int64)[bounds]

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens included: this kind of vocabulary joins its tokens by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str | None], WordCodec] = {}


def codec_of(vocabulary: str, lexicon: str | None = None) -> WordCodec:
    """The codec of this worker process: a task finds what tasks before it have learned.

    ``lexicon`` is a file's path; one codec is kept, as memories are large.
    """
    if (vocabulary, lexicon) not in _codecs:
        _codecs.clear()
        _codecs[vocabulary, lexicon] = WordCodec(vocabulary, Transducer.mapped(lexicon) if lexicon else None)
    return _codecs[vocabulary, lexicon]


def _points(text: str) -> np.ndarray:
    """Its code points."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8).astype(np.uint32)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _every_character() -> str:
    return np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def _kinds() -> np.ndarray:
    """What each code point is to the vocabulary's rule for words."""
    kinds = np.full(0x110000, _SIGN, np.uint8)
    every = _every_character()
    for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+")):
        for run in regex.finditer(pattern, every):
            kinds[run.start() : run.end()] = kind
    return kinds


def frequent_words(docs: DataFrame, *, text_col: str = "text", share: int = LEXICON_SHARE) -> DataFrame:
    """Words, in lower case, that make up at least one in ``share`` bytes' worth of all texts.

    A word and the white space after it have two bytes at least, so there are
    ``share`` / 2 such words at most, however large the table.
    """
    size = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2, size / share)).select("word")


def compile_lexicon(texts: list[str], vocabulary: str) -> Transducer:
    """Transducer of the words of the given texts."""
    codec = WordCodec(vocabulary)
    codec.encode(texts)
    ids, ends = codec.part_ids.gather(np.arange(len(codec.parts)))
    starts = np.concatenate(([0], ends))
    return Transducer.compile((word, ids[a:b].tolist()) for word, a, b in zip(codec.parts, starts[:-1], starts[1:]))


def publish(spark: SparkSession, data: bytes, name: str) -> str:
    """Puts a file into the shared folder and has Spark fetch it to every executor; gives its name there."""
    folder = shared_folder(spark, "lexicon")
    name = f"{folder.rsplit('-', 1)[-1]}-{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        for at in range(0, len(data), 1 << 22):
            out.write(bytearray(data[at : at + (1 << 22)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", share: int = LEXICON_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, decoded.

    ``ids`` are those of the tokenizers library without added special tokens,
    ``decoded`` is the text it gives back for them, special tokens included.
    Whole texts are encoded; special tokens inside them count as such, as by the
    library's default. Null and empty texts have no ids. The lexicon holds the
    frequent words of all documents, ``share`` / 2 at most; which words it has
    changes no result. Nulls and repeats in other columns
    play no part, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    words = [row["word"] for row in frequent_words(docs, text_col=text_col, share=share).collect()]
    name = publish(spark, compile_lexicon(words, vocabulary).to_bytes(), "words.fst")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary, SparkFiles.get(name))
        for batch in batches:
            for part, texts in slices(batch):
                ids, bounds = codec.encode(texts)
                flat = ids.tolist()
                decoded = [codec.decode(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, ids array<int>, decoded string")
