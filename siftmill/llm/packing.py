"""Packing of documents into training sequences by the sum-of-squares rule."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.pools import slices
from siftmill.llm.word_bpe import codec_of

LENGTH = 2048
SEPARATOR = 1
MAX_OPEN = 4096  # partially filled sequences a task holds: 32 MB of ids
SLACK = 8  # padding that a sequence may be closed with

_SCHEMA = "start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tokens binary"


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, size: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:size], self.total), Piece(self.doc, self.start + size, self.ids[size:], self.total)


class SumOfSquares:
    """Online packing: ``counts[h]`` is the number of open sequences filled up to level h.

    A piece goes to the level that makes the sum of the squared counts smallest,
    which keeps open sequences of many different levels ready for what comes.
    """

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)
        self.open: dict[int, deque[list[Piece]]] = {}
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The best level for a piece; 0 opens a sequence. Of equals the fullest."""
        last = self.length - size
        # moving one sequence from level h to h + size: -2·counts[h] + 1, and
        # 2·counts[h + size] + 1 unless it is full then; squares of full ones don't count
        change = 2 * self.counts[size:] + 1
        change[last] = 0
        change[1:] += np.where(self.counts[1 : last + 1] > 0, 1 - 2 * self.counts[1 : last + 1], 4 * self.n_open + 4)
        return last - int(change[::-1].argmin())

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts a piece somewhere; gives the sequence if that filled it."""
        level = self.level_for(len(piece.ids))
        if level:
            at_level = self.open[level]
            sequence = at_level.popleft()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            sequence = []
        sequence.append(piece)
        filled = level + len(piece.ids)
        if filled == self.length:
            return sequence
        self.open.setdefault(filled, deque()).append(sequence)
        self.counts[filled] += 1
        self.n_open += 1
        return None

    def drain(self, slack: int = SLACK) -> Iterator[list[Piece]]:
        """Closes all open sequences, the fullest first; the pieces of the emptiest fill their gaps.

        Gaps of up to ``slack`` stay. At most one other sequence is not full.
        """
        rest = deque(s for level in sorted(self.open, reverse=True) for s in self.open[level])
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        while rest:
            sequence = rest.popleft()
            gap = self.length - sum(len(p.ids) for p in sequence)
            while gap > slack and rest:
                donor = rest[-1]
                piece = donor.pop()
                if len(piece.ids) > gap:
                    piece, left = piece.cut(gap)
                    donor.append(left)
                if not donor:
                    rest.pop()
                sequence.append(piece)
                gap -= len(piece.ids)
            yield sequence


def pack_pieces(documents: Iterator[tuple[object, np.ndarray]], length: int = LENGTH, max_open: int = MAX_OPEN) -> Iterator[list[Piece]]:
    """Sequences of pieces from documents given as id and token ids.

    A document longer than a sequence fills sequences of its own; its rest, like
    any shorter document, is placed whole. Pieces are cut beyond that only where
    open sequences are closed.
    """
    packer = SumOfSquares(length)
    for doc, ids in documents:
        whole = len(ids) // length * length
        for start in range(0, whole, length):
            yield [Piece(doc, start, ids[start : start + length], len(ids))]
        if whole < len(ids):
            full = packer.place(Piece(doc, whole, ids[whole:], len(ids)))
            if full is not None:
                yield full
            if packer.n_open > max_open:
                yield from packer.drain()
    yield from packer.drain()


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, tokens.

    A document is its token ids and then ``separator``; a null or empty text is
    the separator alone. ``tokens`` are the piece's ids as unsigned 32-bit
    little-endian numbers, ``start`` counts the document's ids before it,
    ``offset`` the sequence's. Every id lies in one piece. Sequences hold at most
    ``length`` ids.

    Every task packs the rows it reads, in their order, without a shuffle, and
    holds a bounded number of open sequences. A sequence id is the task's
    partition, shifted, plus a running number, so a task that runs again gives
    the same. A task leaves one sequence at most that is padded by more than
    ``SLACK``. Repeated rows and null ids are documents like others; an empty
    table gives no sequences; other columns are not looked at.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        kind = None

        def documents():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("doc_id").type
                for part, texts in slices(batch):
                    ids, bounds = codec.encode(texts)
                    for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                        yield doc, np.append(ids[a:b], np.int32(separator))

        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        for sequence in pack_pieces(documents(), length):
            offset = 0
            for piece in sequence:
                rows.append((piece.doc, piece.start, len(piece.ids), piece.total, number, offset, piece.ids.astype("<u4").tobytes()))
                offset += len(piece.ids)
            number += 1
            if len(rows) >= 4096:
                yield _batch(rows, kind)
                rows = []
        if rows:
            yield _batch(rows, kind)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pack, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tokens"]
    types = [kind, *[pa.int64()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows), types)], names)
