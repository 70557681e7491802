"""Exact token counts, also of huge documents, by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

LIMIT = 4096
CHUNK = 1 << 14  # characters a chunk adds
OVERLAP = 256  # characters two chunks share at first


class PieceCounter:
    """Counts the pieces a sentencepiece model gives for a text.

    A text longer than a chunk is encoded in overlapping chunks. Two chunks are
    spliced at a token both have, with the same place and id: every pair of
    neighbouring tokens of the spliced sequence is then a pair of neighbours in
    one of the chunks. By-pair merging has found such a pair stable, and a
    sequence all of whose neighbouring pairs are stable is the encoding of the
    whole: the first merge across a border of two tokens would have happened in
    their chunk as well, as nothing but their own characters takes part in it.
    Where the chunks have no common token, the overlap is doubled, up to the
    whole text.
    """

    def __init__(self, model: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap = chunk, overlap
        size = self.model.get_piece_size()
        # bytes of text that each piece stands for; the space mark is one byte there
        self.sizes = np.array([
            1 if self.model.is_byte(i) else len(self.model.id_to_piece(i).replace("▁", " ").encode()) for i in range(size)
        ])
        self.unknown = self.model.unk_id()
        self.widened = 0

    def count(self, text: str | None) -> int:
        text = text or ""
        found = self._spliced(text) if len(text) > self.chunk + self.overlap else None
        return len(self.model.encode(text)) if found is None else found

    def _encoded(self, text: str, chunk: _Chunk) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a chunk and the byte, counted in the whole text, at which each ends.

        None if the pieces do not stand for the chunk's bytes one by one, as
        where a model normalises characters.
        """
        part = text[chunk.start : chunk.end + chunk.overlap]
        ids = np.array(self.model.encode(part), np.int64)
        ends = np.cumsum(self.sizes[ids])
        if not len(ids) or (ids == self.unknown).any() or ends[-1] != len(part.encode()) + 1:
            return None
        return ids, ends - 1 + chunk.byte  # the model puts one space before a text

    def _spliced(self, text: str) -> int | None:
        """The count by chunks; None if the text has to be encoded as a whole."""
        chunks, byte = [], 0
        for start in range(0, len(text), self.chunk):
            end = min(start + self.chunk, len(text))
            chunks.append(_Chunk(start, end, self.overlap, byte))
            byte += len(text[start:end].encode())
        at = 0
        while at < len(chunks):
            here = chunks[at]
            if here.tokens is None:
                here.tokens = self._encoded(text, here)
                if here.tokens is None:
                    return None
            if at == 0:
                at += 1
                continue
            before = chunks[at - 1]
            here.splice = _common_token(before, here)
            if here.splice is not None:
                at += 1
                continue
            # no common token: the left chunk reaches further, in the end over the right one
            self.widened += 1
            if before.overlap < self.chunk:
                before.overlap *= 2
            else:
                before.end = here.end
                del chunks[at]
            before.tokens = None
            at -= 1  # the left chunk has to fit its own neighbour again
        total = 0
        for here, following in zip(chunks, [*chunks[1:], None]):
            total += (len(here.tokens[0]) if following is None else following.splice[0]) - here.splice[1]
        return total


@dataclass
class _Chunk:
    start: int
    end: int
    overlap: int
    byte: int
    tokens: tuple[np.ndarray, np.ndarray] | None = None
    # tokens of the left neighbour up to the common one, own tokens up to it
    splice: tuple[int, int] = (0, 0)


def _common_token(left: _Chunk, right: _Chunk) -> tuple[int, int] | None:
    """How many tokens of each chunk end with the first token that both have."""
    (left_ids, left_ends), (right_ids, right_ends) = left.tokens, right.tokens
    # the right chunk's first token has a space that the text lacks; what lies
    # before the left chunk's own splice is not its to give
    skip = max(left.splice[1] - 1, 0)
    shared, at_left, at_right = np.intersect1d(left_ends[skip:], right_ends[1:], return_indices=True)
    at_left, at_right = at_left + skip, at_right + 1
    starts = np.concatenate(([-1], left_ends[:-1]))[at_left]
    same = np.flatnonzero((left_ids[at_left] == right_ids[at_right]) & (starts == right_ends[at_right - 1]))
    return (int(at_left[same[0]]) + 1, int(at_right[same[0]]) + 1) if len(same) else None


def count_tokens(docs: DataFrame, model: str, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``n_tokens`` is what the sentencepiece model gives for the whole text,
    without begin and end; null counts as empty and has no tokens. Rows are
    independent: repeats, null ids and other columns change nothing.
    """

    @F.pandas_udf(LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = PieceCounter(model, chunk, overlap)
        for texts in batches:
            yield pd.Series([counter.count(text) for text in texts], dtype="int64")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), counted("text").alias("n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
