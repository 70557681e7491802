"""Byte-level BPE as a finite-state transducer, and streaming decoding.

Merging by rank looks at a whole piece of text at once; the transducer reads it
byte by byte. It rests on this: tokens t1 … tn are the encoding of their text if
each two neighbours are the encoding of theirs. (A merge across a border happens
in the whole text if and only if it happens in the pair around that border,
because up to the first such merge both sides change by themselves alone.) So
every beginning of a piece has one encoding, a way to go on from it is one token
that its last token bears, and a state is the set of beginnings that a token
under way may still start from.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.pools import SLICE_BYTES, Numbers, Pool, slices, spread

MAX_STATES = 200_000  # determinised states kept; all are forgotten beyond
WINDOW = 1 << 12  # bytes of a piece after which what is settled is emitted
MEMO_PIECES = 400_000  # pieces of a generation, and their characters; two generations are remembered
MEMO_CHARS = 1 << 24
PIECES_AT_ONCE = 1 << 16

NONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ids, the lower the earlier merged, from a file of base64 text."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Vocabulary:
    """Tokens by id, a trie of their bytes, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte has to be a token")
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.children: dict[int, int] = {}  # node · 256 + byte: node
        self.token_at = [NONE]
        self.depths = [0]  # bytes to each node
        self.inner = {0}  # nodes with children
        for token, rank in ranks.items():
            self.tokens[rank] = token
            node = 0
            for byte in token:
                self.inner.add(node)
                following = self.children.get(node << 8 | byte)
                if following is None:
                    following = self.children[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(NONE)
                    self.depths.append(self.depths[node] + 1)
                node = following
            self.token_at[node] = rank
        self._sides: dict[int, tuple | None] = {}
        self._pairs: dict[int, bool] = {}

    def _borders(self, token: int) -> tuple | None:
        """How the first and the last symbol of a token change while it is merged, or None if it is not.

        Two lists, for the left and the right border: (symbol, highest rank
        merged until the next symbol takes its place). A token that merging
        breaks down otherwise has no borders.
        """
        if token not in self._sides:
            symbols = [bytes([b]) for b in self.tokens[token]]
            left, right = [[symbols[0], NONE]], [[symbols[-1], NONE]]
            while len(symbols) > 1:
                ranked = [self.ranks.get(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
                best = min((rank for rank in ranked if rank != NONE), default=NONE)
                if best == NONE:
                    break
                at = ranked.index(best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                for side, border in ((left, 0), (right, len(symbols) - 1)):
                    side[-1][1] = max(side[-1][1], best)
                    if at == border:
                        side.append([symbols[at], NONE])
            self._sides[token] = (left, right) if len(symbols) == 1 else None
        return self._sides[token]

    def stands(self, token: int) -> bool:
        """Whether merging a token's bytes gives that token."""
        return self._borders(token) is not None

    def follows(self, first: int, second: int) -> bool:
        """Whether merging the bytes of both gives these two: no merge crosses their border.

        Both sides are merged in the order of the whole: the lower rank first,
        of equals the left one. A merge across the border would come first if
        its rank is lower than what stands in line on either side.
        """
        key = first << 32 | second
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2 * MAX_STATES:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(self._borders(first), self._borders(second))
        return known

    def _apart(self, first: tuple | None, second: tuple | None) -> bool:
        if first is None or second is None:
            return False
        left, right = first[1], second[0]
        i = j = 0
        endless = len(self.tokens)
        while True:
            crossing = self.ranks.get(left[i][0] + right[j][0])
            ours = left[i][1] if i + 1 < len(left) else endless
            theirs = right[j][1] if j + 1 < len(right) else endless
            if crossing is not None and crossing < ours and crossing <= theirs:
                return False
            if ours == endless and theirs == endless:
                return True
            if ours <= theirs:
                i += 1
            else:
                j += 1


class MergeTransducer:
    """Deterministic transducer over bytes, built as far as texts need it.

    A state is a set of readings: for every beginning that a token under way may
    start from, the last token of that beginning, which the next one has to
    follow, and the trie node of the bytes since. An arc gives the last token of
    the piece up to there: one of the readings ends in a token that may follow, and
    only one, as a beginning has one encoding. Beginnings that no
    reading starts from are given up, so once all readings go back to the same
    beginning, its tokens are emitted. At most as many readings are alive as the
    longest token has bytes, so tokens wait for few bytes only.
    """

    def __init__(self, vocabulary: Vocabulary, max_states: int = MAX_STATES, window: int = WINDOW):
        self.vocabulary, self.max_states, self.window = vocabulary, max_states, window
        self.sizes = [len(token) for token in vocabulary.tokens]
        self.node_bits = len(vocabulary.token_at).bit_length()
        self.token_bits = len(vocabulary.tokens).bit_length()
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.arcs: dict[int, int] = {}  # state · 256 + byte: state and token in one number
        self._state((0,))

    def _state(self, state: tuple[int, ...]) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        return number

    def _arc(self, number: int, byte: int) -> int:
        """Determinises one arc."""
        vocabulary, bits = self.vocabulary, self.node_bits
        child, inner, token_at, mask = vocabulary.children.get, vocabulary.inner, vocabulary.token_at, (1 << bits) - 1
        grown: list[int] = []
        reached = NONE
        for reading in self.states[number]:
            node = child((reading & mask) << 8 | byte)
            if node is None:
                continue
            before = reading >> bits  # the last token's id and 1, or 0 at the beginning of the piece
            if node in inner:
                grown.append(before << bits | node)
            token = token_at[node]
            if reached == NONE and token != NONE:
                if vocabulary.follows(before - 1, token) if before else vocabulary.stands(token):
                    reached = token
        grown.append(reached + 1 << bits)
        full = len(self.states) >= self.max_states
        if full:
            self._forget()
        arc = self._state(tuple(grown)) << self.token_bits | reached
        if not full:
            self.arcs[number << 8 | byte] = arc
        return arc

    def _tokens(self, last: list[int], end: int) -> list[int]:
        """Tokens of a beginning, given the last token of every beginning."""
        found = []
        while end:
            token = last[end - 1]
            found.append(token)
            end -= self.sizes[token]
        return found[::-1]

    def _agreed(self, number: int, last: list[int]) -> int:
        """The beginning that all readings of a state go back to."""
        mask, node_sizes = (1 << self.node_bits) - 1, self.vocabulary.depths
        starts = {len(last) - node_sizes[reading & mask] for reading in self.states[number]}
        while len(starts) > 1:
            latest = max(starts)
            starts.remove(latest)
            starts.add(latest - self.sizes[last[latest - 1]])
        return starts.pop()

    def feed(self, piece: bytes, out: list[int]) -> None:
        """Appends the ids of a piece; what is settled of a very long one is emitted on the way."""
        whole = self.vocabulary.ranks.get(piece)
        if whole is not None:
            out.append(whole)  # a piece that is a token is that token, however its bytes would merge
            return
        number, known, token_bits, mask = 0, self.arcs.get, self.token_bits, (1 << self.token_bits) - 1
        last: list[int] = []
        for byte in piece:
            arc = known(number << 8 | byte)
            if arc is None:
                arc = self._arc(number, byte)
                known = self.arcs.get  # new ones if all were forgotten
            number = arc >> token_bits
            last.append(arc & mask)
            if len(last) > self.window:
                settled = self._agreed(number, last)
                out.extend(self._tokens(last, settled))
                del last[:settled]
        out.extend(self._tokens(last, len(last)))


class Utf8Machine:
    """Incremental UTF-8: state after state, with text as soon as it is complete.

    A state is the bytes of a character begun, at most three. What can't
    belong to any character becomes U+FFFD, once for each longest beginning of
    a character, as the Unicode standard recommends.
    """

    def __init__(self):
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    @staticmethod
    def _room(begun: bytes) -> tuple[int, int, int]:
        """Bytes missing after these, and the range of the next."""
        lead = begun[0]
        size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        low, high = 0x80, 0xBF
        if len(begun) == 1:
            # no overlong forms, no surrogates, nothing beyond U+10FFFF
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (low, high))
        return size - len(begun), low, high

    def step(self, begun: bytes, byte: int) -> tuple[str, bytes]:
        """Text that a byte completes, and the state after it."""
        move = self.moves.get((begun, byte))
        if move is None:
            move = self.moves[begun, byte] = self._step(begun, byte)
        return move

    def _step(self, begun: bytes, byte: int) -> tuple[str, bytes]:
        if begun:
            missing, low, high = self._room(begun)
            if not low <= byte <= high:
                text, state = self._step(b"", byte)
                return "�" + text, state
            full = begun + bytes([byte])
            return (full.decode("utf-8"), b"") if missing == 1 else ("", full)
        if byte < 0x80:
            return chr(byte), b""
        return ("", bytes([byte])) if 0xC2 <= byte <= 0xF4 else ("�", b"")

    def feed(self, begun: bytes, data: bytes) -> tuple[str, bytes]:
        out = []
        for byte in data:
            text, begun = self.step(begun, byte)
            out.append(text)
        return "".join(out), begun


class StreamDecoder:
    """Decodes ids as they come; the same machine, with arcs over whole tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.machine = Utf8Machine()
        self.arcs: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        plain = [self.machine.feed(b"", token) for token in tokens]
        self.texts = [text for text, _ in plain]
        #: tokens that are complete characters by themselves: from no state they lead to none
        self.whole = np.array([state == b"" and "�" not in text for text, state in plain])

    def feed(self, begun: bytes, ids: Iterable[int]) -> tuple[str, bytes]:
        """Text of further ids, and the state after them."""
        out = []
        for i in ids:
            if not begun and self.whole[i]:
                out.append(self.texts[i])
                continue
            arc = self.arcs.get((begun, i))
            if arc is None:
                arc = self.arcs[begun, i] = self.machine.feed(begun, self.tokens[i])
            text, begun = arc
            out.append(text)
        return "".join(out), begun

    def decode(self, ids: np.ndarray) -> str:
        """Text of all ids of a document."""
        if self.whole[ids].all():
            return "".join(map(self.texts.__getitem__, ids.tolist()))
        text, begun = self.feed(b"", ids.tolist())
        return text + "�" if begun else text


class ByteCodec:
    """Encodes texts piece by piece, each match of a pattern separately, and decodes ids.

    Pieces are remembered; what is not remembered is read by the transducer. Once
    a generation is full, the one before is forgotten, and pieces that come again
    are taken over from the last.
    """

    def __init__(self, ranks: str, pattern: str):
        vocabulary = Vocabulary(read_ranks(ranks))
        self.pattern = regex.compile(pattern)
        if self.pattern.groups:
            raise ValueError("the pattern must not have groups")
        self.transducer = MergeTransducer(vocabulary)
        self.decoder = StreamDecoder(vocabulary.tokens)
        self.pieces, self.ids, self.chars = Numbers(), Pool(), 0
        self.older: tuple[dict[str, int], Pool] = {}, Pool()

    def _turn(self) -> None:
        """Begins a new generation."""
        self.older = dict(self.pieces), self.ids
        self.pieces, self.ids, self.chars = Numbers(), Pool(), 0

    def _learn(self) -> None:
        new, self.pieces.new = self.pieces.new, []
        self.chars += sum(map(len, new))
        known, pool = self.older
        numbers = np.fromiter((known.get(piece, NONE) for piece in new), np.int64, len(new))
        again = np.flatnonzero(numbers != NONE)
        out: list[int] = []
        ends = []
        for place in np.flatnonzero(numbers == NONE).tolist():
            self.transducer.feed(new[place].encode("utf-8", "surrogatepass"), out)
            ends.append(len(out))
        if not len(again):
            self.ids.add(np.array(out, np.int32), np.diff(ends, prepend=0))
            return
        taken, after = pool.gather(numbers[again])
        ids = np.concatenate((taken, np.array(out, np.int32)))
        order = np.concatenate((again, np.flatnonzero(numbers == NONE)))
        sizes = np.concatenate((np.diff(after, prepend=0), np.diff(ends, prepend=0))).astype(np.int64)
        back, stops = np.argsort(order, kind="stable"), np.cumsum(sizes)
        self.ids.add(spread(ids, (stops - sizes)[back], stops[back])[0], sizes[back])

    def _of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and where each piece's end."""
        if len(self.pieces) > MEMO_PIECES or self.chars > MEMO_CHARS:
            self._turn()
        numbers = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        if self.pieces.new:
            self._learn()
        return self.ids.gather(numbers)

    def _in_parts(self, text: str) -> np.ndarray:
        """Ids of a very long text, some pieces at a time."""
        found = (match[0] for match in self.pattern.finditer(text))
        rows = []
        while pieces := list(islice(found, PIECES_AT_ONCE)):
            rows.append(self._of(pieces)[0])
        return np.concatenate(rows)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids start (and the last's end)."""
        if len(texts) == 1 and len(texts[0] or "") > SLICE_BYTES:
            ids = self._in_parts(texts[0])
            return ids, np.array([0, len(ids)])
        pieces: list[str] = []
        after = [0]
        for text in texts:
            pieces += self.pattern.findall(text or "")
            after.append(len(pieces))
        ids, ends = self._of(pieces)
        return ids, np.concatenate(([0], ends))[after].astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.decoder.decode(ids)


_codecs: dict[tuple[str, str], ByteCodec] = {}


def codec_of(ranks: str, pattern: str) -> ByteCodec:
    """The codec of this worker process: a task finds what tasks before it have learned."""
    if (ranks, pattern) not in _codecs:
        _codecs[ranks, pattern] = ByteCodec(ranks, pattern)
    return _codecs[ranks, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, tokens, decoded.

    ``tokens`` are the ids of the whole text, as unsigned 32-bit little-endian
    numbers, merged by the ranks of the file for each match of ``pattern``
    separately and without special tokens; ``decoded`` is the text that the ids
    give back. Null and empty texts have no ids. A text of any length is read
    match by match, and a match of any length byte by byte. Each
    row is worked on by itself, so ties, repeated rows, null ids and an empty
    table need no rule; other columns are not looked at.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks, pattern)
        for batch in batches:
            for part, texts in slices(batch):
                ids, bounds = codec.encode(texts)
                decoded = [codec.decode(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                data = pa.py_buffer(ids.astype("<u4").tobytes())
                places = pa.py_buffer((bounds * 4).astype(np.int32).tobytes())
                tokens = pa.Array.from_buffers(pa.binary(), len(texts), [None, places, data])
                columns = [part.column("doc_id"), pa.array(np.diff(bounds)), tokens, pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "tokens", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, n_tokens bigint, tokens binary, decoded string")
