"""Licence notices in documents, found by conditional compression."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.license_texts import TEMPLATES

TRIGGERS = ("licen", "copyright", "permission", "public domain", "redistribut")
LEVEL = 3
TOLERANCE = 0.1  # differing words, as a share of the template's
LOOK_AHEAD = 8  # words after a notice in which it may go on

_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
_TRIGGER = re.compile("|".join(TRIGGERS))
# Words that tell licences apart: a difference in one of them is another licence.
_TELLING = frozenset(
    "mit apache gnu gpl lgpl agpl bsd cc cc0 by sa nc nd mozilla mpl isc epl bsl unlicense noncommercial sharealike noderivatives lesser affero not "
    "only later".split()
)
_NEVER = 1 << 20  # cost of a word that may not be missing or added


@dataclass(frozen=True)
class Notice:
    """A notice found: licence, place in the text, bytes saved, words that differ."""

    license: str
    start: int
    end: int
    saved_bytes: int
    covered: float
    differences: tuple[str, ...]


class _Template:
    """One wording: its words, what each costs if missing, and its text as raw dictionary content."""

    def __init__(self, name: str, wording: str, plain: zstandard.ZstdCompressor):
        self.name, own = name, wording.lower().encode()
        content = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False)
        self.whole = max(len(plain.compress(own)) - len(self.compressor.compress(own)), 1)
        self.words = _WORD.findall(wording.lower())
        self.allowed = int(TOLERANCE * len(self.words))
        self.reach = len(self.words) + self.allowed  # no notice has more words
        self.distinct = frozenset(self.words)
        self.needed = frozenset(word for word in self.words if _tells(word))
        self.numbers = {word: i for i, word in enumerate(self.distinct)}
        self.codes = np.array([self.numbers[word] for word in self.words])
        self.missing = np.concatenate([[0], np.cumsum([_NEVER if _tells(word) else 1 for word in self.words])])

    def possible(self, words: set[str]) -> bool:
        """False only where too many words, or one that tells, are not there at all."""
        return self.needed <= words and len(self.distinct - words) <= self.allowed

    def aligned(self, words: list[str], at: int) -> tuple[int, int, list[str], list[str]] | None:
        """The part of ``words`` around number ``at`` that differs least: first and last common word, words missing and added.

        Fewest words missing and added over all parts and alignments; None if
        more than allowed or one that tells.
        """
        size, codes = len(self.words), np.array([self.numbers.get(word, -1) for word in words])
        added = [_NEVER if _tells(word) else 1 for word in words]
        costs = np.empty((len(words) + 1, size + 1), np.int64)
        costs[0] = self.missing
        for i, (code, cost) in enumerate(zip(codes, added)):
            row = costs[i] + cost
            row[0] = 0  # words before the part cost nothing
            np.minimum(row[1:], np.where(self.codes == code, costs[i, :-1], _NEVER), out=row[1:])
            costs[i + 1] = np.minimum.accumulate(row - self.missing) + self.missing
        ends = np.flatnonzero(costs[:, size] <= self.allowed)
        for end in sorted(ends.tolist(), key=lambda e: (costs[e, size], e)):
            i, j, common, missing, extra = end, size, [], [], []
            while j:
                if i and codes[i - 1] == self.codes[j - 1] and costs[i, j] == costs[i - 1, j - 1]:
                    i, j = i - 1, j - 1
                    common.append(i)
                elif i and costs[i, j] == costs[i - 1, j] + added[i - 1]:
                    i -= 1
                    extra.append(words[i])
                else:
                    j -= 1
                    missing.append(self.words[j])
            if common and common[-1] <= at <= common[0]:
                return common[-1], common[0], missing[::-1], extra[::-1]
        return None


class Scanner:
    """Compresses the words around every trigger with all templates, and confirms in the order of what they save.

    The template that saves most of the block's compressed size, as raw
    dictionary content, comes first. The first one whose wording is there, but for
    differences that are allowed, is the notice.
    """

    def __init__(self, templates=TEMPLATES):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.templates = [_Template(name, wording, self.plain) for name, wording in templates]
        self.reach = max((template.reach for template in self.templates), default=0)

    def notices(self, text: str | None) -> list[Notice]:
        """All notices of a text, in order, not overlapping."""
        lowered = "".join(c if len(c) == 1 else " " for c in map(str.lower, text or "")) if text and not text.isascii() else (text or "").lower()
        if not any(trigger in lowered for trigger in TRIGGERS):
            return []
        starts = array("q", (m.start() for m in _WORD.finditer(lowered)))
        found: list[Notice] = []
        done = 0
        for trigger in _TRIGGER.finditer(lowered):
            if trigger.start() < done:
                continue
            notice = self.best(lowered, starts, done, trigger.start())
            if notice is not None:
                found.append(notice)
                done = notice.end
        return found

    def ranked(self, text: str, places: list[re.Match], number: int) -> list[tuple[int, _Template, int, int]]:
        """Templates by what they save of the block they may stand in, most first: bytes, template, first and last word.

        A template's block reaches as far to each side of word ``number`` as a
        notice of its wording could. Of equals the one with the most of its own
        comes last, as it has saved a smaller share.
        """
        plain: dict[tuple[int, int], int] = {}
        found = []
        for template in self.templates:
            low, high = max(0, number - template.reach), min(len(places), number + template.reach + 1)
            block = text[places[low].start() : places[high - 1].end()].encode("utf-8", "surrogatepass")
            if (low, high) not in plain:
                plain[low, high] = len(self.plain.compress(block))
            found.append((plain[low, high] - len(template.compressor.compress(block)), template, low, high))
        return sorted(found, key=lambda item: (-item[0], item[1].whole))

    def best(self, text: str, starts: array, done: int, at: int) -> Notice | None:
        """The notice around a trigger at ``at``, not beginning before ``done``."""
        number = bisect_right(starts, at) - 1
        first = max(bisect_left(starts, done), number - self.reach)
        places = [_WORD.match(text, start) for start in starts[first : number + self.reach + 1]]
        number -= first
        words = [place[0] for place in places]
        seen = set(words)
        if not any(template.possible(seen) for template in self.templates):
            return None  # no ranking could confirm anything
        for saved, template, low, high in self.ranked(text, places, number):
            aligned = self.confirmed(template, words[low:high], number - low, words[high : high + LOOK_AHEAD])
            if aligned is not None:
                start, end = places[low + aligned[0]].start(), places[low + aligned[1]].end()
                differences = tuple(f"-{w}" for w in aligned[2]) + tuple(f"+{w}" for w in aligned[3])
                return Notice(template.name, start, end, saved, saved / template.whole, differences)
        return None

    @staticmethod
    def confirmed(template: _Template, words: list[str], at: int, after: list[str]) -> tuple[int, int, list[str], list[str]] | None:
        """The exact differences in wording if they are allowed.

        What names one version only is not confirmed where the text goes on
        with later ones.
        """
        aligned = template.aligned(words, at) if template.possible(set(words)) else None
        if aligned is not None and template.name.endswith("-only"):
            following = [*words, *after][aligned[1] + 1 : aligned[1] + 1 + LOOK_AHEAD]
            if following[:1] == ["or"] and "later" in following:
                return None
        return aligned


def _tells(word: str) -> bool:
    return word in _TELLING or word[0].isdigit()


_SCHEMA = "license string, start bigint, end bigint, saved_bytes bigint, covered double, differences array<string>"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice found: doc_id, license, start, end, saved_bytes, covered, differences.

    ``start`` and ``end`` are code points of the text. The words around those of
    ``TRIGGERS`` are compressed with all templates, in whole texts and over line
    ends, and wordings are compared in the order of what was saved, of equals
    the template first that saves less of itself. A notice's wording differs from the template's in at most a tenth of
    the words, none of them a number or a licence's name; ``differences`` lists
    them, ``-`` missing and ``+`` added. ``saved_bytes`` is what the template
    saves of the notice's compressed size, ``covered`` that as a share of what
    it saves of its own. Null and empty texts have no notices; rows are independent:
    repeats, null ids and other columns change nothing, and an empty table has none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            names, rows = batch.column("doc_id"), []
            for i, text in enumerate(batch.column("text").to_pylist()):
                rows += [(i, n.license, n.start, n.end, n.saved_bytes, n.covered, list(n.differences)) for n in scanner.notices(text)]
            if rows:
                at, *columns = zip(*rows)
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string())]
                made = [pa.array(c, t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), *made], ["doc_id", "license", "start", "end", "saved_bytes", "covered", "differences"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")
