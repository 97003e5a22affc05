"""Cutting oversized texts at natural boundaries (problem 2): recursive bisection."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .canonical import sliced

# Unicode White_Space, and the words that open a numbered heading.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
HEADING_WORDS = "Chapter|Section|Part|Article|Chapitre|Partie|Titre|Chương|Mục|Phần|Điều"

KINDS = ("forced", "word", "sentence", "line", "paragraph", "heading")
_SPACE = f"[{WHITE}]"
_BREAKS = "\n\x0b\x0c\r\x85\u2028\u2029"
_WORD = re.compile(f"{_SPACE}+")
_SENTENCE = re.compile(f"[.!?…。！？]+[\"'”’»)\\]]*{_SPACE}+")
_LINE = re.compile(f"{_SPACE}*[{_BREAKS}]{_SPACE}*")
_HEADING = re.compile(rf"#{{1,6}}{_SPACE}|(?:{HEADING_WORDS}){_SPACE}+[0-9IVXLC]+\b", re.IGNORECASE)
_JOINED = re.compile("[\u0300-\u036f\u200d\ufe00-\ufe0f\u20d0-\u20ff\U0001f3fb-\U0001f3ff]")
_RUN = re.compile(f"[^{WHITE}]+")

#: Most distinct settings that one call takes; they are sent to every task.
MOST_SETTINGS = 10_000


class Boundaries:
    """Places of a text where it may be cut, by strength, in order."""

    def __init__(self, text: str):
        self.text = text
        self.at: list[list[int]] = [[] for _ in KINDS]
        self.at[1] = [m.end() for m in _WORD.finditer(text)]
        self.at[2] = [m.end() for m in _SENTENCE.finditer(text)]
        for m in _LINE.finditer(text):
            broken = sum(m.group().count(b) for b in _BREAKS) - m.group().count("\r\n")
            strength = 5 if _HEADING.match(text, m.end()) else 4 if broken > 1 else 3
            self.at[strength].append(m.end())
        self.longest = max((m.end() - m.start() for m in _RUN.finditer(text)), default=0)

    def nearest(self, strength: int, first: int, final: int, middle: int) -> int | None:
        """The place of this strength nearest to the middle within first..final; the earlier one of two."""
        places = self.at[strength]
        i = bisect_left(places, middle)
        found = [p for p in places[max(0, i - 1) : i + 1] if first <= p <= final]
        return min(found, key=lambda p: (abs(p - middle), p), default=None)

    def cut(self, start: int, end: int, margin: int, least: int) -> tuple[int, int]:
        """Where to halve start..end, not before `least`, and the strength of the boundary there."""
        middle = max((start + end) // 2, least)
        for strength in range(len(KINDS) - 1, 0, -1):
            place = self.nearest(strength, max(start + margin, least), end - margin, middle)
            if place is not None:
                return place, strength
        place = self.nearest(1, max(start + 1, least), end - 1, middle)  # outside the middle, rather than inside a word
        if place is not None:
            return place, 1
        place = middle
        while place > max(start + 1, least) and (_JOINED.match(self.text, place) or self.text[place - 1] == "\u200d"):
            place -= 1
        return (place if place > max(start + 1, least) else middle), 0


def pieces(bounds: Boundaries, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut before it) of each piece, overlaps included; none is longer than size."""
    length = len(bounds.text)
    if length <= size:
        return [(0, length, len(KINDS))]
    core = size - overlap
    done: list[tuple[int, int, int]] = []
    todo = [(0, length, len(KINDS))]
    while todo:
        start, end, strength = todo.pop()
        if end - start <= core:
            done.append((start, end, strength))
            continue
        half = (end - start) // 2
        margin = min(half, max((end - start) // 4, overlap))
        place, kind = bounds.cut(start, end, margin, max(start + 1, overlap))
        todo += [(place, end, kind), (start, place, strength)]
    return [(max(0, start - overlap), end, strength) for start, end, strength in done]


def settings_of(cells: DataFrame, size: str = "chunk_size", overlap: str = "chunk_overlap") -> list[tuple[int, int]]:
    """The distinct (size, overlap) pairs of a table; rows without a positive size are left out, no overlap is 0."""
    rows = cells.select(F.col(size).cast("int").alias("s"), F.coalesce(F.col(overlap).cast("int"), F.lit(0)).alias("o"))
    found = rows.where("s > 0").distinct().limit(MOST_SETTINGS + 1).collect()
    if len(found) > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings")
    for r in found:
        if not 0 <= r.o <= r.s // 2:
            raise ValueError(f"overlap {r.o} must lie between 0 and half the size {r.s}")
    return sorted((r.s, r.o) for r in found)


def _over(df: DataFrame, key: str, text: str, settings, schema: str, each) -> DataFrame:
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = [{"string": pa.string(), "int": pa.int32()}[x] for x in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1_000_000):
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bounds = Boundaries(t)
                for size, overlap in settings:
                    out += each(k, t, bounds, size, overlap)
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=list(names))

    return spread(rows).mapInArrow(run, schema)


def split_texts(df: DataFrame, key: str, text: str, settings: list[tuple[int, int]]) -> DataFrame:
    """One row per text, setting and piece: doc_id, chunk_size, chunk_overlap, piece, start, end, cut, content.

    Lengths and places are in code points. A text within the size is one piece with cut `start`. Each further piece
    begins chunk_overlap characters before the end of the one before it, and `cut` names the boundary: heading,
    paragraph, line, sentence, word, or forced where an unbroken run had to be divided. Empty text gives one empty
    piece; null keys and null texts give none. Each row of the input is split for itself.
    """

    def each(k, t, bounds, size, overlap):
        return [
            (k, size, overlap, i, start, end, "start" if strength == len(KINDS) else KINDS[strength], t[start:end])
            for i, (start, end, strength) in enumerate(pieces(bounds, size, overlap))
        ]

    return _over(df, key, text, settings, "doc_id string, chunk_size int, chunk_overlap int, piece int, start int, end int, cut string, content string", each)


def split_report(df: DataFrame, key: str, text: str, settings: list[tuple[int, int]]) -> DataFrame:
    """One row per text and setting: doc_id, chunk_size, chunk_overlap, pieces, longest, forced, run.

    pieces counts them, longest is the longest one, forced counts cuts without a boundary, run is the longest run
    without white space.
    """

    def each(k, t, bounds, size, overlap):
        made = pieces(bounds, size, overlap)
        return [(k, size, overlap, len(made), max(e - s for s, e, _ in made), sum(not kind for *_, kind in made), bounds.longest)]

    return _over(df, key, text, settings, "doc_id string, chunk_size int, chunk_overlap int, pieces int, longest int, forced int, run int", each)
