"""Chunkers: one document row becomes rows (doc_id, chunk_id, chunk_index, start, end, content, section)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import spread

Span = tuple[int, int]
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
_HEADING = re.compile(r"^(?:(#{1,6})\s+(\S.*)|((?:Chapter|Section|Article|Chương|Mục|Điều)\s+\d+\b.*))$", re.MULTILINE)
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n\s*\n")
#: Texts per Arrow slice, in bytes.
SLICE = 4_000_000


def _stripped(text: str, span: Span) -> Span | None:
    start, end = span
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return (start, end) if end > start else None


def _atoms(text: str, start: int, end: int, size: int, level: int = 0) -> list[Span]:
    """Spans of at most `size`, split at the first separator that occurs and, where still too long, at later ones."""
    if end - start <= size:
        return [(start, end)]
    while level < len(SEPARATORS) - 1 and text.find(SEPARATORS[level], start, end) < 0:
        level += 1
    separator = SEPARATORS[level]
    if not separator:
        return [(i, min(i + size, end)) for i in range(start, end, size)]
    out, at = [], start
    while at < end:
        found = text.find(separator, at, end)
        stop = end if found < 0 else found + len(separator)
        out += _atoms(text, at, stop, size, level + 1) if stop - at > size else [(at, stop)]
        at = stop
    return out


def recursive(text: str, size: int = 1000, overlap: int = 150) -> list[Span]:
    """Atoms joined up to `size`; each next span begins with the last atoms of at most `overlap` characters."""
    atoms = _atoms(text, 0, len(text), size)
    spans: list[Span] = []
    first = 0
    for i, (_, end) in enumerate(atoms):
        if end - atoms[first][0] > size:
            spans.append((atoms[first][0], atoms[i - 1][1]))
            while first < i and (atoms[i - 1][1] - atoms[first][0] > overlap or end - atoms[first][0] > size):
                first += 1
    if atoms:
        spans.append((atoms[first][0], atoms[-1][1]))
    return [s for s in (_stripped(text, span) for span in spans) if s]


def enforced(text: str, spans: list[Span], least: int, most: int) -> list[Span]:
    """Longer spans are split again, shorter ones joined to the one before where both fit."""
    out: list[Span] = []
    for start, end in spans:
        parts = [(start + a, start + b) for a, b in recursive(text[start:end], most, 0)] if end - start > most else [(start, end)]
        for part in parts:
            if out and part[1] - part[0] < least and part[1] - out[-1][0] <= most:
                out[-1] = (out[-1][0], part[1])
            else:
                out.append(part)
    return out


def sentence_spans(text: str) -> list[Span]:
    cuts = [0, *(m.end() for m in _SENTENCE.finditer(text)), len(text)]
    return [s for s in (_stripped(text, span) for span in zip(cuts, cuts[1:], strict=False)) if s]


@lru_cache(maxsize=300_000)
def word_bucket(word: str, buckets: int) -> int:
    """A bucket of a word by eight bytes of BLAKE2b."""
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "big") % buckets


def hashed_vectors(texts: list[str], dims: int = 128) -> np.ndarray:
    """The deterministic encoder: log counts of hashed words at length one."""
    out = np.zeros((len(texts), dims))
    for row, text in enumerate(texts):
        counts: dict[str, int] = {}
        for word in re.findall(r"\w+", text.lower()):
            counts[word] = counts.get(word, 0) + 1
        for word, n in counts.items():
            out[row, word_bucket(word, dims)] += np.log1p(n)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def semantic(text: str, percentile: float = 85, buffer: int = 1, least: int = 100, most: int = 2000) -> list[Span]:
    """Sentences in windows; a break where neighbouring windows differ more than the percentile of all differences."""
    parts = sentence_spans(text)
    if len(parts) < 3:
        whole = _stripped(text, (0, len(text)))
        return [whole] if whole else []
    windows = [text[parts[max(0, i - buffer)][0] : parts[min(len(parts) - 1, i + buffer)][1]] for i in range(len(parts))]
    v = hashed_vectors(windows)
    gap = 1 - (v[:-1] * v[1:]).sum(axis=1)
    breaks = [i + 1 for i in np.flatnonzero(gap > np.percentile(gap, percentile))]
    cuts = [0, *breaks, len(parts)]
    return enforced(text, [(parts[a][0], parts[b - 1][1]) for a, b in zip(cuts, cuts[1:], strict=False)], least, most)


def headings(text: str) -> list[tuple[int, int, str]]:
    """(start, depth, title) of each heading line."""
    return [(m.start(), len(m.group(1)) if m.group(1) else 7, (m.group(2) or m.group(3)).strip()) for m in _HEADING.finditer(text)]


def section_at(found: list[tuple[int, int, str]], place: int) -> list[str]:
    """The headings in effect at a place, outermost first."""
    stack: list[tuple[int, str]] = []
    for start, depth, title in found:
        if start > place:
            break
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, title))
    return [title for _, title in stack]


def structured(text: str, least: int = 200, most: int = 1500) -> list[Span]:
    """Spans between headings, sized within each section; without headings as `recursive`."""
    found = headings(text)
    if not found:
        return recursive(text, most, 0)
    cuts = sorted({0, *(start for start, _, _ in found), len(text)})
    sections = [s for s in (_stripped(text, span) for span in zip(cuts, cuts[1:], strict=False)) if s]
    return enforced(text, sections, least, most)


def family(text: str, size: int = 500, factor: int = 4) -> list[Span]:
    """Spans of `size` within spans of factor times that."""
    return [(a + x, a + y) for a, b in recursive(text, size * factor, 0) for x, y in recursive(text[a:b], size, 0)]


def budgeted(text: str, limit: int, count: Callable[[str], int] = lambda t: len(_WORD.findall(t)), size: int = 1000, rounds: int = 5, shrink: float = 0.85) -> list[Span]:
    """Spans of at most `limit` tokens. Those above it are split again by characters in proportion, less by `shrink` in
    each round, and what is still above it after the rounds is cut by halves."""
    if limit < 1:
        raise ValueError("limit must be positive")
    spans = recursive(text, size, 0)
    for turn in range(rounds):
        next_spans: list[Span] = []
        for a, b in spans:
            n = count(text[a:b])
            if n <= limit:
                next_spans.append((a, b))
            else:
                next_spans += [(a + x, a + y) for x, y in recursive(text[a:b], max(1, int((b - a) * limit / n * shrink**turn)), 0)]
        spans = next_spans
    out: list[Span] = []
    todo = spans[::-1]
    while todo:
        a, b = todo.pop()
        if b - a > 1 and count(text[a:b]) > limit:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        else:
            out.append((a, b))
    return out


STRATEGIES: dict[str, Callable[..., list[Span]]] = {"fixed": recursive, "semantic": semantic, "structure": structured, "family": family, "budget": budgeted}
#: Documents up to which the hybrid strategy looks for changes of topic.
FEW_DOCUMENTS = 5


def chunked(df: DataFrame, key: str, text: str, strategy: str = "fixed", **options) -> DataFrame:
    """Rows of chunks by a named strategy. Null and blank texts give none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    split = STRATEGIES[strategy]
    rows = df.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null and t is not null")
    schema = "doc_id string, chunk_id string, chunk_index int, start int, end int, content string, section array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(len(batch) * SLICE / max(1, batch.nbytes)))
            for at in range(0, len(batch), step):
                out = []
                for doc, content in zip(batch.column(0).slice(at, step).to_pylist(), batch.column(1).slice(at, step).to_pylist(), strict=True):
                    found = headings(content)
                    for i, (start, end) in enumerate(split(content, **options)):
                        out.append((doc, f"{doc}::{i:05d}", i, start, end, content[start:end], section_at(found, start)))
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["doc_id", "chunk_id", "chunk_index", "start", "end", "content", "section"])

    return spread(rows).mapInArrow(run, schema)


def hybrid(df: DataFrame, key: str, text: str, most: int = FEW_DOCUMENTS) -> DataFrame:
    """Chunks by topic for a small batch of documents, of fixed size for a larger one; an added column names the way."""
    small = df.where(F.col(text).isNotNull()).limit(most + 1).count() <= most
    chosen = "semantic" if small else "fixed"
    return chunked(df, key, text, chosen).withColumn("strategy", F.lit(chosen))


def parent_child(df: DataFrame, key: str, text: str, size: int = 500, factor: int = 4) -> DataFrame:
    """Children without overlap inside parents of factor times their size: child rows with parent_id, parent_start
    and parent_end, made in one pass over the texts."""
    rows = df.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null and t is not null")
    schema = "doc_id string, chunk_id string, chunk_index int, start int, end int, content string, section array<string>, parent_id string, parent_start int, parent_end int"
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(len(batch) * SLICE / max(1, batch.nbytes)))
            for at in range(0, len(batch), step):
                out = []
                for doc, content in zip(batch.column(0).slice(at, step).to_pylist(), batch.column(1).slice(at, step).to_pylist(), strict=True):
                    i, found = 0, headings(content)
                    for p, (a, b) in enumerate(recursive(content, size * factor, 0)):
                        for x, y in recursive(content[a:b], size, 0):
                            out.append((doc, f"{doc}::{i:05d}", i, a + x, a + y, content[a + x : a + y], section_at(found, a + x), f"{doc}::{p:05d}", a, b))
                            i += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return spread(rows).mapInArrow(run, schema)


def hard_slices(df: DataFrame, key: str, text: str, size: int, step: int) -> DataFrame:
    """Slices of `size` characters every `step`, in the JVM."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    rows = df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(key, text, F.posexplode(starts).alias("chunk_index", "start"))
    return rows.select(key, "chunk_index", "start", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("content"))


def neighbour_context(chunks: DataFrame, width: int, doc: str = "doc_id", order: str = "chunk_index", content: str = "content") -> DataFrame:
    """Each chunk with the end of the one before and the start of the one after."""
    w = Window.partitionBy(doc).orderBy(order)
    before, after = F.lag(content).over(w), F.lead(content).over(w)
    padded = F.concat(F.coalesce(F.right(before, F.lit(width)), F.lit("")), F.col(content), F.coalesce(F.left(after, F.lit(width)), F.lit("")))
    return chunks.withColumn("padded", padded)


def sized_by_density(size_tokens: int, chars_per_token: float, window: int | None = None, floor: int = 50) -> int:
    """Characters for a size in tokens, at least `floor`, at most what a model's window holds."""
    chars = max(floor, int(size_tokens * chars_per_token))
    return min(chars, int(window * chars_per_token)) if window else chars
