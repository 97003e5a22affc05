"""Passages of held-out items inside a corpus (problem 9).

A suffix automaton over the words of all items streams the words of each document and tracks how long a run, ending at
each word, stands in some item. Runs of at least `least` words name the items and can be cut out of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .automaton import SuffixAutomaton
from .canonical import INVISIBLE, SEVERAL, Canonical, sliced

LEAST_WORDS = 12
#: Test items are sent to the tasks in blocks of about this many characters, each in a pass of its own over the corpus.
#: A block of a million characters (200 000 words) takes some 150 MB in a worker.
BLOCK_CHARS = 1_000_000
# What the consistent form makes words of, or drops: letters, digits, marks, invisible characters and signs for several letters.
INNER = r"[\p{L}\p{N}\p{M}" + INVISIBLE.strip("[]+") + "".join(map(re.escape, SEVERAL)) + "]+"


class PassageFinder:
    """The automaton of the items' words, with the items of each state that spells at least `least` words."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST_WORDS):
        import regex

        self.least = least
        self.word = regex.compile(r"[\p{L}\p{N}]+")
        self.inner = regex.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{m[1]:0>8}", INNER))
        self.ids: dict[str, int] = {}
        self.automaton = SuffixAutomaton()
        own: dict[int, set[int]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids)) for w in self.word.findall(text.lower())]
            if len(words) >= least:
                for state in self.automaton.add(words):
                    own.setdefault(state, set()).add(item)
        link, length = self.automaton.link, self.automaton.length
        # An occurrence of a string is one of its suffixes too: hand items down the suffix links.
        for state in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
            if state in own and length[link[state]] >= least:
                own.setdefault(link[state], set()).update(own[state])
        self.own = own

    def matches(self, spelled: list[str]) -> Iterator[tuple[int, int, int]]:
        """(place of the last word, words matched, state) wherever at least `least` lower-case words match."""
        get, step, least = self.ids.get, self.automaton.step, self.least
        state = matched = 0
        words = [get(w) for w in spelled]
        count, at = len(words), 0
        while at < count:
            # A match of `least` words holds no unknown word: look at every least-th word first.
            if not matched and at + least <= count and words[at + least - 1] is None:
                at += least
                continue
            word = words[at]
            if word is None:
                state = matched = 0
            else:
                state, matched = step(state, matched, word)
                if matched >= least:
                    yield at, matched, state
            at += 1

    def items(self, text: str) -> dict[int, int]:
        """Each item found in the lower-case text in consistent form, with its longest run of words."""
        found: dict[int, int] = {}
        for _, matched, state in self.matches(self.word.findall(text)):
            seen = matched
            while state > 0 and seen >= self.least:
                for item in self.own.get(state, ()):
                    found[item] = max(found.get(item, 0), seen)
                state = self.automaton.link[state]
                seen = min(seen, self.automaton.length[state])
        return found

    def cleaned(self, stored: list[str], forms: Canonical) -> list[tuple[str, int]]:
        """Stored texts without the matched runs, as they are written otherwise, and the words removed from each.

        Runs of characters that the consistent form makes words of are brought into that form one by one, so that each
        word leads back to its place; a run that holds a matched word goes as a whole.
        """
        runs = [list(self.inner.finditer(t)) for t in stored]
        spelled = iter(forms([m.group() for own in runs for m in own]))
        out = []
        for text, own in zip(stored, runs, strict=True):
            words, of = [], []
            for i in range(len(own)):
                found = self.word.findall(next(spelled).lower())
                words += found
                of += [i] * len(found)
            drop: list[tuple[int, int]] = []
            for at, matched, _ in self.matches(words):
                first = at - matched + 1
                while drop and drop[-1][0] >= first:
                    drop.pop()
                drop.append((max(first, drop[-1][1] + 1) if drop else first, at))
            kept, begin = [], 0
            for first, final in drop:
                kept.append(text[begin : max(begin, own[of[first]].start())])
                begin = own[of[final]].end()
            out.append(("".join([*kept, text[begin:]]), sum(b - a + 1 for a, b in drop)))
        return out


def finders(items: DataFrame, key: str, text: str, least: int = LEAST_WORDS, block: int = BLOCK_CHARS) -> list[PassageFinder]:
    """Fit on the stated test set, in consistent form, in blocks of about `block` characters; one item is never divided."""
    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null").dropDuplicates()
    made, now, held = [], [], 0
    for row in rows.toLocalIterator():
        now.append(row)
        held += len(row.t)
        if held >= block:
            made.append(_fitted(now, least))
            now, held = [], 0
    return [*made, _fitted(now, least)] if now or not made else made


def _fitted(rows: list, least: int) -> PassageFinder:
    return PassageFinder([(r.k, form) for r, form in zip(rows, Canonical()([r.t for r in rows]), strict=True)], least)


def leaks(df: DataFrame, key: str, text: str, fitted: list[PassageFinder]) -> DataFrame:
    """One row per document and item: doc_id, item_id, words (the longest run). Null and empty texts hold nothing.

    Every row of the corpus counts for itself; a repeated key gives one row per item. Each block of items is one pass.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t"))

    def passed(one: PassageFinder) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finds, form = shared.value, Canonical.shared()
            for batch in sliced(batches):
                texts = zip(batch.column(0).to_pylist(), form(batch.column(1)), strict=True)
                out = [(k, item, words) for k, t in texts if t for item, words in finds.items(t.lower()).items()]
                columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "words"])

        return spread(rows).mapInArrow(run, "doc_id bigint, item_id bigint, words int")

    found = reduce(DataFrame.unionByName, map(passed, fitted))
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def without_leaks(df: DataFrame, key: str, text: str, fitted: list[PassageFinder], coverage: float = 0.5) -> DataFrame:
    """Each document as stored with leaked runs removed: doc_id, text, removed (words), words, dropped.

    Where more than `coverage` of the words leaked the text comes out null and dropped is 1. Null stays null. Each block
    of items is a pass over what the one before it left.
    """
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.lit(0).alias("removed"), F.lit(None).cast("int").alias("words"))

    def passed(rows: DataFrame, one: PassageFinder) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finds, form = shared.value, Canonical.shared()
            for batch in sliced(batches):
                texts, removed, words = (batch.column(i).to_pylist() for i in (1, 2, 3))
                hit = []
                for i, t in enumerate(form(batch.column(1))):
                    spelled = finds.word.findall((t or "").lower())
                    words[i] = len(spelled) if words[i] is None else words[i]
                    if next(finds.matches(spelled), None):
                        hit.append(i)
                for i, (text, more) in zip(hit, finds.cleaned([texts[i] for i in hit], form), strict=True):
                    texts[i], removed[i] = text, removed[i] + more
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32()), pa.array(words, pa.int32())], names=["doc_id", "text", "removed", "words"])

        return spread(rows).mapInArrow(run, "doc_id bigint, text string, removed int, words int")

    gone = F.col("removed") > coverage * F.col("words")
    return reduce(passed, fitted, rows).select("doc_id", F.when(~gone, F.col("text")).alias("text"), "removed", "words", gone.cast("int").alias("dropped"))
