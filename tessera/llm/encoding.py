"""Encoding of a corpus with a public byte-level tokenizer (problem 8).

A piece of text is encoded by dynamic programming over its prefixes. The encoding of a prefix ends with exactly one
token: the one that ends there and may follow the last token of the prefix before it. Candidates come from a suffix
automaton of the vocabulary, "may follow" from a test of the token pair, and back-pointers give the ids. Time is linear
in the text, however long an unbroken run is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from .automaton import SuffixAutomaton
from .canonical import sliced

#: The public pattern of the rank files; White_Space, since \s also holds the separators U+001C to U+001F here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Encoded pieces that a worker remembers, and the longest that it remembers; beyond that they are encoded again.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 64
#: Token pairs that a worker remembers.
PAIRS_REMEMBERED = 2_000_000


def vocabulary(path: str) -> dict[bytes, int]:
    """The tokens of a rank file, which give their order of merging."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def compiled(ranks: dict[bytes, int]) -> dict:
    """The suffix automaton of the vocabulary as flat tables; its size follows the vocabulary alone."""
    automaton = SuffixAutomaton()
    tokens = sorted(ranks, key=lambda token: (len(token), token))
    for token in tokens:
        automaton.add(token)
    ending: dict[int, list[bytes]] = {}
    for token, state in zip(tokens, automaton.ends, strict=True):
        ending.setdefault(state, []).append(token)
    states = len(automaton.link)
    # The nearest state, from each one along its suffix links, in which whole tokens end.
    nearest = [-1] * states
    for state in sorted(range(1, states), key=automaton.length.__getitem__):
        nearest[state] = state if state in ending else nearest[automaton.link[state]]
    moves = {state << 8 | byte: to for state, found in enumerate(automaton.next) for byte, to in found.items()}
    own = {s: sorted(t, key=len, reverse=True) for s, t in ending.items()}
    return {"ranks": ranks, "moves": moves, "link": automaton.link, "length": automaton.length, "nearest": nearest, "own": own}


class Encoder:
    """Exact byte-pair encoding by prefixes."""

    def __init__(self, tables: dict):
        import regex

        self.ranks, self.moves, self.link, self.length = (tables[k] for k in ("ranks", "moves", "link", "length"))
        self.nearest, self.own = tables["nearest"], tables["own"]
        self.split = regex.compile(PATTERN).findall
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self.known: dict[str, list[int]] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """Merging step by step, lowest rank first: the definition, for a token or a pair of tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: bytes, right: bytes) -> bool:
        """Whether merging the two tokens' bytes from scratch gives the same two tokens."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS_REMEMBERED:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    def stands(self, token: bytes) -> bool:
        found = self.whole.get(token)
        if found is None:
            found = self.whole[token] = self.merged(token) == [token]
        return found

    def piece(self, text: bytes) -> list[int]:
        """The ids of a piece between two places where the pattern splits."""
        moves, link, length, nearest, own = self.moves, self.link, self.length, self.nearest, self.own
        last: list[bytes] = [b""]
        state = matched = 0
        for end, byte in enumerate(text, 1):
            while (to := moves.get(state << 8 | byte)) is None and state:
                state = link[state]
                matched = length[state]
            state, matched = (to, matched + 1) if to is not None else (0, 0)
            place = nearest[state]
            chosen = None
            while chosen is None:
                if place < 0:
                    raise ValueError(f"the vocabulary can't write byte {byte}")
                for token in own[place]:
                    if (size := len(token)) <= matched and self.stands(token):
                        before = last[end - size]
                        if not before or self.follows(before, token):
                            chosen = token
                            break
                place = nearest[link[place]]
            last.append(chosen)
        ids, end = [], len(text)
        while end:
            ids.append(self.ranks[last[end]])
            end -= len(last[end])
        return ids[::-1]

    def __call__(self, text: str | None) -> list[int]:
        ids: list[int] = []
        known = self.known
        for piece in self.split(text or ""):
            found = known.get(piece)
            if found is None:
                found = self.piece(piece.encode())
                if len(piece) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids


#: The encoder of a worker and the tables that it was made from; a worker serves many tasks.
_READY: list = [None, None]


def _encoder(tables: dict) -> Encoder:
    if _READY[0] is not tables:
        _READY[:] = [tables, Encoder(tables)]
    return _READY[1]


def tables_of(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary's tables for all executors: some megabytes, whatever the corpus."""
    return spark.sparkContext.broadcast(compiled(vocabulary(path)))


def encoded(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Key and ids of every row's text. Null and empty texts give an empty list; repeated rows give repeated rows.

    Special tokens are never made: their spelling in a text is ordinary text.
    """
    tables = tables_of(df.sparkSession, path)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("t"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tables.value)
        for batch in sliced(batches, 1_000_000):
            ids = pa.array([encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    return spread(rows).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")
