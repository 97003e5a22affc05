"""Answers and their citations: claims, citation blocks, verification, replies of other services."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import spread

# Words before a full stop that do not end a sentence.
ABBREVIATIONS = frozenset("tp. tt. q. p. gs. pgs. ts. ths. bs. vd. vs. v.v. no. st. mr. ms. dr. fig. usd.".split())
_END = re.compile(r"([.!?…])(?=\s|$)(?:\s+|$)")
_NUMBER = re.compile(r"\[(\d{1,6})\]")


def sentences(text: str) -> list[str]:
    """Sentences and lines, without list marks; a full stop after an abbreviation ends none."""
    out, start = [], 0
    for m in _END.finditer(text):
        if m.group(1) == "." and text[start : m.start() + 1].rsplit(None, 1)[-1].lower() in ABBREVIATIONS:
            continue
        out.append(text[start : m.end(1)])
        start = m.end()
    out.append(text[start:])
    lines = (line.strip().lstrip("-•*").strip() for piece in out for line in piece.splitlines())
    return [line for line in lines if line]


def claims(text: str, least: int = 25) -> list[tuple[str, list[int]]]:
    """Sentences of enough characters without their marks, with the numbers that each cites."""
    out = []
    for sentence in sentences(text):
        plain = _NUMBER.sub("", sentence).strip()
        if len(plain) >= least:
            out.append((plain, list(dict.fromkeys(int(n) for n in _NUMBER.findall(sentence)))))
    return out


def numbered_replies(text: str, n: int) -> list[str] | None:
    """The texts of [1] .. [n] lines with their continuations; null unless the numbers are exactly 1 to n."""
    found: dict[int, list[str]] = {}
    now = None
    for line in text.splitlines():
        m = re.match(r"\s*\[(\d+)\]\s*(.*)", line)
        if m:
            now = int(m.group(1))
            if now in found:
                return None
            found[now] = [m.group(2)]
        elif now is not None:
            found[now].append(line)
    if sorted(found) != list(range(1, n + 1)):
        return None
    return [" ".join(" ".join(found[i]).split()) for i in range(1, n + 1)]


def located(needle: str, text: str, start: int = 0, end: int | None = None) -> tuple[int, int] | None:
    """Where a text stands in a region, without regard to white space, as places in the original."""
    region = text[start:end]
    places = [i for i, c in enumerate(region) if not c.isspace()]
    flat, wanted = "".join(region[i] for i in places), "".join(needle.split())
    at = flat.find(wanted) if wanted else -1
    return None if at < 0 else (start + places[at], start + places[at + len(wanted) - 1] + 1)


def snapped(text: str, start: int, end: int, most: int = 200) -> tuple[int, int]:
    """A span widened to white space on either side, by a bounded number of characters."""
    before = re.search(r"\S*$", text[max(0, start - most) : start])
    after = re.match(r"\S*", text[end : end + most])
    return start - len(before.group()), end + len(after.group())


def plain_letters(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def checksum(value) -> str:
    return "sha256:" + sha256(canonical_json(value).encode()).hexdigest()


def redacted_values(value, redact: Callable[[str], str]):
    """Every string inside nested JSON redacted."""
    if isinstance(value, str):
        return redact(value)
    if isinstance(value, list):
        return [redacted_values(v, redact) for v in value]
    return {k: redacted_values(v, redact) for k, v in value.items()} if isinstance(value, dict) else value


def resamples(tail: float, wanted: int = 128, start: int = 2000, most: int = 200_000) -> int:
    """Resamples so that the tail of an interval holds enough of them."""
    return min(most, max(start, -(-wanted * 10**9 // max(1, round(tail * 10**9)))))


def claim_rows(df: DataFrame, key: str, text: str, least: int = 25) -> DataFrame:
    """key, claim (its number), content, cited of every answer."""
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, n, s, c) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, (s, c) in enumerate(claims(t, least))]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["id", "claim", "content", "cited"])

    return spread(rows).mapInArrow(run, "id string, claim int, content string, cited array<int>")


BLOCK = "```citations\n"


def citation_block(text: Column) -> Column:
    """struct(answer, body, status): the text before the block, its JSON, and ok, absent or invalid."""
    at = F.instr(text, BLOCK)
    rest = F.substring(text, at + len(BLOCK), F.length(text))
    body = F.trim(F.regexp_replace(rest, r"\s*```\s*$", ""))
    parsed = F.from_json(body, "array<struct<n:int,quote:string>>")
    good = body.rlike(r"^\[.*\]$") & parsed.isNotNull()
    answer = F.when(at > 0, F.rtrim(F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"\s+$", ""))).otherwise(text)
    status = F.when(at == 0, "absent").when(good, "ok").otherwise("invalid")
    return F.struct(answer.alias("answer"), F.when(at > 0, body).alias("body"), status.alias("status"), F.when(good & (at > 0), parsed).alias("claims"))


def common_start(a: Column, b: Column) -> Column:
    """The longest common beginning of two paths."""
    same = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x.eqNullSafe(y))
    stop = F.array_position(same, F.lit(False))
    return F.slice(a, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int"))


def verified_claims(claims_: DataFrame, sources: DataFrame) -> DataFrame:
    """Cited claims (id, n, quote) beside their sources (id, n, content): state invalid where there is no such source,
    else verified or unverified."""
    both = claims_.join(sources, ["id", "n"], "left")
    state = F.when(F.col("content").isNull(), "invalid").when(T.quote_matches(F.col("quote"), F.col("content")), "verified").otherwise("unverified")
    return both.select("id", "n", state.alias("state"))
