"""Language of documents and of their segments (problem 4): error-correcting output codes over character n-grams.

Every class has a codeword; one binary n-gram classifier per bit gives a margin for each word. A span's margins are
decoded to the nearest codeword, each bit's logistic loss weighted by how reliable the bit was in training. Vietnamese
without accents is a class of its own that is reported as vi.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .canonical import Canonical, sliced

LANGS = ("vi", "en", "fr")
CLASSES = ("vi", "en", "fr", "vi_plain")
MIXED = "mixed"
# Spellings of language labels after lower case, without a region.
SPELLINGS = {
    "vi": ("vi", "vie", "vietnamese", "tiếng việt"),
    "en": ("en", "eng", "english"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    MIXED: ("mixed", "mul", "multiple"),
}
WORD = r"\p{L}[\p{L}\p{M}]*"
#: Runs without white space longer than this are no words.
LONGEST_RUN = 40
BUCKETS, GRAMS = 1 << 15, (1, 2, 3, 4)
#: Labelled rows of each table that the classifiers are fitted on, at most.
FIT_ROWS = 600
#: Weight of a word that is neither in lower nor in upper case, often a name; clip of a word's margin; cost of changing language in a text.
NAME_WEIGHT, CLIP, CHANGE = 0.2, 3.0, 7.0
#: Words and evidence (log units over the next language) that a whole sentence of another language needs.
LEAST_WORDS, LEAST_EVIDENCE = 5, 5.0
#: A record is flagged ambiguous where the best codeword leads by less than this.
AMBIGUOUS = 0.7
REMEMBERED = 300_000


def label_language(label):
    """The language that a label column names, as vi, en, fr or mixed; null where it names none of them."""
    base = F.split(F.lower(F.regexp_replace(label, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", "")), "[-_]")[0]
    out = F.lit(None).cast("string")
    for lang, names in SPELLINGS.items():
        out = F.when(base.isin(*names), F.lit(lang)).otherwise(out)
    return out


def codewords(classes: int) -> np.ndarray:
    """The exhaustive code: every way to part the classes in two, once. Rows are classes, entries -1 and 1."""
    rows = [bits for bits in product((-1, 1), repeat=classes) if bits[0] == 1 and -1 in bits]
    return np.array(rows, np.float64).T


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of all words, one word after the other, and how many each word has."""
    framed = [f"\x02{w}\x03" for w in words]
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, framed), np.int64, len(framed))
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters up to the word's end
    buckets, real = np.zeros((len(codes), len(GRAMS)), np.int64), np.zeros((len(codes), len(GRAMS)), bool)
    with np.errstate(over="ignore"):
        for g, n in enumerate(GRAMS):
            h = np.full(len(codes), n, np.uint64)
            for i in range(n):
                h[: len(codes) - i] = (h[: len(codes) - i] ^ codes[i:]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            buckets[:, g], real[:, g] = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) % np.uint64(BUCKETS), left >= n
    return buckets[real], np.add.reduceat(real.sum(axis=1), ends - lengths) if len(words) else lengths


def without_accents(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D")


class LanguageModel:
    """The fitted bit classifiers. A worker keeps the class evidence of the words that it has met."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.weights, self.bias, self.trust = weights, bias, trust
        self._prepare()

    def __reduce__(self):
        return LanguageModel, (self.weights, self.bias, self.trust)

    def _prepare(self) -> None:
        import regex

        self.code = codewords(len(CLASSES))
        self.word = regex.compile(WORD).findall
        self.known: dict[str, int] = {}
        self.tokens: dict[str, list[int]] = {}
        self.table = np.zeros((1024, len(LANGS)))

    def rows(self, text: str) -> np.ndarray:
        """A row of evidence for each word of a text, without those in unbroken runs that no language writes (encoded
        data, addresses)."""
        tokens, kept = text.split(), self.tokens
        new = set(tokens).difference(kept)
        if new:
            if len(kept) + len(new) > REMEMBERED or len(self.known) > REMEMBERED:
                kept.clear()
                self.known.clear()
                new = set(tokens)
            parts = {t: self.word(t) if len(t) <= LONGEST_RUN else [] for t in new}
            self._learn({w for words in parts.values() for w in words})
            kept.update((t, [self.known[w] for w in words]) for t, words in parts.items())
        return self.table[np.fromiter(chain.from_iterable(map(kept.__getitem__, tokens)), np.int64)]

    def margins(self, words: list[str]) -> np.ndarray:
        """A row of bit margins for each lower-case word."""
        flat, sizes = grams_of(words)
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes) / np.sqrt(sizes)[:, None] + self.bias

    def decoded(self, margins: np.ndarray) -> np.ndarray:
        """Negative loss of each language's codeword: the trust-weighted logistic loss, best of a language's classes."""
        clipped = np.clip(margins, -CLIP, CLIP)
        loss = np.stack([(self.trust * np.logaddexp(0, -clipped * row)).sum(axis=1) for row in self.code], axis=1)
        return -np.stack([loss[:, [i for i, c in enumerate(CLASSES) if c.split("_")[0] == lang]].min(axis=1) for lang in LANGS], axis=1)

    def _learn(self, words: set[str]) -> None:
        """Keep a row for each word: log evidence of every language, relative to their mean."""
        known = self.known
        missing = [w for w in words if w not in known]
        if missing:
            rows = self.decoded(self.margins([w.lower() for w in missing]))
            rows -= rows.mean(axis=1, keepdims=True)
            rows *= np.array([NAME_WEIGHT if not (w.islower() or w.isupper()) else 1.0 for w in missing])[:, None]
            need = len(known) + len(missing)
            if need > len(self.table):
                self.table = np.concatenate((self.table[: len(known)], np.zeros((max(need, 2 * len(self.table)) - len(known), len(LANGS)))))
            self.table[len(known) : need] = rows
            for w in missing:
                known[w] = len(known)

    def spans(self, rows: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, end, language) of the segments of a text: the best path that pays for each change."""
        score, back = rows[0].copy(), np.zeros((len(rows), len(LANGS)), np.int8)
        best = score.tolist()
        states = range(len(LANGS))
        for i, row in enumerate(rows[1:].tolist(), 1):
            top = max(states, key=best.__getitem__)
            change = best[top] - CHANGE
            now = []
            for s in states:
                if best[s] >= change:
                    back[i, s] = s
                    now.append(best[s] + row[s])
                else:
                    back[i, s] = top
                    now.append(change + row[s])
            best = now
        at = max(states, key=best.__getitem__)
        out, end = [], len(rows)
        for i in range(len(rows) - 1, 0, -1):
            before = int(back[i, at])
            if before != at:
                out.append((i, end, at))
                end, at = i, before
        return [(0, end, at), *reversed(out)]

    def whole(self, rows: np.ndarray, spans: list[tuple[int, int, int]]) -> dict[int, float]:
        """Evidence of each language that fills whole sentences: enough words, clearly better than any other."""
        found: dict[int, float] = {}
        for first, end, lang in spans:
            if end - first >= LEAST_WORDS:
                total = rows[first:end].sum(axis=0)
                lead = total[lang] - np.delete(total, lang).max()
                if lead >= LEAST_EVIDENCE:
                    found[lang] = found.get(lang, 0.0) + lead
        return found

    def several(self, rows: np.ndarray, most: int) -> bool:
        """Whether a text may hold whole sentences of a language other than `most`, its most likely one.

        A language counts with a span in which it leads by LEAST_EVIDENCE, so where no run of words leads over `most`
        by as much there is none, and the path through the text need not be looked for.
        """
        if len(rows) < 2 * LEAST_WORDS:
            return False
        lead = np.cumsum(rows - rows[:, most : most + 1], axis=0)
        low = np.minimum.accumulate(np.concatenate((np.zeros((1, len(LANGS))), lead[:-1])), axis=0)
        return bool((lead - low).max() >= LEAST_EVIDENCE - 1e-6)

    def judged(self, rows: np.ndarray) -> tuple[str | None, float, bool]:
        """Language, confidence and whether it is ambiguous, of a text's words; no language without a word."""
        if not len(rows):
            return None, 0.0, True
        total = rows.sum(axis=0)
        order = np.argsort(-total, kind="stable")
        if self.several(rows, int(order[0])):
            found = self.whole(rows, self.spans(rows))
            if len(found) > 1:
                least = min(found.values())
                return MIXED, float(1 - np.exp(-least / LEAST_EVIDENCE)), least < 1.5 * LEAST_EVIDENCE
        lead = float(total[order[0]] - total[order[1]])
        return LANGS[order[0]], float(1 / np.exp(total - total[order[0]]).sum()), lead < AMBIGUOUS

    def lines(self, text: str) -> list[tuple[int, str, float]]:
        """(number, language, confidence) of each non-empty line; a line without words goes with its neighbours."""
        out = [(i, *self.judged(self.rows(line))[:2]) for i, line in enumerate(text.split("\n")) if line]
        named = [lang for _, lang, _ in out]
        for i, lang in enumerate(named):
            if lang is None:
                named[i] = named[i - 1] if i and named[i - 1] else next((x for x in named[i:] if x), None)
        return [(i, lang, sure) for (i, _, sure), lang in zip(out, named, strict=True) if lang]


def fit(samples: list[tuple[str, str]], rounds: int = 60, rate: float = 0.3, seed: int = 5) -> LanguageModel:
    """Fit on (language, text in consistent form). Spans whose label the first fit finds wrong are left out of a second."""
    import regex

    find, run = regex.compile(WORD).findall, regex.compile(rf"\S{{{LONGEST_RUN + 1},}}")
    draw = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    spans: list[list[int]] = []
    kinds: list[int] = []
    for lang, text in samples:
        for line in text.split("\n"):
            words = [w for w in find(run.sub(" ", line)) if w.islower() or w.isupper()]
            for i in range(0, len(words), 12):
                part = [w.lower() for w in words[i : i + 12]]
                if len(part) < 3:
                    continue
                forms = [(CLASSES.index(lang), part)]
                if lang == "vi":
                    plain = [without_accents(w) for w in part]
                    forms = [(3, plain)] if plain == part else [*forms, (3, plain)] if draw.random() < 0.5 else forms
                for kind, form in forms:
                    kinds.append(kind)
                    spans.append([ids.setdefault(w, len(ids)) for w in form])
    if len({*kinds}) < 2:
        raise ValueError("labelled rows of at least two languages are needed")
    gram_flat, gram_sizes = grams_of(list(ids))
    gram_first = np.cumsum(gram_sizes) - gram_sizes
    gram_scale = np.repeat(1 / np.sqrt(gram_sizes), gram_sizes)[:, None]
    code = codewords(len(CLASSES))
    kept = np.ones(len(spans), bool)
    labels = np.array(kinds)
    sizes = np.array([len(s) for s in spans])
    flat = np.fromiter((x for s in spans for x in s), np.int64, int(sizes.sum()))
    of = np.repeat(np.arange(len(spans)), sizes)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    weights, bias = np.zeros((BUCKETS, code.shape[1])), np.zeros(code.shape[1])
    for attempt in range(2):
        counts = np.bincount(labels[kept], minlength=len(CLASSES))
        each = np.where(kept, 1 / np.maximum(counts, 1)[labels], 0.0)
        each /= each.sum()
        target = code[labels]
        weights[:], bias[:] = 0, 0
        square, bias_square = np.full_like(weights, 1e-12), np.full_like(bias, 1e-12)
        for _ in range(rounds):
            word = np.add.reduceat(weights[gram_flat] * gram_scale, gram_first) + bias
            margin = np.add.reduceat(word[flat], first) / sizes[:, None]
            slope = -target / (1 + np.exp(np.clip(target * margin, -30, 30))) * each[:, None]
            pulled = (slope / sizes[:, None])[of]
            word_slope = np.stack([np.bincount(flat, pulled[:, b], len(ids)) for b in range(code.shape[1])], axis=1)
            gram_slope = np.repeat(word_slope, gram_sizes, axis=0) * gram_scale
            slope_w = np.stack([np.bincount(gram_flat, gram_slope[:, b], BUCKETS) for b in range(code.shape[1])], axis=1) + 1e-7 * weights
            slope_b = slope.sum(axis=0)
            square += slope_w**2
            bias_square += slope_b**2
            weights -= rate * slope_w / np.sqrt(square)
            bias -= rate * slope_b / np.sqrt(bias_square)
        wrong = ((margin * target <= 0) * each[:, None]).sum(axis=0)
        if attempt == 0:
            loss = np.logaddexp(0, -margin[:, None, :] * code[None]).sum(axis=2)
            kept &= loss.argmin(axis=1) == labels
    trust = np.log((1 - np.clip(wrong, 0.005, 0.45)) / np.clip(wrong, 0.005, 0.45))
    return LanguageModel(weights.astype(np.float32), bias, trust / trust.sum())


def fit_on(tables: list[tuple[DataFrame, str, str, str]], rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on labelled rows of (table, key, text, label), at most `rows` of each, those with the least hash of the key."""
    samples: list[tuple[str, str]] = []
    for df, key, text, label in tables:
        named = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), label_language(F.col(label)).alias("l"))
        chosen = _least(named.where(F.col("l").isin(*LANGS) & F.col("k").isNotNull()), rows)
        samples += [(r.l, form) for r, form in zip(chosen, Canonical()([r.t for r in chosen]), strict=True) if form]
    return fit(samples)


def _least(named: DataFrame, rows: int) -> list:
    """The `rows` rows (k, t, l) with text that have the least hash of k; about four times as many meet in all.

    A count bounds the hashes beforehand, so a task hands on what is under the bound and not `rows` texts of its own.
    """
    hashed = F.xxhash64("k")
    share = 4.0 * rows / max(1, named.select("k", "l").count())
    while True:
        bound = -(1 << 63) + int(share * (1 << 64))
        few = named.where(hashed < F.lit(bound)) if share < 1 else named
        found = few.where("t is not null").orderBy(hashed, "k").limit(rows).collect()
        if len(found) == rows or share >= 1:
            return found
        share *= 4


def languages(df: DataFrame, key: str, text: str, label: str, model: LanguageModel, segments: bool) -> DataFrame:
    """id, seg, lang, confidence, ambiguous, label: a row with seg -1 for each row with text, and one for each
    non-empty line (seg 0..) of a text of mixed language if segments are asked for.

    lang is vi, en, fr or mixed, null for a text without letters. label is what the stored label names, null where it
    names nothing known. Null and blank texts give no row; each row of the input is judged for itself.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t"), label_language(F.col(label)).alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, form = shared.value, Canonical.shared()
        for batch in sliced(batches, 1_000_000):
            out = []
            for i, stored, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), form(batch.column(1)), strict=True):
                if not t or t.isspace():
                    continue
                lang, sure, unsure = judge.judged(judge.rows(t))
                out.append((i, -1, lang, sure, unsure, stored))
                if segments and lang == MIXED:
                    out += [(i, n, named, sure, False, stored) for n, named, sure in judge.lines(t)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["id", "seg", "lang", "confidence", "ambiguous", "label"]
            )

    kept = rows.where("id is not null and t is not null")
    return spread(kept).mapInArrow(run, "id string, seg int, lang string, confidence double, ambiguous boolean, label string")
