"""Abusive, hateful or sexual content (problem 10): a convolutional text classifier in numpy.

Words are embedded by hashed spellings (as written, without accents, by consonants, by letter groups), so respelled
words fall near the ones they stand for. Filters of several widths run over each sentence; the highest response of
every filter makes the sentence's score, and the highest sentence makes the document's. Thresholds are set by language
on rows held out from training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .canonical import Canonical, sliced
from .langid import label_language, without_accents

BUCKETS, WIDTH, FILTERS, SIZES = 1 << 15, 16, 20, (1, 2, 3, 4)
#: Reviewed documents that the classifier is fitted on, at most, of each kind; a quarter is held out for thresholds.
FIT_ROWS = 3000
ROUNDS, PASSES, BATCH, SEED = 5, 2, 256, 11
#: After this many rounds, rows labelled toxic in which no sentence scores so are taken as mislabelled and left out.
TRUSTING_ROUNDS = 2
#: A threshold is set for a language from so many held-out documents of each kind on; else the one for all holds, which
#: takes the rows of training to its help where there are fewer than so many in all.
LEAST_HELD_OUT = 20
#: Sentences that are scored at once.
BLOCK = 400
REMEMBERED = 400_000

# Signs that stand for letters inside words.
SIGNS = str.maketrans("013457@$!|", "oieastasii")
_SPELLED = re.compile(r"(?<!\S)\w(?:[ .\-_*]\w){2,}(?=[\s,;:.!?]|$)")
_STRETCHED = re.compile(r"(\w)\1+")
_WORD = re.compile(r"[^\W_]+(?:[*@$!|'’.\-_]+[^\W_]+)*\**|[*]+")
_SEPARATED = re.compile(r"(?:\w[.\-_])+\w")
_BLANK = re.compile(r"\n[^\S\n]*\n")
_ENDS = re.compile(r"[.!?…][\"'”’»)\]]*$")


def spelled_out(text: str) -> str:
    """Letters set apart by blanks or signs are joined again."""
    return _SPELLED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), text)


def words_of(token: str) -> list[str]:
    """The words of one token without white space, in lower case."""
    out = []
    for found in _WORD.findall(token.lower()):
        if found[0].isdigit() and not any(c.isalpha() for c in found):
            out.append("#")
        elif _SEPARATED.fullmatch(found):
            out.append(re.sub(r"[.\-_]", "", found))
        else:
            out += [w for w in re.split(r"[.\-_'’]+", found) if w]
    return out


def features(word: str) -> list[int]:
    """Buckets of a word's spellings."""
    import xxhash

    plain = _STRETCHED.sub(r"\1", without_accents(word).translate(SIGNS) if any(c.isalpha() for c in word) else word)
    bones = re.sub(r"[^b-df-hj-np-tv-xz]", "", plain)
    framed = f"^{plain}$"
    spelled = ["w" + word, "p" + plain, "p" + plain, "s" + bones]
    spelled += ["g" + framed[i : i + n] for n in (3, 4, 5) for i in range(max(0, len(framed) - n + 1))]
    return [xxhash.xxh32_intdigest(s) % BUCKETS for s in spelled]


class Words:
    """Numbers words as they come and keeps the features of each; word 0 is the padding between sentences."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.tokens: dict[str, tuple[list[int], bool]] = {}
        self.features: list[list[int]] = [[]]

    def token(self, token: str) -> tuple[list[int], bool]:
        known = self.tokens.get(token)
        if known is None:
            numbers = []
            for word in words_of(token):
                number = self.ids.get(word)
                if number is None:
                    number = self.ids[word] = len(self.features)
                    self.features.append(features(word))
                numbers.append(number)
            known = self.tokens[token] = (numbers, _ENDS.search(token) is not None)
        return known

    def sentences(self, text: str) -> list[list[int]]:
        """Word numbers of each sentence; end marks and empty lines part them, wrapped lines do not."""
        out = []
        for block in _BLANK.split(spelled_out(text)):
            now: list[int] = []
            for token in block.split():
                numbers, ends = self.token(token)
                now += numbers
                if ends and now:
                    out.append(now)
                    now = []
            if now:
                out.append(now)
        return out


def laid_out(sentences: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers with padding after each sentence, first place and length of each sentence."""
    pad = max(SIZES) - 1
    sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
    starts = np.concatenate(([0], np.cumsum(sizes + pad)[:-1])) if len(sentences) else sizes
    flat = np.zeros(int(sizes.sum()) + pad * len(sentences), np.int64)
    places = np.arange(int(sizes.sum())) + np.repeat(pad * np.arange(len(sentences)), sizes)
    flat[places] = np.fromiter(chain.from_iterable(sentences), np.int64, int(sizes.sum()))
    return flat, starts, sizes


class AbuseModel:
    """The classifier's parameters. A worker keeps the embeddings of the words that it has met."""

    def __init__(self, parts: dict[str, np.ndarray], thresholds: dict[str, float]):
        self.parts, self.thresholds = parts, thresholds
        self.words = Words()
        self.embedded = np.zeros((1, WIDTH), np.float32)

    def __reduce__(self):
        return AbuseModel, (self.parts, self.thresholds)

    @staticmethod
    def fresh(seed: int = SEED) -> AbuseModel:
        draw = np.random.default_rng(seed)
        parts = {"embed": draw.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)}
        for w in SIZES:
            parts[f"k{w}"] = draw.normal(0, 1 / np.sqrt(w * WIDTH), (w, WIDTH, FILTERS)).astype(np.float32)
            parts[f"b{w}"] = np.zeros(FILTERS, np.float32)
        parts["out"] = draw.normal(0, 0.1, len(SIZES) * FILTERS).astype(np.float32)
        parts["bias"] = np.array([-2.0], np.float32)
        return AbuseModel(parts, {})

    def _vectors(self, features: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, features), np.int64, len(features))
        flat = np.fromiter(chain.from_iterable(features), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.parts["embed"][flat], np.cumsum(sizes) - sizes) / sizes[:, None].astype(np.float32)

    def vectors(self, words: Words) -> np.ndarray:
        """The embedding of every word known so far; row 0 is zero."""
        if len(self.embedded) < len(words.features):
            self.embedded = np.concatenate((self.embedded, self._vectors(words.features[len(self.embedded) :])))
        return self.embedded

    def filters(self) -> tuple[np.ndarray, np.ndarray]:
        """All filters as columns of one matrix over windows of the widest one, and their biases."""
        kernel = np.zeros((max(SIZES) * WIDTH, len(SIZES) * FILTERS), np.float32)
        for n, w in enumerate(SIZES):
            kernel[: w * WIDTH, n * FILTERS : (n + 1) * FILTERS] = self.parts[f"k{w}"].reshape(w * WIDTH, FILTERS)
        return kernel, np.concatenate([self.parts[f"b{w}"] for w in SIZES])

    def sentence_scores(self, sentences: list[list[int]], table: np.ndarray) -> np.ndarray:
        """The score of each sentence: the highest response of every filter, weighted. Sentences of one length are pooled
        together, in blocks, so that a filter's responses are halved at once until one is left."""
        kernel, bias = self.filters()
        scores = np.zeros(len(sentences), np.float32)
        order = np.argsort(np.fromiter(map(len, sentences), np.int64, len(sentences)), kind="stable")
        for i in range(0, len(order), BLOCK):
            chosen = order[i : i + BLOCK]
            flat, starts, sizes = laid_out([sentences[j] for j in chosen])
            x = table[flat]
            windows = np.lib.stride_tricks.as_strided(x, (len(x) - max(SIZES) + 1, kernel.shape[0]), x.strides)
            y = windows[np.arange(int(sizes.sum())) + np.repeat((max(SIZES) - 1) * np.arange(len(sizes)), sizes)] @ kernel
            top, at = np.empty((len(chosen), kernel.shape[1]), np.float32), 0
            firsts = np.flatnonzero(np.diff(sizes, prepend=-1))
            for first, end in zip(firsts, np.append(firsts[1:], len(sizes)), strict=True):
                left = int(sizes[first])
                alike = y[at : at + left * (end - first)].reshape(end - first, left, -1)
                at += left * (end - first)
                while left > 1:
                    half = left // 2
                    np.maximum(alike[:, :half], alike[:, left - half : left], out=alike[:, :half])
                    left -= half
                top[first:end] = alike[:, 0]
            scores[chosen] = np.maximum(top + bias, 0) @ self.parts["out"] + self.parts["bias"][0]
        return scores

    def scores(self, forms: list[str | None]) -> np.ndarray:
        """A number from 0 to 1 for each text in consistent form; 0 for a text without words."""
        if len(self.words.features) > REMEMBERED or len(self.words.tokens) > 2 * REMEMBERED:
            self.words, self.embedded = Words(), self.embedded[:1]
        texts = [self.words.sentences(t) if t else [] for t in forms]
        each = self.sentence_scores([s for t in texts for s in t], self.vectors(self.words))
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros(len(texts))
        full = counts > 0
        if full.any():
            firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))[full]
            out[full] = 1 / (1 + np.exp(-np.maximum.reduceat(each, firsts).astype(np.float64)))
        return out

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", self.thresholds.get("", 0.5))


def _gathered(index: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """The sums of the rows of each index."""
    flat = (index.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
    return np.bincount(flat, rows.reshape(-1), count * WIDTH).reshape(count, WIDTH).astype(np.float32)


def _train(model: AbuseModel, features: tuple[np.ndarray, np.ndarray], sentences: list[list[int]], targets: np.ndarray, weights: np.ndarray, draw, rate: float, state: dict) -> None:
    """One pass of Adam over the sentences; embeddings change by Adagrad. features holds all words' buckets and their bounds."""
    parts = model.parts
    buckets, bounds = features
    span = max(SIZES)
    columns = np.arange(len(SIZES) * FILTERS)
    order = draw.permutation(len(sentences))
    for at in range(0, len(order), BATCH):
        chosen = order[at : at + BATCH]
        flat, _, sizes = laid_out([sentences[i] for i in chosen])
        used, inverse = np.unique(flat, return_inverse=True)
        real = used[used > 0]
        counts = bounds[real + 1] - bounds[real]
        firsts = np.cumsum(counts) - counts
        feats = buckets[np.arange(int(counts.sum())) + np.repeat(bounds[real] - firsts, counts)]
        vectors = np.zeros((len(used), WIDTH), np.float32)
        vectors[used > 0] = np.add.reduceat(parts["embed"][feats], firsts) / counts[:, None].astype(np.float32)
        x = vectors[inverse]
        kernel, bias = model.filters()
        places = np.arange(int(sizes.sum())) + np.repeat((span - 1) * np.arange(len(sizes)), sizes)
        windows = np.lib.stride_tricks.as_strided(x, (len(x) - span + 1, kernel.shape[0]), x.strides)[places]
        y = windows @ kernel
        first = np.cumsum(sizes) - sizes
        top = np.maximum.reduceat(y, first)
        hit = y == np.repeat(top, sizes, axis=0)
        where = np.minimum.reduceat(np.where(hit, np.arange(len(y))[:, None], len(y)), first)
        raw = top + bias
        keep = (draw.random(raw.shape) > 0.2) / np.float32(0.8)
        act = (np.maximum(raw, 0) * keep).astype(np.float32)
        logit = act @ parts["out"] + parts["bias"][0]
        slope = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - targets[chosen]) * weights[chosen] / weights[chosen].sum()).astype(np.float32)
        grads = {"out": act.T @ slope + 1e-4 * parts["out"], "bias": slope.sum(keepdims=True)}
        back = (slope[:, None] * parts["out"] * keep * (raw > 0)).astype(np.float32)
        pulled = np.zeros_like(y)
        pulled[where, columns] = back
        moved = windows.T @ pulled
        for n, w in enumerate(SIZES):
            own = slice(n * FILTERS, (n + 1) * FILTERS)
            grads[f"b{w}"], grads[f"k{w}"] = back[:, own].sum(axis=0), moved[: w * WIDTH, own].reshape(w, WIDTH, FILTERS)
        wide = pulled @ kernel.T
        x_slope = np.zeros_like(x)
        for i in range(span):
            x_slope[places + i] += wide[:, i * WIDTH : (i + 1) * WIDTH]
        state["t"] = state.get("t", 0) + 1
        for name, g in grads.items():
            m, v = state.setdefault(name, (np.zeros_like(parts[name]), np.zeros_like(parts[name])))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            parts[name] -= (rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-8)).astype(np.float32)
        word_slope = _gathered(inverse, x_slope, len(used))[used > 0]
        touched, back_to = np.unique(feats, return_inverse=True)
        total = _gathered(back_to, np.repeat(word_slope / counts[:, None].astype(np.float32), counts, axis=0), len(touched))
        seen = state.setdefault("embed", np.full(BUCKETS, 1e-8, np.float32))
        seen[touched] += (total * total).mean(axis=1)
        parts["embed"][touched] -= 10 * rate * total / np.sqrt(seen[touched])[:, None]


def fit(samples: list[tuple[str, int, str | None]], seed: int = SEED) -> AbuseModel:
    """Fit on (text in consistent form, toxic, language); thresholds are set on the quarter of each kind that is held out.

    With fewer than two kinds of label the model scores every text the same and marks none. Where fewer than
    LEAST_HELD_OUT of a kind are held out, the threshold goes by all rows, those of training among them.
    """
    draw = np.random.default_rng(seed)
    model = AbuseModel.fresh(seed)
    words = Words()
    texts = [words.sentences(t) for t, _, _ in samples]
    toxic = np.array([bool(x) for _, x, _ in samples])
    if len({*toxic.tolist()}) < 2:
        model.parts["out"][:] = 0
        model.thresholds = {"": 1.0}
        return model
    held = np.zeros(len(samples), bool)
    for kind in (True, False):  # a quarter of each kind, whatever their number
        own = draw.permutation(np.flatnonzero(toxic == kind))
        held[own[: len(own) // 4]] = True
    train = [i for i in range(len(samples)) if not held[i] and texts[i]]
    bounds = np.concatenate(([0], np.cumsum([len(f) for f in words.features])))
    known = np.fromiter(chain.from_iterable(words.features), np.int64, int(bounds[-1])), bounds
    state: dict = {}
    for turn in range(ROUNDS):
        chosen: list[tuple[list[int], float, float]] = []
        table = AbuseModel(model.parts, {}).vectors(words) if turn else None
        for i in train:
            if not turn:
                some = texts[i] if toxic[i] else [texts[i][j] for j in draw.permutation(len(texts[i]))[:4]]
                chosen += [(s, float(toxic[i]), 1.0 / len(some)) for s in some]
        if turn:
            flat = [s for i in train for s in texts[i]]
            each = model.sentence_scores(flat, table)
            at = 0
            for i in train:
                own = each[at : at + len(texts[i])]
                at += len(texts[i])
                best = np.argsort(-own)
                if turn >= TRUSTING_ROUNDS and toxic[i] and own[best[0]] < 0:
                    continue
                if toxic[i]:
                    chosen.append((texts[i][best[0]], 1.0, 1.0))
                else:
                    chosen += [(texts[i][j], 0.0, 0.5) for j in best[:2]]
                    chosen.append((texts[i][draw.integers(len(own))], 0.0, 0.3))
        targets = np.array([t for _, t, _ in chosen], np.float32)
        weights = np.array([w for *_, w in chosen], np.float32)
        if len({*targets.tolist()}) < 2:
            break
        for kind in (0, 1):
            weights[targets == kind] /= max(weights[targets == kind].sum(), 1e-9)
        for _ in range(PASSES):
            _train(model, known, [s for s, *_ in chosen], targets, weights * len(chosen), draw, 0.01 / (1 + turn), state)
    fitted = AbuseModel(model.parts, {})
    few = min((held & toxic).sum(), (held & ~toxic).sum()) < LEAST_HELD_OUT
    test = np.flatnonzero(held | few).tolist()  # too few held-out rows of a kind tell nothing alone: all rows do
    scores = fitted.scores([samples[i][0] for i in test])
    langs = [samples[i][2] or "" for i in test]
    kinds = toxic[test]
    fitted.thresholds[""] = best_threshold(scores, kinds)
    for lang in {*langs} - {""}:
        own = np.array([x == lang for x in langs])
        if min(kinds[own].sum(), (~kinds[own]).sum()) >= LEAST_HELD_OUT:
            fitted.thresholds[lang] = best_threshold(scores[own], kinds[own])
    return fitted


#: F1 that a threshold may give away for a wider gap: labels hold mistakes, and a few of them must not move it.
SLACK = 0.01


def best_threshold(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The middle, in log odds, of the gap between scores that gives the best F1; the widest such gap."""
    if not toxic.any() or toxic.all():
        return 0.5
    odds = np.log(np.clip(scores, 1e-6, 1 - 1e-6) / (1 - np.clip(scores, 1e-6, 1 - 1e-6)))
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())
    below = np.append(odds[order][1:], -14.0)
    gap = odds[order] - below
    good = (f1 >= f1.max() - SLACK) & (gap > 0)
    best = np.flatnonzero(good)[np.argmax(gap[good])] if good.any() else int(np.argmax(f1))
    return float(1 / (1 + np.exp(-(odds[order][best] + below[best]) / 2)))


def reviewed(labels: DataFrame, docs: DataFrame, key: str, label: str, text: str, lang: str, rows: int = FIT_ROWS) -> list[tuple[str, int, str | None]]:
    """At most `rows` reviewed documents of each kind, chosen by a hash of the key, with the majority of their labels.

    Null labels and even votes are left out.
    """
    votes = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("share")).where("share <> 0.5")
    kinds = [votes.where(c).orderBy(F.xxhash64(key), key).limit(rows) for c in ("share > 0.5", "share < 0.5")]
    few = kinds[0].unionByName(kinds[1]).select(key, (F.col("share") > 0.5).cast("int").alias("toxic"))
    texts = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t"), label_language(F.col(lang)).alias("l"))
    found = texts.join(F.broadcast(few), key).orderBy(key).collect()  # 2 * rows keys, whatever the corpus
    forms = Canonical()([r.t for r in found])
    return [(form, r.toxic, r.l) for r, form in zip(found, forms, strict=True) if form]


def scored(df: DataFrame, key: str, text: str, lang: str, source: str, model: AbuseModel) -> DataFrame:
    """key, source, score (0 to 1) and toxic of every row. Null, empty and blank texts score 0 and are not toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("t"), label_language(F.col(lang)).alias("l"), F.col(source).cast("string").alias("source"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, form = shared.value, Canonical.shared()
        limits: dict = {}
        for batch in sliced(batches, 1_000_000):
            scores = judge.scores(form(batch.column(1)))
            bounds = np.array([limits.setdefault(x, judge.threshold(x)) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(scores), pa.array((scores >= bounds) & (scores > 0))], names=["key", "source", "score", "toxic"])

    done = spread(rows).mapInArrow(run, f"key {kind}, source string, score double, toxic boolean")
    return done.withColumnRenamed("key", key)


def rates(scores: DataFrame) -> DataFrame:
    """source, documents, toxic (their number), rate, mean score; a null source is a source of its own."""
    return scores.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("toxic").cast("bigint")).alias("toxic"),
        F.avg(F.col("toxic").cast("double")).alias("rate"), F.avg("score").alias("score"),
    )
