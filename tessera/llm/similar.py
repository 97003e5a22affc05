"""Groups of records that share most of their words (problem 6): b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, written
from ..sources.tables import spread
from .canonical import Canonical, sliced

#: Rows a band and bands: a pair at similarity 0.7 shares a band with a chance of 0.9990, at 0.75 of 0.99999.
ROWS, BANDS = 7, 80
#: Kept bits of a minimum and minima packed into a signature; chance agreement of two lanes is 2 ** -BITS.
BITS, LANES = 2, 256
#: A candidate goes on to the exact check if its estimate is at most this far below the threshold (5.7 standard errors).
MARGIN = 0.2
SEED = 20240229


def word_sets(df: DataFrame, key: str, text: str, scope: str) -> DataFrame:
    """id, scope, words: the sorted distinct word hashes of each record in consistent form and lower case.

    Null and blank texts and null keys are left out; a null scope is a scope of its own. A text without any letter or
    digit has its whole form as its one word, so that equal ones still meet. Repeated rows count once.
    """
    rows = df.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(scope).cast("string"), F.lit("\0")).alias("scope"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash

        find, known = regex.compile(r"[\p{L}\p{N}]+").findall, {}
        form = Canonical.shared()

        def hashed(word: str) -> int:
            got = known.get(word)
            if got is None:
                if len(known) > 500_000:
                    known.clear()
                got = known[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
            return got

        for batch in sliced(batches):
            ids, scopes, words = [], [], []
            for i, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), form(batch.column(2)), strict=True):
                if t and not t.isspace():
                    low = t.lower()
                    ids.append(i)
                    scopes.append(s)
                    words.append(sorted({hashed(w) for w in find(low) or ["\0" + low]}))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(scopes, pa.string()), pa.array(words, pa.list_(pa.int64()))], names=["id", "scope", "words"])

    made = spread(rows.where("id is not null and t is not null")).mapInArrow(run, "id string, scope string, words array<bigint>")
    return made.dropDuplicates(["id", "scope", "words"])


def minhash(offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The minima (32 bits) of ROWS * BANDS random functions over each set; sets must not be empty."""
    draw = np.random.default_rng(SEED)
    count = ROWS * BANDS
    a = draw.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 2**63, count, dtype=np.uint64)
    x = words.astype(np.int64).view(np.uint64)
    out = np.empty((count, len(offsets) - 1), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(count):
            out[i] = np.minimum.reduceat(((x * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), offsets[:-1])
    return out


def packed(minima: np.ndarray) -> np.ndarray:
    """The low BITS of the first LANES minima of each set in 64-bit numbers."""
    each = 64 // BITS
    low = (minima[:LANES] & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    shifts = (np.arange(each, dtype=np.uint64) * np.uint64(BITS))[None, :, None]
    return np.bitwise_or.reduce(low.reshape(LANES // each, each, -1) << shifts, axis=1).view(np.int64).T


def bands(minima: np.ndarray, scopes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each set, apart for each scope (its hash)."""
    draw = np.random.default_rng(SEED + 1)
    odd = draw.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        mixed = (minima.reshape(BANDS, ROWS, -1).astype(np.uint64) * odd[None, :, None]).sum(axis=1, dtype=np.uint64)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0xD1B54A32D192ED03) + scopes.astype(np.int64).view(np.uint64)[None, :]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed.view(np.int64).T


def signatures(classes: DataFrame) -> DataFrame:
    """cid, size, buckets, signature of each class of equal word sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1_000_000):
            if not len(batch):
                continue
            lists = batch.column(2)
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            minima = minhash(offsets - offsets[0], np.asarray(lists.flatten()))
            columns = []
            for rows in (bands(minima, np.asarray(batch.column(1))), packed(minima)):
                flat = pa.array(np.ascontiguousarray(rows).ravel(), pa.int64())
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, rows.shape[1], dtype=np.int32)), flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int32)), *columns], names=["cid", "size", "buckets", "signature"])

    return spread(classes.select("cid", F.xxhash64("scope").alias("s"), "words")).mapInArrow(run, "cid bigint, size int, buckets array<bigint>, signature array<bigint>")


def estimate(a: str, b: str):
    """Similarity from two packed signatures: agreeing lanes, corrected for lanes that agree by chance."""
    lanes = F.lit(int("01" * (64 // BITS), 2))
    differing = F.lit(0)
    for i in range(LANES * BITS // 64):
        z = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        differing = differing + F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(lanes))
    chance = 2.0**-BITS
    return (1 - differing / LANES - chance) / (1 - chance)


class SimilarSets:
    """members (id, scope, cid) and links (cid_a, cid_b, similarity) between classes of different word sets."""

    def __init__(self, sets: DataFrame, threshold: float):
        sets = written(sets)
        # Equal sets form one class: copies, however many, are hashed and compared once. The class is named by its
        # smallest id; its number is given once, when the classes are written, so no two classes share one.
        named = sets.groupBy("scope", "words").agg(F.min("id").alias("rep"))
        self.classes = written(named.withColumn("cid", F.monotonically_increasing_id()))
        self.members = sets.join(self.classes, ["scope", "words"]).select("id", "scope", "cid", "rep")
        made = written(signatures(self.classes))
        keyed = made.select("cid", "size", F.explode("buckets").alias("bucket"))
        a, b = (keyed.select("bucket", F.col("cid").alias(f"cid_{s}"), F.col("size").alias(f"size_{s}")) for s in "ab")
        # AQE splits a hot bucket among tasks; nothing is collected per bucket. Sets too unlike in size can't reach the
        # threshold.
        sized = (F.col("size_a") >= threshold * F.col("size_b") - 1e-9) & (F.col("size_b") >= threshold * F.col("size_a") - 1e-9)
        pairs = a.join(b.hint("merge"), "bucket").where("cid_a < cid_b").where(sized).select("cid_a", "cid_b").distinct()
        bits = made.select("cid", "signature")
        for side in "ab":
            pairs = pairs.join(bits.select(F.col("cid").alias(f"cid_{side}"), F.col("signature").alias(f"signature_{side}")), f"cid_{side}")
        likely = pairs.where(estimate("signature_a", "signature_b") >= threshold - MARGIN).select("cid_a", "cid_b")
        for side in "ab":
            full = self.classes.select(*[F.col(c).alias(c if c == f"cid_{side}" else f"{c}_{side}") for c in ("scope", "words", "rep")], F.col("cid").alias(f"cid_{side}"))
            likely = likely.join(full, f"cid_{side}")
        shared = F.size(F.array_intersect("words_a", "words_b"))
        union = F.size("words_a") + F.size("words_b") - shared
        checked = likely.where("scope_a = scope_b").withColumn("similarity", shared / union)
        self.links = written(checked.where(F.col("similarity") >= threshold - 1e-12).select("cid_a", "cid_b", "rep_a", "rep_b", "similarity"))

    def pairs(self) -> DataFrame:
        """Every pair of records: those within a class, and those of linked classes. id_a is the smaller."""
        a, b = (self.members.select(F.col("id").alias(f"i{s}"), F.col("rep").alias(f"rep_{s}"), F.col("scope").alias(f"scope_{s}")) for s in "ab")
        own = a.join(b, (F.col("rep_a") == F.col("rep_b")) & (F.col("scope_a") == F.col("scope_b"))).where("ia < ib").select("ia", "ib")
        across = self.links.select("rep_a", "rep_b").join(a.drop("scope_a"), "rep_a").join(b.drop("scope_b"), "rep_b").select("ia", "ib").where("ia <> ib")
        both = own.unionByName(across)
        return both.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()

    def groups(self) -> DataFrame:
        """id, scope, class (its smallest id), group (the smallest id that is linked by any chain), links of the class."""
        both = self.links.select("rep_a", "rep_b").unionByName(self.links.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b")))
        both = written(both)
        degree = both.groupBy("rep_a").agg(F.count(F.lit(1)).alias("links"))
        label = cut(degree.select(F.col("rep_a").alias("rep"), F.col("rep_a").alias("group")))
        while True:  # labels only fall, and halve their way along a chain in each round
            near = both.join(label, both.rep_b == label.rep).groupBy("rep_a").agg(F.min("group").alias("near"))
            lower = label.join(near, label.rep == near.rep_a).select("rep", F.least("group", "near").alias("group"), (F.col("near") < F.col("group")).alias("moved"))
            # Jump: take the label of one's label, which halves long chains.
            jump = lower.select(F.col("rep").alias("group"), F.col("group").alias("over"))
            after = cut(lower.join(jump, "group", "left").select("rep", F.coalesce(F.least("group", "over"), "group").alias("group"), "moved"))
            label = after.select("rep", "group")
            if not after.where("moved").limit(1).count():
                break
        out = self.members.join(label, "rep", "left").join(degree.withColumnRenamed("rep_a", "rep"), "rep", "left")
        return out.select("id", "scope", F.col("rep").alias("class"), F.coalesce("group", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
