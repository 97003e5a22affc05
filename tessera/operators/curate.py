"""Curation: deduplication, spans and anchors, triage, reconciliation of snapshots, keyed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, written


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def token_classes(sets: DataFrame) -> DataFrame:
    """scope, key, id of every record (id, scope, tokens), once: records of a scope with equal tokens share the key.

    A record without tokens is like no other, so its key is its own id.
    """
    words = F.array_sort("tokens")
    key = F.when(F.size("tokens") > 0, F.md5(F.array_join(words, " "))).otherwise(F.col("id").cast("string"))
    return sets.where("scope is not null and tokens is not null").select("scope", key.alias("key"), "id").distinct()


def _alike(sets: DataFrame, threshold: float) -> DataFrame:
    """scope, key_a, key_b, similarity of different token sets of a scope, key_a < key_b; exact.

    Prefix filtering: with tokens from rare to frequent, two sets that reach the threshold share one of the first
    n - ceil(t * n) + 1, so only rare tokens are joined on.
    """
    words = F.array_sort("tokens")
    named = sets.where(F.size("tokens") > 0).select("scope", F.md5(F.array_join(words, " ")).alias("key"), words.alias("tokens")).dropDuplicates(["scope", "key"])
    frequency = named.select("scope", F.explode("tokens").alias("t")).groupBy("scope", "t").agg(F.count(F.lit(1)).alias("df"))
    placed = named.select("key", "scope", F.explode("tokens").alias("t"), F.size("tokens").alias("n")).join(frequency, ["scope", "t"])
    w = Window.partitionBy("scope", "key").orderBy("df", "t")
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    prefix = placed.withColumn("i", F.row_number().over(w)).where(F.col("i") <= keep).select("key", "scope", "t", "n")
    a, b = (prefix.select("scope", "t", F.col("key").alias(f"key_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    sized = (F.col("n_a") >= F.col("n_b") * threshold - 1e-9) & (F.col("n_b") >= F.col("n_a") * threshold - 1e-9)
    pairs = a.join(b, ["scope", "t"]).where(F.col("key_a") < F.col("key_b")).where(sized).select("scope", "key_a", "key_b").distinct()
    for s in "ab":
        pairs = pairs.join(named.select("scope", F.col("key").alias(f"key_{s}"), F.col("tokens").alias(s)), ["scope", f"key_{s}"])
    shared = F.size(F.array_intersect("a", "b"))
    scored = pairs.withColumn("similarity", shared / (F.size("a") + F.size("b") - shared))
    return scored.where(F.col("similarity") >= threshold - 1e-12).select("scope", "key_a", "key_b", "similarity")


def jaccard_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """id_a, id_b, similarity, scope of representatives of equal token sets (id, scope, tokens) within a scope; exact.

    Equal sets are one representative, their smallest id; jaccard_members has all the records.
    """
    first = token_classes(sets).groupBy("scope", "key").agg(F.min("id").alias("id"))
    pairs = _alike(sets, threshold)
    for s in "ab":
        pairs = pairs.join(first.select("scope", F.col("key").alias(f"key_{s}"), F.col("id").alias(s)), ["scope", f"key_{s}"])
    return pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "similarity", "scope")


def jaccard_members(sets: DataFrame, threshold: float) -> DataFrame:
    """id, scope, class_id, representative, members, links of every record (id, scope, tokens), once.

    A class holds the records of a scope with equal tokens, the representative is its smallest id, and links counts the
    other records of the scope that reach the threshold, those of the own class among them. A record is an id with its
    tokens.
    """
    records = token_classes(sets)
    classes = records.groupBy("scope", "key").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("members"))
    pairs = _alike(sets, threshold)
    ends = F.array(F.struct(F.col("key_a").alias("key"), F.col("key_b").alias("other")), F.struct(F.col("key_b").alias("key"), F.col("key_a").alias("other")))
    both = pairs.select("scope", F.explode(ends).alias("e")).select("scope", "e.key", "e.other")
    sizes = classes.select("scope", F.col("key").alias("other"), F.col("members").alias("n"))
    beyond = both.join(sizes, ["scope", "other"]).groupBy("scope", "key").agg(F.sum("n").alias("n"))
    linked = classes.join(beyond, ["scope", "key"], "left").withColumn("links", F.col("members") - 1 + F.coalesce("n", F.lit(0)))
    return records.join(linked, ["scope", "key"]).select("id", "scope", F.col("key").alias("class_id"), "representative", "members", "links")


def greedy_members(sets: DataFrame, threshold: float, *richness: str) -> DataFrame:
    """id, scope, kept_by of every record (id, scope, tokens, ..), once: records are gone through from the richest on (by
    numeric columns, then by id), and one that reaches the threshold with a kept record of its scope is dropped for the
    richest such one, else kept.

    Records with equal tokens fall to their richest one first, so only classes are compared. A class is kept once all its
    richer neighbours are dropped, and dropped once one of them is kept; rounds go on until all are decided, and each
    decides at least the richest open class of every group.
    """
    w = Window.partitionBy("scope", "key").orderBy(*[F.desc(c) for c in richness], "id")
    key = F.when(F.size("tokens") > 0, F.md5(F.array_join(F.array_sort("tokens"), " "))).otherwise(F.col("id").cast("string"))
    rows = sets.where("scope is not null and tokens is not null").withColumn("key", key).withColumn("n", F.row_number().over(w))
    members = rows.select("id", "scope", "key").distinct()
    first = rows.where("n = 1").withColumn("r", F.struct(*[(-F.col(c)).alias(f"o{i}") for i, c in enumerate(richness)], "id"))
    heads = written(first.select("scope", "key", "id", "r"))
    links = _alike(sets.where("scope is not null and tokens is not null"), threshold).select("scope", "key_a", "key_b")
    ends = links.unionByName(links.select("scope", F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))
    for s in "ab":
        ends = ends.join(heads.select("scope", F.col("key").alias(f"key_{s}"), F.col("r").alias(f"r_{s}")), ["scope", f"key_{s}"])
    richer = written(ends.where("r_b < r_a").select("scope", "key_a", "key_b", "r_b"))  # key_b goes before key_a
    state = cut(heads.select("scope", "key", F.lit(None).cast("boolean").alias("kept")))
    while True:
        near = richer.join(state.select("scope", F.col("key").alias("key_b"), F.col("kept").alias("k")), ["scope", "key_b"])
        seen = near.groupBy("scope", F.col("key_a").alias("key")).agg(F.bool_or(F.coalesce("k", F.lit(False))).alias("some"), F.bool_or(F.col("k").isNull()).alias("open"))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("some"), False).when(~F.coalesce("open", F.lit(False)), True)
        state = cut(state.join(seen, ["scope", "key"], "left").select("scope", "key", now.alias("kept")))
        if not state.where("kept is null").limit(1).count():
            break
    chosen = richer.join(state.where("kept").select("scope", F.col("key").alias("key_b")), ["scope", "key_b"]).groupBy("scope", F.col("key_a").alias("key")).agg(F.min("r_b")["id"].alias("other"))
    named = heads.join(state, ["scope", "key"]).join(chosen, ["scope", "key"], "left").select("scope", "key", F.when(F.col("kept"), F.col("id")).otherwise(F.col("other")).alias("kept_by"))
    return members.join(named, ["scope", "key"]).select("id", "scope", "kept_by")


def overlaps(spans: DataFrame, chunks: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Spans (doc_id, span_id, s, e) joined with the chunks (doc_id, chunk_id, start, stop) that they overlap by at
    least the ratio of either's length."""
    both = spans.join(chunks, "doc_id").where((F.col("s") < F.col("stop")) & (F.col("start") < F.col("e")))
    shared = F.least("e", "stop") - F.greatest("s", "start")
    enough = (shared >= ratio * (F.col("e") - F.col("s"))) | (shared >= ratio * (F.col("stop") - F.col("start")))
    return both.withColumn("shared", shared).where(enough)


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: added, removed, changed or unchanged."""
    both = old.select(key, F.col(digest).alias("o")).join(new.select(key, F.col(digest).alias("n")), key, "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def upserted(store: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The store with fresh rows in place of those of the same keys; applying it again changes nothing."""
    return store.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def reused(new: DataFrame, old: DataFrame) -> DataFrame:
    """New chunks (doc_id, chunk_index, digest) with the first old index of equal content in the document, if any."""
    first = old.groupBy("doc_id", "digest").agg(F.min("chunk_index").alias("old_index"))
    return new.join(first, ["doc_id", "digest"], "left")


def stale(counts: DataFrame) -> DataFrame:
    """doc_id, chunk_id of old chunks beyond a document's new number (doc_id, old_n, new_n)."""
    gone = counts.where("old_n > new_n").select("doc_id", F.explode(F.sequence(F.col("new_n"), F.col("old_n") - 1)).alias("i"))
    return gone.select("doc_id", F.format_string("%s::%05d", "doc_id", F.col("i").cast("int")).alias("chunk_id"))


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The rows, or an error that names a repeated key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    shown = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return df.withColumn("_n", F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key "), shown))).otherwise(n)).where("_n = 1").drop("_n")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of columns joined by bars; a null is empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)
