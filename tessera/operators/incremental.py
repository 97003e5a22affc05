"""Incremental indexes, caches with age and size limits, resumable work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def index_update(old: DataFrame, new: DataFrame) -> DataFrame:
    """What to do with every chunk (doc_id, chunk_index, digest) between two states.

    action: keep (same place and content), reuse (content known in the document at old_index), encode (new content),
    delete (place gone). One full join by place and one by content; nothing is gathered.
    """
    o = old.select("doc_id", "chunk_index", F.col("digest").alias("was"))
    both = o.join(new, ["doc_id", "chunk_index"], "full")
    first = old.groupBy("doc_id", "digest").agg(F.min("chunk_index").alias("old_index"))
    known = both.join(first, ["doc_id", "digest"], "left")
    action = (
        F.when(F.col("digest").isNull(), "delete").when(F.col("was").eqNullSafe(F.col("digest")), "keep")
        .when(F.col("old_index").isNotNull(), "reuse").otherwise("encode")
    )
    return known.select("doc_id", "chunk_index", action.alias("action"), F.when(action == "reuse", F.col("old_index")).alias("old_index"))


def cache_state(writes: DataFrame, space: str, key: str, at: str, now: Column, ttl_seconds: float, cap: int) -> DataFrame:
    """The entries of each space after all writes: the newest of each key, within its life, the newest `cap` of them."""
    newest = writes.groupBy(space, key).agg(F.max(at).alias(at), F.count(F.lit(1)).alias("writes"))
    alive = newest.where((F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6 <= ttl_seconds)
    w = Window.partitionBy(space).orderBy(F.desc(at), F.desc(key))
    return alive.withColumn("age", F.row_number().over(w)).where(F.col("age") <= cap)


def remaining(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Work that is not done yet under the same keys."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def looked_up(texts: DataFrame, store: DataFrame, text: str, vector: str) -> DataFrame:
    """Stored vectors of exact texts; a text without one is an error."""
    known = store.select(text, vector).dropDuplicates([text])
    both = texts.join(known, text, "left")
    missing = F.raise_error(F.concat(F.lit("no stored vector for: "), F.substring(F.col(text), 1, 80)))
    return both.withColumn(vector, F.when(F.col(vector).isNull(), missing).otherwise(F.col(vector)))


def merged_metrics(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Two metric tables as one; a name in both is an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy(name))
    both = a.unionByName(b).withColumn("_n", n)
    clash = F.raise_error(F.concat(F.lit("metric in both tables: "), F.col(name)))
    return both.withColumn("_n", F.when(F.col("_n") > 1, clash).otherwise(F.col("_n"))).where("_n = 1").drop("_n")


def trace_tree(spans: DataFrame) -> DataFrame:
    """Each span (trace, id, parent) with its depth below the root; a missing parent makes a root, and a span in a circle
    has a null depth.

    One join a level over the spans that are still open, so work ends with the deepest trace.
    """
    known = spans.select("trace", F.col("id").alias("parent"))
    level = cut(spans.join(known, ["trace", "parent"], "left_anti").select("trace", "id").distinct().withColumn("depth", F.lit(0)))
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        below = spans.join(level.select("trace", F.col("id").alias("parent")), ["trace", "parent"]).select("trace", "id").distinct()
        level = cut(below.join(out.select("trace", "id"), ["trace", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        out = out.unionByName(level)
    return spans.select("trace", "id").distinct().join(out, ["trace", "id"], "left")
