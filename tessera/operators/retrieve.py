"""Ranked retrieval: encoders, exact dense and sparse search, fusion, reranking, parents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..sources.tables import spread

#: A stated query set up to this many numbers is sent to every task; a larger one is searched in blocks.
QUERY_BLOCK = 4_000_000
#: Rows (query and bucket) of a stated query set that are sent to every task.
QUERY_ROWS = 200_000
#: Vectors of a stated query set that are sent to every task.
QUERY_VECTORS = 10_000
#: Rows of a scope that one task of a similarity join holds of either side, and how many are compared at once.
JOIN_BLOCK, JOIN_STRIP = 8_000, 1_000


def stated(df: DataFrame, most: int) -> DataFrame:
    """A stated set for a join: sent to every task if it has at most so many rows, else joined by shuffling."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _counts(df: DataFrame, key: str, text: str) -> DataFrame:
    words = spread(df.select(key, text)).select(key, F.explode(T.words(F.lower(F.col(text)))).alias("w"))
    counts = words.groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"))
    # One partitioning by key serves the buckets, the lengths and the scores of each item. Its number is set here, since
    # what follows makes far more rows than adaptive execution would size it by.
    spark = df.sparkSession
    return counts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), key)


def sparse_vectors(df: DataFrame, key: str, text: str, buckets: int = 65536) -> DataFrame:
    """key, bucket, weight: the greatest log(1 + count) of the words in each bucket."""
    return _counts(df, key, text).groupBy(key, V.bucket(F.col("w"), buckets).alias("bucket")).agg(F.max(F.log1p("n")).alias("weight"))


def dense_vectors(df: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """key, bucket, value: log(1 + count) summed by bucket, at length one."""
    sums = _counts(df, key, text).groupBy(key, V.bucket(F.col("w"), dims).alias("bucket")).agg(F.sum(F.log1p("n")).alias("v"))
    return sums.select(key, "bucket", (F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))).alias("value"))


def ranked(df: DataFrame, query: str, *order: Column, k: int | None = None) -> DataFrame:
    """Places from 1 within each query; with k only the first k, which Spark limits before the shuffle."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return out.where(F.col("rank") <= k) if k else out


def dense_top(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, item_id, score, rank of the k most similar items by cosine, exact.

    Both sides have (id, vector). Each block of the stated queries is sent to the tasks, which keep k hits a query
    and batch of items, so the shuffle carries k rows a query and task. A vector of length zero scores 0; ties go to
    the smaller id; a query finds itself if the corpus holds it.
    """
    spark = corpus.sparkSession
    rows = queries.select(queries.columns[0], queries.columns[1]).toDF("q", "v").where("v is not null").toLocalIterator()
    item_kind = corpus.schema[corpus.columns[0]].dataType.simpleString()
    query_kind = queries.schema[queries.columns[0]].dataType.simpleString()
    schema = f"query_id {query_kind}, item_id {item_kind}, score double"
    items = corpus.select(corpus.columns[0], corpus.columns[1]).toDF("id", "v").where("v is not null")

    def searched(block: list) -> DataFrame:
        m = np.array([row.v for row in block], np.float64)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast(([row.q for row in block], np.divide(m, size, out=np.zeros_like(m), where=size > 0)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                own = batch.column(0)
                m = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(batch), -1)
                size = np.linalg.norm(m, axis=1, keepdims=True)
                scores = np.round(matrix @ np.divide(m, size, out=np.zeros_like(m), where=size > 0).T, 9)
                number = np.argsort(np.argsort(np.array(own.to_pylist(), dtype=object), kind="stable"), kind="stable")
                keep = np.stack([np.lexsort((number, -row))[:k] for row in scores])
                which = np.repeat(np.arange(len(names)), keep.shape[1])
                taken = keep.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in which]), own.take(pa.array(taken)), pa.array(scores[which, taken])], names=["query_id", "item_id", "score"]
                )

        return items.mapInArrow(run, schema)

    found, block = None, []
    for row in rows:  # one block of the stated set at a time is held here
        block.append(row)
        if len(block) * len(row.v) >= QUERY_BLOCK:
            found = searched(block) if found is None else found.unionByName(searched(block))
            block = []
    if block:
        found = searched(block) if found is None else found.unionByName(searched(block))
    if found is None:
        found = spark.createDataFrame([], schema)
    return ranked(found, "query_id", F.desc("score"), F.col("item_id"), k=k)


def cosine_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """id_a, id_b, scope, score of all pairs of items (id, scope, vector) of one scope with at least this cosine, exact.

    The rows of a scope are hashed into blocks and every two blocks meet in one task, so nothing is collected or
    broadcast and a task holds two blocks. A vector of length zero scores 0; rows without scope or vector have no pairs.
    """
    rows = items.toDF("id", "scope", "v").where("id is not null and scope is not null and v is not null")
    kind, scope_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "scope"))
    sizes = rows.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / JOIN_BLOCK).cast("int").alias("blocks"))
    own = rows.join(sizes, "scope").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select("id", "scope", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        ids, own = cell.column("id").to_pylist(), cell.column("own").to_numpy()
        m = np.asarray(cell.column("v").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        lo, hi = cell.column("lo")[0].as_py(), cell.column("hi")[0].as_py()
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        a, b, scores = [], [], []
        for at in range(0, len(left), JOIN_STRIP):
            strip = left[at : at + JOIN_STRIP]
            s = np.round(m[strip] @ m[right].T, 9)
            for i, j in zip(*np.nonzero(s >= threshold), strict=True):
                x, y = ids[strip[i]], ids[right[j]]
                if x < y or (lo != hi and y < x):
                    a.append(min(x, y))
                    b.append(max(x, y))
                    scores.append(s[i, j])
        id_type = cell.schema.field("id").type
        scope = pa.array([cell.column("scope")[0].as_py()] * len(a), cell.schema.field("scope").type)
        return pa.table([pa.array(a, id_type), pa.array(b, id_type), scope, pa.array(scores, pa.float64())], names=["id_a", "id_b", "scope", "score"])

    return cells.groupBy("scope", "lo", "hi").applyInArrow(run, f"id_a {kind}, id_b {kind}, scope {scope_kind}, score double")


def cached(queries: DataFrame, entries: DataFrame, threshold: float = 0.96) -> DataFrame:
    """query_id, found, score of each query's most similar entry; null where none reaches the threshold.

    Both sides have (id, namespace, vector, guard). Only an entry of the same namespace with an equal guard (the digit
    tokens of the text) counts, and never the query itself; equal scores go to the smaller id.
    """
    q, e = stated(queries.toDF("query_id", "space", "a", "guard"), QUERY_VECTORS), entries.toDF("found", "space", "b", "guard")
    pairs = q.join(e, ["space", "guard"]).where("query_id <> found").withColumn("s", V.cosine(F.col("a"), F.col("b"))).where(F.col("s") >= threshold)
    best = pairs.withColumn("s", F.round("s", 6)).groupBy("query_id").agg(F.min_by("found", F.struct(-F.col("s"), F.col("found"))).alias("found"), F.max("s").alias("score"))
    return q.select("query_id").join(best, "query_id", "left")


def sparse_top(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, item_id, score, rank by inner product of sparse vectors (id, bucket, weight); items without overlap
    never appear. The inverted index is an equi-join on the bucket. Queries of a checked size go to the corpus, whose
    rows then stay where they are and combine before the shuffle; with more of them AQE splits buckets of common words."""
    q = stated(queries.toDF("query_id", "bucket", "qw"), QUERY_ROWS)
    c = corpus.toDF("item_id", "bucket", "cw")
    scores = q.join(c, "bucket").groupBy("query_id", "item_id").agg(F.round(F.sum(F.col("qw") * F.col("cw")), 6).alias("score"))
    return ranked(scores, "query_id", F.desc("score"), F.col("item_id"), k=k)


def fused(lists: list[DataFrame], weights: list[float | Column] | None = None, k: float = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, item_id, rank): query_id, item_id, score, best, lists, rank.

    A weight is a number or a column of its list. A key may stand once in a list. Equal scores go to the better best rank, the earlier list, the smaller key; the
    limit applies after fusing. k must not be negative.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    weights = weights or [1.0] * len(lists)
    weigh = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    parts = [df.select("query_id", "item_id", "rank", F.lit(i).alias("list"), (weigh(w) / (F.lit(float(k)) + F.col("rank"))).alias("part")) for i, (df, w) in enumerate(zip(lists, weights, strict=True))]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    sums = both.groupBy("query_id", "item_id").agg(
        F.sum("part").alias("score"), F.min("rank").alias("best"), F.min("list").alias("first"), F.count(F.lit(1)).alias("lists")
    ).withColumn("score", F.round("score", 9))
    out = ranked(sums, "query_id", F.desc("score"), F.col("best"), F.col("first"), F.col("item_id"), k=limit)
    return out.drop("first")


def reranked(pool: DataFrame, score: Column, limit: int) -> DataFrame:
    """A pool (query_id, item_id, rank) by a new score; equal scores keep the base order."""
    scored = pool.withColumnRenamed("rank", "base_rank").withColumn("score", score)
    return ranked(scored, "query_id", F.desc("score"), F.col("base_rank"), F.col("item_id"), k=limit)


def hydrated(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Both branches' scores of every hit; null where a branch did not return it."""
    a = dense.select("query_id", "item_id", F.col("score").alias("dense_score"))
    b = sparse.select("query_id", "item_id", F.col("score").alias("sparse_score"))
    return a.join(b, ["query_id", "item_id"], "full")


FILTER_KEYS = {"lang": "eq", "doc_type": "eq", "license": "eq", "source": "eq", "published_after": "from", "published_before": "to"}


def metadata_filter(wanted: dict, columns: dict[str, Column]) -> Column:
    """A conjunction of typed conditions. Unknown keys and empty lists are errors, never "everything"."""
    out = F.lit(True)
    for key, value in wanted.items():
        if key not in FILTER_KEYS:
            raise ValueError(f"unknown filter {key!r}; known: {sorted(FILTER_KEYS)}")
        kind = FILTER_KEYS[key]
        if kind == "eq":
            values = value if isinstance(value, (list, tuple, set)) else [value]
            if not values:
                raise ValueError(f"filter {key!r} is empty")
            out = out & columns[key].isin(*values)
        else:
            column = columns["published_at"]
            out = out & (column >= F.lit(value) if kind == "from" else column <= F.lit(value))
    if {"published_after", "published_before"} <= wanted.keys() and wanted["published_after"] > wanted["published_before"]:
        raise ValueError("the date window is empty")
    return F.coalesce(out, F.lit(False))


def tenant_view(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """Only the rows of a tenant; none at all without one."""
    return df.where(F.lit(False) if tenant is None else F.col(column).eqNullSafe(tenant))


def parents(hits: DataFrame, chunks: DataFrame, most: int | None = None) -> DataFrame:
    """query_id, parent, content, children, hit_children, best, rank: hits (query_id, item_id, rank) replaced by their
    parents, whose children (chunk_id, parent, position, content) are joined in order."""
    own = hits.join(chunks.select(F.col("chunk_id").alias("item_id"), "parent"), "item_id")
    best = own.groupBy("query_id", "parent").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("hit_children"))
    texts = chunks.join(best.select("parent").distinct(), "parent", "left_semi").groupBy("parent").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda s: s["content"]), "\n").alias("content"), F.count(F.lit(1)).alias("children")
    )
    return ranked(best.join(texts, "parent"), "query_id", F.col("best"), F.col("parent"), k=most)
