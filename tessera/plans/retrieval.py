"""Search, fusion and their evaluation, over whole tables."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import metrics as M
from ..operators import passages as P
from ..operators import retrieve as R
from ..sources.tables import table
from .registry import query

_WORD = T.WORD.replace("{", "{{").replace("}", "}}")  # for str.format
_DOT = "list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_SIZE = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_DENSE = f"""SELECT q.vec_id AS query_id, c.vec_id AS item_id, round({_DOT} / ({_SIZE.format('q')} * {_SIZE.format('c')}), 6) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT} / ({_SIZE.format('q')} * {_SIZE.format('c')}), 9) DESC, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0"""


def _dense(spark, d, k=50):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.dense_top(e.where("vec_id % 100 = 0"), e, k)


@query(f"SELECT query_id, item_id, score, rank::INT AS rank FROM ({_DENSE}) WHERE rank <= 10")
def dense_topk(spark, d):
    return _dense(spark, d, 10).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, item_id, score, rank::INT AS rank FROM ({_DENSE} AND c.label IN (1, 3, 5)) WHERE rank <= 10")
def dense_topk_filtered(spark, d):
    e = table(spark, d, "embeddings")
    found = R.dense_top(e.where("vec_id % 100 = 0").select("vec_id", "embedding"), e.where(F.col("label").isin(1, 3, 5)).select("vec_id", "embedding"), 10)
    return found.withColumn("score", F.round("score", 6))


_TOKENS = "SELECT {key} AS id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 65536)::INT AS bucket, max(ln(1 + n)) AS weight FROM (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '" + _WORD + "')) AS w FROM {table} WHERE text IS NOT NULL) GROUP BY ALL) GROUP BY ALL"
_SPARSE = f"""SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT q.id AS query_id, c.id AS item_id, round(sum(q.weight * c.weight), 6) AS score
    FROM ({_TOKENS.format(key='item_id', table='eval_item')}) q JOIN ({_TOKENS.format(key='doc_id', table='documents')}) c USING (bucket) GROUP BY ALL)"""


def _sparse(spark, d, k=50):
    q = R.sparse_vectors(table(spark, d, "eval_item").where("text is not null"), "item_id", "text")
    c = R.sparse_vectors(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return R.sparse_top(q, c, k)


@query(f"SELECT query_id, item_id, score, rank::INT AS rank FROM ({_SPARSE}) WHERE rank <= 10")
def sparse_topk(spark, d):
    return _sparse(spark, d, 10)


_DENSE_TEXT = "SELECT {key} AS id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS value FROM (SELECT {key}, (('0x' || substr(md5(w), 1, 8))::BIGINT % 64)::INT AS bucket, sum(ln(1 + n)) AS v FROM (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '" + _WORD + "')) AS w FROM {table} WHERE text IS NOT NULL) GROUP BY ALL) GROUP BY ALL)"
_HYBRID = f"""WITH dense AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT q.id AS query_id, c.id AS item_id, round(sum(q.value * c.value), 6) AS score
    FROM ({_DENSE_TEXT.format(key='item_id', table='eval_item')}) q JOIN ({_DENSE_TEXT.format(key='doc_id', table='documents')}) c USING (bucket) GROUP BY ALL) QUALIFY rank <= 50),
    sparse AS (SELECT query_id, item_id, rank FROM ({_SPARSE}) WHERE rank <= 50),
    lists AS (SELECT *, 0 AS list, 1.0 / (1 + rank) AS part FROM dense UNION ALL SELECT *, 1, 0.25 / (1 + rank) FROM sparse),
    fused AS (SELECT query_id, item_id, round(sum(part), 9) AS score, min(rank) AS best, min(list) AS first FROM lists GROUP BY ALL),
    top AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, first, item_id) AS rank FROM fused QUALIFY rank <= 10)"""


def _hybrid(spark, d):
    def vectors(name, key):
        rows = R.dense_vectors(table(spark, d, name).where("text is not null"), key, "text", 64)
        return rows.select(F.col(key).alias("id"), "bucket", F.col("value").alias("weight"))

    q, c = vectors("eval_item", "item_id"), vectors("documents", "doc_id")
    return R.fused([R.sparse_top(q, c, 50), _sparse(spark, d)], [1.0, 0.25], k=1, limit=10)


@query(
    _HYBRID
    + """, gold AS (SELECT i.item_id, i.lang, count(d.doc_id) AS n FROM eval_item i LEFT JOIN documents d ON d.text IS NOT NULL AND contains(d.text, i.text) GROUP BY ALL),
    hits AS (SELECT t.query_id, count(*) AS h, max(1.0 / t.rank) AS rr FROM top t JOIN eval_item i ON i.item_id = t.query_id JOIN documents d ON d.doc_id = t.item_id WHERE contains(d.text, i.text) GROUP BY ALL)
    SELECT lang, count(*) AS queries, count(*) FILTER (n = 0) AS unlabelled, round(avg(CASE WHEN n > 0 THEN coalesce(h, 0) / n END), 6) AS recall_10, round(avg(CASE WHEN n > 0 THEN coalesce(rr, 0) END), 6) AS mrr
    FROM gold LEFT JOIN hits ON hits.query_id = gold.item_id GROUP BY GROUPING SETS ((), (lang))"""
)
def hybrid_passages(spark, d):
    """Held-out passages searched in the corpus by two branches, fused, and scored where they stand verbatim."""
    items, docs = table(spark, d, "eval_item"), table(spark, d, "documents").where("text is not null")
    stands = P.occurrences(docs, "doc_id", "text", items, "item_id", "text").select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("item_id")).distinct()
    labels = stands.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    gold = items.select(F.col("item_id").alias("query_id"), "lang").join(labels, "query_id", "left").withColumn("n_relevant", F.coalesce("n", F.lit(0)))
    hits = _hybrid(spark, d).select("query_id", "item_id", "rank").join(stands, ["query_id", "item_id"])
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("h"), F.max(1 / F.col("rank")).alias("rr"))
    known = lambda c: F.when(F.col("n_relevant") > 0, c)
    scored = gold.join(found, "query_id", "left").select(
        "lang", "n_relevant", known(F.coalesce("h", F.lit(0)) / F.col("n_relevant")).alias("recall_10"), known(F.coalesce("rr", F.lit(0.0))).alias("mrr")
    )
    return M.summary(scored, ["recall_10", "mrr"], [[], ["lang"]])


@query(_HYBRID + " SELECT query_id, item_id, rank::INT AS rank FROM top")
def hybrid_topk(spark, d):
    return _hybrid(spark, d).select("query_id", "item_id", "rank")


_BRANCH = "SELECT run_name || '/' || query_id AS query_id, chunk_id AS item_id, {score} AS score, row_number() OVER (PARTITION BY run_name, query_id ORDER BY {score} DESC, chunk_id) AS rank FROM (SELECT DISTINCT run_name, query_id, chunk_id, dense_score, sparse_score FROM retrieved_chunk WHERE run_name IS NOT NULL AND query_id IS NOT NULL) WHERE {score} IS NOT NULL AND NOT isnan({score})"


def branch(spark, d, score):
    rows = table(spark, d, "retrieved_chunk").where("run_name is not null and query_id is not null").select("run_name", "query_id", "chunk_id", "dense_score", "sparse_score").distinct()
    rows = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).select(F.concat_ws("/", "run_name", "query_id").alias("query_id"), F.col("chunk_id").alias("item_id"), F.col(score).alias("score"))
    return R.ranked(rows, "query_id", F.desc("score"), F.col("item_id"))


@query(
    f"""WITH l AS (SELECT query_id, item_id, rank, 0 AS list, 1.0 / (60 + rank) AS part FROM ({_BRANCH.format(score='dense_score')}) UNION ALL SELECT query_id, item_id, rank, 1, 1.0 / (60 + rank) FROM ({_BRANCH.format(score='sparse_score')})),
    f AS (SELECT query_id, item_id, round(sum(part), 9) AS score, min(rank)::INT AS best, min(list) AS first, count(*) AS lists FROM l GROUP BY ALL)
    SELECT query_id, item_id, round(score, 6) AS score, best, lists, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, first, item_id)::INT AS rank FROM f"""
)
def rrf_fusion(spark, d):
    lists = [branch(spark, d, s) for s in ("dense_score", "sparse_score")]
    return R.fused(lists).withColumn("score", F.round("score", 6))


@query(
    f"""WITH l AS (SELECT query_id, item_id, rank, 0 AS list, 1.0 / (1 + rank) AS part FROM ({_BRANCH.format(score='dense_score')}) UNION ALL SELECT query_id, item_id, rank, 1, 0.25 / (1 + rank) FROM ({_BRANCH.format(score='sparse_score')})),
    f AS (SELECT query_id, item_id, round(sum(part), 9) AS score, min(rank) AS best, min(list) AS first FROM l GROUP BY ALL)
    SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, first, item_id)::INT AS rank FROM f QUALIFY rank <= 10"""
)
def rrf_weighted(spark, d):
    lists = [branch(spark, d, s) for s in ("dense_score", "sparse_score")]
    return R.fused(lists, [1.0, 0.25], k=1, limit=10).select("query_id", "item_id", "rank")


@query(f"SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.item_id, b.item_id) AS item_id, a.score AS dense_score, b.score AS sparse_score FROM ({_BRANCH.format(score='dense_score')}) a FULL JOIN ({_BRANCH.format(score='sparse_score')}) b ON a.query_id = b.query_id AND a.item_id = b.item_id")
def fusion_hydration(spark, d):
    return R.hydrated(branch(spark, d, "dense_score"), branch(spark, d, "sparse_score"))


@query(
    f"""SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY words DESC, base, item_id)::INT AS rank FROM (SELECT s.query_id, s.item_id, s.rank AS base,
    len(list_intersect(list_distinct(regexp_extract_all(lower(i.text), '{T.WORD}')), regexp_extract_all(lower(d.text), '{T.WORD}'))) AS words FROM ({_SPARSE}) s JOIN eval_item i ON i.item_id = s.query_id JOIN documents d ON d.doc_id = s.item_id WHERE s.rank <= 50) QUALIFY rank <= 10"""
)
def lexical_rerank(spark, d):
    items = table(spark, d, "eval_item").select(F.col("item_id").alias("query_id"), T.token_set(F.col("text")).alias("asked"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), T.token_set(F.col("text")).alias("said"))
    pool = _sparse(spark, d).drop("score").join(items, "query_id").join(docs, "item_id")
    return R.reranked(pool, F.size(F.array_intersect("asked", "said")), 10).select("query_id", "item_id", "rank")


@query("SELECT doc_id, metadata.lang AS lang, metadata.doc_type AS doc_type FROM source_docs WHERE metadata.lang IN ('vi', 'en') AND metadata.doc_type = 'legal' AND metadata.published_at >= TIMESTAMPTZ '2015-01-01 00:00:00+00' AND metadata.published_at <= TIMESTAMPTZ '2022-12-31 00:00:00+00'")
def metadata_filters(spark, d):
    docs = table(spark, d, "source_docs")
    columns = {"lang": F.col("metadata.lang"), "doc_type": F.col("metadata.doc_type"), "published_at": F.col("metadata.published_at")}
    from datetime import datetime, timezone

    wanted = {"lang": ["vi", "en"], "doc_type": "legal", "published_after": datetime(2015, 1, 1, tzinfo=timezone.utc), "published_before": datetime(2022, 12, 31, tzinfo=timezone.utc)}
    return docs.where(R.metadata_filter(wanted, columns)).select("doc_id", columns["lang"].alias("lang"), columns["doc_type"].alias("doc_type"))


@query("SELECT id, tenant_id FROM message WHERE tenant_id = 'ten-a'")
def tenant_rows(spark, d):
    return R.tenant_view(table(spark, d, "message"), "ten-a").select("id", "tenant_id")


@query(
    f"""WITH c AS (SELECT DISTINCT chunk_id, doc_id, split_part(chunk_id, '::', 2)::INT AS position FROM retrieved_chunk WHERE chunk_id IS NOT NULL),
    h AS (SELECT query_id, item_id, rank FROM ({_BRANCH.format(score='dense_score')}) WHERE rank <= 10),
    b AS (SELECT query_id, doc_id AS parent, min(rank)::INT AS best, count(*) AS hit_children FROM h JOIN c ON c.chunk_id = h.item_id GROUP BY ALL),
    t AS (SELECT doc_id AS parent, string_agg(chunk_id, chr(10) ORDER BY position, chunk_id) AS content, count(*) AS children FROM c GROUP BY ALL)
    SELECT query_id, parent, content, children, hit_children, best, row_number() OVER (PARTITION BY query_id ORDER BY best, parent)::INT AS rank FROM b JOIN t USING (parent) QUALIFY rank <= 3"""
)
def parent_expansion(spark, d):
    rows = table(spark, d, "retrieved_chunk").where("chunk_id is not null").select("chunk_id", F.col("doc_id").alias("parent")).distinct()
    chunks = rows.withColumn("position", F.split_part("chunk_id", F.lit("::"), F.lit(2)).cast("int")).withColumn("content", F.col("chunk_id"))
    return R.parents(branch(spark, d, "dense_score").where("rank <= 10"), chunks, 3)


@query(f"SELECT query_id, CASE WHEN count(*) < 5 THEN 0 ELSE round(max(score) FILTER (rank = 1) / nullif(median(score) FILTER (rank BETWEEN 2 AND 10), 0), 6) END AS peak FROM ({_BRANCH.format(score='dense_score')}) GROUP BY ALL")
def peakedness(spark, d):
    rows = branch(spark, d, "dense_score")
    peak = F.max(F.when(F.col("rank") == 1, F.col("score"))) / F.nullif(F.median(F.when(F.col("rank").between(2, 10), F.col("score"))), F.lit(0.0))
    return rows.groupBy("query_id").agg(F.when(F.count(F.lit(1)) < 5, 0.0).otherwise(F.round(peak, 6)).alias("peak"))


@query("SELECT doc_id, count(DISTINCT chunk_id) AS chunks, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM retrieved_chunk GROUP BY doc_id")
def filter_selectivity(spark, d):
    rows = table(spark, d, "retrieved_chunk").groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.count(F.lit(1)).alias("n"))
    total = table(spark, d, "retrieved_chunk").count()
    return rows.select("doc_id", "chunks", F.round(F.col("n") / total, 6).alias("share"))


@query("SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.label AS label FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND " + _DOT.replace("q.", "a.").replace("c.", "b.") + " >= 0.2")
def cosine_neighbours(spark, d):
    """Similar items of one label for the stated queries, against all rows; `cosine_pairs` joins all rows."""
    e = table(spark, d, "embeddings")
    a, b = (e.select(F.col("vec_id").alias(f"id_{s}"), "label", F.col("embedding").alias(s)) for s in "ab")
    pairs = b.join(R.stated(a.where("id_a % 100 = 0"), R.QUERY_VECTORS), "label").where("id_a <> id_b")
    return pairs.where(V.dot(F.col("a"), F.col("b")) >= 0.2).select("id_a", "id_b", "label")


@query(f"SELECT q.vec_id AS id_a, c.vec_id AS id_b, q.label AS label FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id < c.vec_id WHERE round({_DOT} / ({_SIZE.format('q')} * {_SIZE.format('c')}), 9) >= 0.2")
def cosine_pairs(spark, d):
    """The similarity self-join: all pairs of items of one label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return R.cosine_pairs(e, 0.2).select("id_a", "id_b", F.col("scope").alias("label"))
