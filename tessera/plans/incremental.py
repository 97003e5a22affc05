"""Incremental indexes, caches, calibration and comparability over whole tables."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as C
from ..operators import incremental as I
from ..operators import stats as S
from ..sources.tables import table
from .registry import query

_SLICES = "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk_index, md5(substr(t, start::INT + 1, 500)) AS digest FROM (SELECT doc_id, t, unnest(range(0, length(t), 500)) AS start FROM ({}))"
_OLD = "SELECT doc_id, text AS t FROM documents WHERE length(text) > 0 AND doc_id % 10 <> 3"
_NEW = "SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN 'new line' || chr(10) || text ELSE text END AS t FROM documents WHERE length(text) > 0 AND doc_id % 10 <> 7"


@query(
    f"""WITH o AS ({_SLICES.format(_OLD)}), n AS ({_SLICES.format(_NEW)}), f AS (SELECT doc_id, digest, min(chunk_index) AS old_index FROM o GROUP BY ALL),
    b AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.chunk_index, n.chunk_index) AS chunk_index, o.digest AS was, n.digest FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.chunk_index = n.chunk_index),
    a AS (SELECT b.doc_id, chunk_index, old_index, CASE WHEN b.digest IS NULL THEN 'delete' WHEN was = b.digest THEN 'keep' WHEN old_index IS NOT NULL THEN 'reuse' ELSE 'encode' END AS action FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.digest = b.digest)
    SELECT doc_id, chunk_index, action FROM a"""
)
def index_update(spark, d):
    """Two states of the corpus, made by a rule: some documents gone, some new, some with a line added."""
    docs = table(spark, d, "documents").where("length(text) > 0").select("doc_id", "text")
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 5, F.concat(F.lit("new line\n"), "text")).otherwise(F.col("text")))

    def chunks(rows):
        return C.hard_slices(rows, "doc_id", "text", 500, 500).select("doc_id", "chunk_index", F.md5("content").alias("digest"))

    return I.index_update(chunks(docs.where("doc_id % 10 <> 3")), chunks(edited.where("doc_id % 10 <> 7"))).drop("old_index")


@query("SELECT user_id, event_type, writes, age::INT AS age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type DESC) AS age FROM (SELECT user_id, event_type, count(*) AS writes, max(ts) AS last FROM events GROUP BY user_id, event_type) WHERE epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last) <= 432000) WHERE age <= 3")
def cache_state(spark, d):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return I.cache_state(table(spark, d, "events"), "user_id", "event_type", "ts", now, 432_000, 3).select("user_id", "event_type", "writes", "age")


@query(f"SELECT source, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (a AND NOT p) AS fn FROM (SELECT source, regexp_matches(lower(text), '[{T.VIETNAMESE_LETTERS}]') AS p, lang = 'vi' AS a FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) GROUP BY source")
def detector_calibration(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    said = F.lower("text").rlike(f"[{T.VIETNAMESE_LETTERS}]")
    return S.calibration(docs, said, F.col("lang") == "vi", "source").select("source", "tp", "fp", "fn")


@query("WITH a AS (SELECT ref, max(judge_label) AS d FROM faith_sealed GROUP BY ref), b AS (SELECT ref, max(label) AS d FROM faith_cross GROUP BY ref) SELECT count(*) FILTER (a.d IS NOT NULL AND b.d IS NOT NULL) AS shared, count(*) FILTER (b.d IS NULL) AS only_a, count(*) FILTER (a.d IS NULL) AS only_b, count(*) FILTER (a.d <> b.d) AS differing, count(*) FILTER (a.d <> b.d) = 0 AS comparable FROM a FULL JOIN b USING (ref)")
def comparability(spark, d):
    a = table(spark, d, "faith_sealed").groupBy("ref").agg(F.max("judge_label").alias("d"))
    b = table(spark, d, "faith_cross").groupBy("ref").agg(F.max("label").alias("d"))
    return S.comparable(a, b, "ref", "d")


@query()
def weighted_interval(spark, d):
    rows = table(spark, d, "faith_sealed").select("ref", "stratum", "weight", "judge_label").distinct().where("stratum is not null")
    return S.stratified_bootstrap(rows.withColumn("v", (F.upper(F.trim("judge_label")) == "SUPPORTED").cast("double")), "stratum", "weight", "v", F.col("ref"))


@query("WITH m AS (SELECT DISTINCT conversation_id AS trace, id, user_message_id AS parent FROM message WHERE conversation_id IS NOT NULL) SELECT a.trace, a.id, (b.id IS NOT NULL)::INT AS depth FROM m a LEFT JOIN (SELECT DISTINCT trace, id FROM m) b ON a.trace = b.trace AND a.parent = b.id")
def message_depths(spark, d):
    spans = table(spark, d, "message").where("conversation_id is not null").select(F.col("conversation_id").alias("trace"), "id", F.col("user_message_id").alias("parent")).distinct()
    return I.trace_tree(spans)
