"""Coverage, fingerprints, stores and further reports over whole tables."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curate as K
from ..operators import incremental as I
from ..sources.tables import table
from .registry import query


@query(
    """WITH w AS (SELECT DISTINCT unnest(relevant_chunk_ids) AS chunk_id FROM golden_draft), h AS (SELECT DISTINCT chunk_id FROM retrieved_chunk WHERE chunk_id IS NOT NULL)
    SELECT split_part(w.chunk_id, '::', 1) AS doc_id, count(*) AS wanted, count(*) FILTER (h.chunk_id IS NULL) AS missing, round(count(h.chunk_id) / count(*), 6) AS coverage FROM w LEFT JOIN h USING (chunk_id) WHERE w.chunk_id IS NOT NULL GROUP BY ALL ORDER BY missing DESC, doc_id LIMIT 10"""
)
def label_coverage(spark, d):
    """Documents of which most labelled chunks were never retrieved, the worst ten."""
    return _coverage(spark, d).groupBy(F.split_part("chunk_id", F.lit("::"), F.lit(1)).alias("doc_id")).agg(
        F.count(F.lit(1)).alias("wanted"), F.count_if(F.col("there").isNull()).alias("missing"), F.round(F.count("there") / F.count(F.lit(1)), 6).alias("coverage")
    ).orderBy(F.desc("missing"), "doc_id").limit(10)


def _coverage(spark, d):
    wanted = table(spark, d, "golden_draft").select(F.explode("relevant_chunk_ids").alias("chunk_id")).where("chunk_id is not null").distinct()
    there = table(spark, d, "retrieved_chunk").where("chunk_id is not null").select("chunk_id").distinct().withColumn("there", F.lit(1))
    return wanted.join(there, "chunk_id", "left")


@query("WITH w AS (SELECT DISTINCT unnest(relevant_chunk_ids) AS chunk_id FROM golden_draft), h AS (SELECT DISTINCT chunk_id FROM retrieved_chunk WHERE chunk_id IS NOT NULL) SELECT count(*) AS wanted, round(count(h.chunk_id) / nullif(count(*), 0), 6) AS coverage, CASE WHEN count(h.chunk_id) / nullif(count(*), 0) >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS gate FROM w LEFT JOIN h USING (chunk_id) WHERE w.chunk_id IS NOT NULL")
def coverage_gate(spark, d):
    share = F.count("there") / F.nullif(F.count(F.lit(1)), F.lit(0))
    return _coverage(spark, d).agg(F.count(F.lit(1)).alias("wanted"), F.round(share, 6).alias("coverage"), F.when(share >= 0.95, "PASS").otherwise("FAIL").alias("gate"))


_CONFIG = "coalesce(embedding_model, '') || '|' || coalesce(retrieval_mode, '') || '|' || coalesce(chunk_size::VARCHAR, '') || '|' || coalesce(chunk_overlap::VARCHAR, '')"


@query(f"SELECT name, sha256({_CONFIG}) AS fingerprint FROM ablation_cell WHERE name IS NOT NULL")
def config_fingerprints(spark, d):
    return table(spark, d, "ablation_cell").where("name is not null").select("name", K.fingerprint("embedding_model", "retrieval_mode", "chunk_size", "chunk_overlap").alias("fingerprint"))


_KEYS = ("embedding_model", "retrieval_mode", "chunk_size", "chunk_overlap")


@query("WITH c AS (SELECT * FROM ablation_cell WHERE name IS NOT NULL), b AS (SELECT * FROM c ORDER BY name LIMIT 1) SELECT c.name, list_filter([" + ", ".join(f"CASE WHEN c.{k} IS DISTINCT FROM b.{k} THEN '{k}' END" for k in _KEYS) + "], lambda x: x IS NOT NULL) AS changed FROM c, b")
def fingerprint_deltas(spark, d):
    """Which settings of each cell differ from those of the first one."""
    cells = table(spark, d, "ablation_cell").where("name is not null").select("name", *_KEYS)
    first = cells.orderBy("name").limit(1).select(*[F.col(k).alias(f"b_{k}") for k in _KEYS])
    changed = F.filter(F.array(*[F.when(~F.col(k).eqNullSafe(F.col(f"b_{k}")), F.lit(k)) for k in _KEYS]), lambda x: x.isNotNull())
    return cells.join(F.broadcast(first), F.lit(True)).select("name", changed.alias("changed"))  # one row


@query("WITH c AS (SELECT name, map_keys(overall) AS ks FROM ablation_cell WHERE name IS NOT NULL), b AS (SELECT ks FROM c ORDER BY name LIMIT 1) SELECT c.name, list_sort(list_concat(list_filter(c.ks, lambda x: NOT list_contains(b.ks, x)), list_filter(b.ks, lambda x: NOT list_contains(c.ks, x)))) AS metrics FROM c, b WHERE c.ks IS NOT NULL AND b.ks IS NOT NULL")
def metric_differences(spark, d):
    """Metrics that exactly one of a cell and the first cell has."""
    cells = table(spark, d, "ablation_cell").where("name is not null").select("name", F.map_keys("overall").alias("ks"))
    first = cells.orderBy("name").limit(1).select(F.col("ks").alias("b"))
    both = cells.join(F.broadcast(first), F.lit(True)).where("ks is not null and b is not null")  # one row
    return both.select("name", F.array_sort(F.concat(F.array_except("ks", "b"), F.array_except("b", "ks"))).alias("metrics"))


@query("SELECT run_name, count(*) AS scores, round(avg((dense_score >= 0.95 OR dense_score <= 0.05)::INT), 6) AS saturated FROM (SELECT DISTINCT run_name, query_id, chunk_id, dense_score FROM retrieved_chunk WHERE NOT isnan(dense_score) AND dense_score IS NOT NULL) GROUP BY run_name")
def score_saturation(spark, d):
    rows = table(spark, d, "retrieved_chunk").where("dense_score is not null and not isnan(dense_score)").select("run_name", "query_id", "chunk_id", "dense_score").distinct()
    outside = (F.col("dense_score") >= 0.95) | (F.col("dense_score") <= 0.05)
    return rows.groupBy("run_name").agg(F.count(F.lit(1)).alias("scores"), F.round(F.avg(outside.cast("int")), 6).alias("saturated"))


@query("WITH q AS (SELECT run_name, query_id, count(DISTINCT chunk_id) AS children, count(DISTINCT doc_id) AS parents FROM retrieved_chunk WHERE run_name IS NOT NULL AND query_id IS NOT NULL GROUP BY ALL) SELECT run_name, count(*) AS queries, round(avg(1 - parents / children), 6) AS merged, round(quantile_cont(children / parents, 0.5), 6) AS growth_p50, round(quantile_cont(children / parents, 0.95), 6) AS growth_p95 FROM q WHERE children > 0 AND parents > 0 GROUP BY run_name")
def parent_merges(spark, d):
    """How far hits fall into common documents: share merged away, and children a parent."""
    rows = table(spark, d, "retrieved_chunk").where("run_name is not null and query_id is not null").groupBy("run_name", "query_id").agg(F.countDistinct("chunk_id").alias("children"), F.countDistinct("doc_id").alias("parents")).where("children > 0 and parents > 0")
    growth = F.col("children") / F.col("parents")
    return rows.groupBy("run_name").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(1 - F.col("parents") / F.col("children")), 6).alias("merged"), F.round(F.percentile(growth, 0.5), 6).alias("growth_p50"), F.round(F.percentile(growth, 0.95), 6).alias("growth_p95"))


@query("SELECT model, count(*) AS turns, count(DISTINCT md5(lower(question))) AS entries, sum(coalesce(answer_chars, 0))::BIGINT AS chars, round(avg(cache_hit::INT), 6) AS hit_rate FROM (SELECT DISTINCT answer_message_id, model, question, answer_chars, cache_hit FROM feedback_turn) GROUP BY model")
def cache_stats(spark, d):
    turns = table(spark, d, "feedback_turn").select("answer_message_id", "model", "question", "answer_chars", "cache_hit").distinct()
    return turns.groupBy("model").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct(F.md5(F.lower("question"))).alias("entries"), F.sum(F.coalesce("answer_chars", F.lit(0))).alias("chars"), F.round(F.avg(F.col("cache_hit").cast("int")), 6).alias("hit_rate"))


@query(
    f"""WITH t AS (SELECT category, lang, len(regexp_extract_all(query, '{T.WORD}')) AS n FROM golden_draft WHERE query IS NOT NULL)
    SELECT category, lang, grouping(category)::INT AS over_categories, grouping(lang)::INT AS over_langs, count(*) AS drafts, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, max(n)::INT AS longest, round(count(*) FILTER (n > 20) / count(*), 6) AS beyond FROM t GROUP BY GROUPING SETS ((), (category), (lang))"""
)
def length_breakdown(spark, d):
    rows = table(spark, d, "golden_draft").where("query is not null").select("category", "lang", F.regexp_count("query", F.lit(T.WORD)).alias("n"))
    c, lang = F.col("category"), F.col("lang")
    return rows.groupingSets([[], [c], [lang]], c, lang).agg(
        F.grouping("category").cast("int").alias("over_categories"), F.grouping("lang").cast("int").alias("over_langs"), F.count(F.lit(1)).alias("drafts"), F.round(F.percentile("n", 0.5), 6).alias("p50"),
        F.round(F.percentile("n", 0.95), 6).alias("p95"), F.max("n").alias("longest"), F.round(F.count_if(F.col("n") > 20) / F.count(F.lit(1)), 6).alias("beyond"),
    )


_STORE = "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 3"
_FRESH = "SELECT doc_id, md5(text || '!') AS digest FROM documents WHERE text IS NOT NULL AND doc_id % 10 IN (3, 5)"


@query(f"SELECT * FROM ({_STORE}) WHERE doc_id NOT IN (SELECT doc_id FROM ({_FRESH})) UNION ALL {_FRESH}")
def upserted_documents(spark, d):
    """A store of documents, made by a rule, after rows with the same or new keys are written over it."""
    docs = table(spark, d, "documents").where("text is not null")
    store = docs.where("doc_id % 10 <> 3").select("doc_id", F.md5("text").alias("digest"))
    fresh = docs.where("doc_id % 10 in (3, 5)").select("doc_id", F.md5(F.concat("text", F.lit("!"))).alias("digest"))
    return K.upserted(store, fresh, ["doc_id"])


@query("SELECT DISTINCT g.query_id, g.chunk_id, r.doc_id FROM (SELECT query_id, unnest(relevant_chunk_ids) AS chunk_id FROM golden_draft) g JOIN (SELECT chunk_id, min(doc_id) AS doc_id FROM retrieved_chunk GROUP BY chunk_id) r USING (chunk_id)")
def chunk_lookups(spark, d):
    """The stored chunk of every label that has one."""
    wanted = table(spark, d, "golden_draft").select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    stored = table(spark, d, "retrieved_chunk").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    return wanted.join(stored, "chunk_id").select("query_id", "chunk_id", "doc_id").distinct()


@query("SELECT metric, round(max(value), 6) AS value FROM (SELECT 'turns' AS metric, count(*)::DOUBLE AS value FROM feedback_turn UNION ALL SELECT 'messages', count(*) FROM message) GROUP BY metric")
def merged_counts(spark, d):
    counts = [table(spark, d, t).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("metric"), "value") for name, t in (("turns", "feedback_turn"), ("messages", "message"))]
    return I.merged_metrics(*counts, "metric").select("metric", F.round("value", 6).alias("value"))


@query("WITH a AS (SELECT id, max(content) AS content FROM message WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id), t AS (SELECT answer_message_id AS id, max(question) AS question FROM feedback_turn WHERE question IS NOT NULL GROUP BY answer_message_id) SELECT id, replace(replace('Q: {{q}} / A: {{a}}', '{{q}}', question), '{{a}}', left(content, 40)) AS prompt FROM a JOIN t USING (id)")
def rendered_prompts(spark, d):
    a = table(spark, d, "message").where("id is not null and content is not null").groupBy("id").agg(F.max("content").alias("content"))
    t = table(spark, d, "feedback_turn").where("question is not null").groupBy(F.col("answer_message_id").alias("id")).agg(F.max("question").alias("question"))
    return a.join(t, "id").select("id", T.rendered("Q: {{q}} / A: {{a}}", {"q": F.col("question"), "a": F.substring("content", 1, 40)}).alias("prompt"))


@query("SELECT doc_id, md5(regexp_replace(translate(text, " + ", ".join("'" + x + "'" for x in T.MARK_TABLE) + r"), '\p{M}+', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def unaccented_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.without_marks(F.col("text"))).alias("digest"))
