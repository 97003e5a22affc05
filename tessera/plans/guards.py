"""Scans of untrusted text, review queues and measures of grounding over whole tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import retrieve as R
from ..sources.tables import table
from .evaluation import _IN, _LAB, LABELS
from .registry import query
from .retrieval import _BRANCH, _TOKENS, branch


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SEEN = f"lower(regexp_replace(regexp_replace(translate(text, {_quoted(T.SCAN_TABLE[0])}, {_quoted(T.SCAN_TABLE[1])}), '[ \\t\\x0B\\f\\r]+', ' ', 'g'), '\\n{{2,}}', chr(10), 'g'))"
_PLAIN = f"regexp_replace(translate(seen, {_quoted(T.MARK_TABLE[0])}, {_quoted(T.MARK_TABLE[1])}), '\\p{{M}}+', '', 'g')"
_SCRIPTS = r"list_filter(regexp_extract_all(text, '\p{L}+'), lambda w: (regexp_matches(w, '\p{Latin}') AND regexp_matches(w, '[\p{Cyrillic}\p{Greek}]')) OR (regexp_matches(w, '\p{Cyrillic}') AND regexp_matches(w, '\p{Greek}')))"


@query(
    f"WITH s AS (SELECT doc_id, text, {_SEEN} AS seen FROM documents WHERE text IS NOT NULL), v AS (SELECT *, {_PLAIN} AS plain FROM s) SELECT doc_id, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(seen, {_quoted(r)}) OR regexp_matches(plain, {_quoted(r)}) THEN '{n}' END" for n, r in T.INJECTION_RULES.items())
    + f", CASE WHEN len({_SCRIPTS}) > 0 THEN 'mixed_script' END], lambda x: x IS NOT NULL) AS findings FROM v"
)
def injection_findings(spark, d):
    """The injection rules on the scan form with and without accents; `injection_scan` reads the text as it is."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", T.scan_form(F.col("text")).alias("seen"))
    docs = docs.withColumn("plain", T.without_marks(F.col("seen")))
    return docs.select("doc_id", T.injection_findings(F.col("text"), F.col("seen"), F.col("plain")).alias("findings"))


@query(f"SELECT doc_id, md5({_SEEN}) AS digest FROM documents WHERE text IS NOT NULL")
def scan_forms(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(T.scan_form(F.col("text"))).alias("digest"))


_SCRUBBED = "said"
for _shape, _instead in T.CREDENTIALS.items():
    _SCRUBBED = f"regexp_replace({_SCRUBBED}, {_quoted(_shape)}, {_quoted(_instead.replace('${1}', chr(92) + '1').replace('${2}', chr(92) + '2'))}, 'g')"
_LOGGED = "'Authorization: Bearer ' || md5(id) || '; api_key=' || id || ', sk-' || md5(id) || ' ' || content"


@query(f"SELECT id, md5({_SCRUBBED}) AS digest FROM (SELECT DISTINCT id, {_LOGGED} AS said FROM message WHERE content IS NOT NULL)")
def credential_scrubs(spark, d):
    """Messages as a log would hold them, with made-up keys, after the keys are replaced."""
    rows = table(spark, d, "message").where("content is not null").select("id", F.expr(_LOGGED).alias("said")).distinct()
    return rows.select("id", F.md5(T.without_credentials(F.col("said"))).alias("digest"))


@query(
    """WITH m AS (SELECT id, max(conversation_id) AS conversation_id, max(tenant_id) AS tenant_id, max(created_at) AS made FROM message WHERE id IS NOT NULL GROUP BY id),
    c AS (SELECT conversation_id, min(made) AS started, count(*) AS messages FROM m WHERE conversation_id IS NOT NULL GROUP BY conversation_id),
    f AS (SELECT answer_message_id AS id, min(feedback.rating) AS rating, max(feedback.reason) AS reason FROM feedback_turn WHERE feedback.rating < 0 GROUP BY answer_message_id)
    SELECT id, conversation_id, tenant_id, rating, reason, messages FROM f JOIN m USING (id) JOIN c USING (conversation_id) ORDER BY made DESC, id LIMIT 50"""
)
def review_queue(spark, d):
    """Rated answers with their message and conversation, the 50 newest."""
    m = table(spark, d, "message").where("id is not null").groupBy("id").agg(F.max("conversation_id").alias("conversation_id"), F.max("tenant_id").alias("tenant_id"), F.max("created_at").alias("at"))
    c = m.where("conversation_id is not null").groupBy("conversation_id").agg(F.min("at").alias("started"), F.count(F.lit(1)).alias("messages"))
    f = table(spark, d, "feedback_turn").where("feedback.rating < 0").groupBy(F.col("answer_message_id").alias("id")).agg(F.min("feedback.rating").alias("rating"), F.max("feedback.reason").alias("reason"))
    return f.join(m, "id").join(c, "conversation_id").orderBy(F.desc("at"), "id").limit(50).select("id", "conversation_id", "tenant_id", "rating", "reason", "messages")


_REFUSED = "(" + " OR ".join(f"contains(lower(content), {_quoted(m)})" for m in T.REFUSAL_MARKERS) + ")"


@query(
    f"""WITH t AS (SELECT answer_message_id AS id, max(model) AS model, max(n_sources) AS n FROM feedback_turn WHERE answer_message_id IS NOT NULL GROUP BY answer_message_id), m AS (SELECT id, max(content) AS content FROM message WHERE id IS NOT NULL GROUP BY id),
    r AS (SELECT model, n = 0 AS empty, {_REFUSED} AS refused FROM t LEFT JOIN m USING (id))
    SELECT model, count(*) AS answers, count(*) FILTER (empty IS NULL OR refused IS NULL) AS unjudged, round(count(*) FILTER (refused AND empty) / nullif(count(*) FILTER (empty AND refused IS NOT NULL), 0), 6) AS recall,
    round(count(*) FILTER (refused AND NOT empty) / nullif(count(*) FILTER (NOT empty AND refused IS NOT NULL), 0), 6) AS false_refusal, round(count(*) FILTER (refused = empty) / nullif(count(*) FILTER (empty IS NOT NULL AND refused IS NOT NULL), 0), 6) AS accuracy FROM r GROUP BY model"""
)
def refusal_metrics(spark, d):
    """Refusals against turns without a source, which could not be answered; answers that can't be judged count apart."""
    t = table(spark, d, "feedback_turn").where("answer_message_id is not null").groupBy(F.col("answer_message_id").alias("id")).agg(F.max("model").alias("model"), F.max("n_sources").alias("n"))
    m = table(spark, d, "message").where("id is not null").groupBy("id").agg(F.max("content").alias("content"))
    return M.refusals(t.join(m, "id", "left").select("model", (F.col("n") == 0).alias("empty"), T.looks_refused(F.col("content")).alias("refused")), "empty", "refused", "model")


@query(
    f"""WITH s AS (SELECT ref, max({_LAB.format('judge_label')}) AS l FROM faith_sealed WHERE {_LAB.format('judge_label')} IN {_IN} GROUP BY ref), u AS (SELECT DISTINCT ref, served_model, {_LAB.format('label')} AS l FROM faith_cross WHERE {_LAB.format('label')} IN {_IN}),
    h AS (SELECT ref, bool_or({_LAB.format('gold')} = 'SUPPORTED') AS backed FROM faith_human WHERE {_LAB.format('gold')} IN {_IN} GROUP BY ref),
    a AS (SELECT count(*) FILTER (l = 'SUPPORTED') AS s1, count(*) FILTER (l <> 'NO_CLAIM') AS n1 FROM s), b AS (SELECT count(*) FILTER (l = 'SUPPORTED') AS s2, count(*) FILTER (l <> 'NO_CLAIM') AS n2 FROM u),
    f AS (SELECT count(*) FILTER (backed) AS wrong, count(*) AS again FROM s JOIN h USING (ref) WHERE l IN ('NOT_FOUND', 'CONTRADICTED')),
    q AS (SELECT sum(v) / nullif(sum(n), 0) AS quotes FROM (SELECT answer_message_id, max(citations_verified) AS v, max(n_sources) AS n FROM feedback_turn WHERE n_sources > 0 GROUP BY answer_message_id))
    SELECT n1 AS claims, round(s1 / nullif(n1, 0), 6) AS faithfulness, n2 AS uncited_claims, round(s2 / nullif(n2, 0), 6) AS uncited_grounding, round((s1 + s2) / nullif(n1 + n2, 0), 6) AS derived, round(n1 / nullif(n1 + n2, 0), 6) AS cited_share,
    round(wrong / nullif(s1 + again, 0), 6) AS misattribution, round(quotes, 6) AS quote_level FROM a, b, f, q"""
)
def groundedness(spark, d):
    """Grounding of cited and uncited claims from given labels, their weighted mean, claims that another source supports,
    and the share of quotes that were verified."""
    def spelled(c):
        return F.upper(F.regexp_replace(F.trim(F.col(c)), "[ _-]+", "_"))

    s = table(spark, d, "faith_sealed").select("ref", spelled("judge_label").alias("l")).where(F.col("l").isin(*LABELS)).groupBy("ref").agg(F.max("l").alias("l"))
    u = table(spark, d, "faith_cross").select("ref", "served_model", spelled("label").alias("l")).where(F.col("l").isin(*LABELS)).distinct()
    h = table(spark, d, "faith_human").select("ref", spelled("gold").alias("g")).where(F.col("g").isin(*LABELS)).groupBy("ref").agg(F.bool_or(F.col("g") == "SUPPORTED").alias("any"))
    turns = table(spark, d, "feedback_turn").where("n_sources > 0").groupBy("answer_message_id").agg(F.max("citations_verified").alias("v"), F.max("n_sources").alias("n"))
    return M.grounding(s, u, h, turns.agg((F.sum("v") / F.nullif(F.sum("n"), F.lit(0))).alias("quotes")))


@query(
    f"""WITH k AS ({_BRANCH.format(score='dense_score')}), pk AS (SELECT query_id, CASE WHEN count(*) < 5 THEN 0 ELSE max(score) FILTER (rank = 1) / nullif(median(score) FILTER (rank BETWEEN 2 AND 10), 0) END AS peak FROM k GROUP BY query_id),
    l AS (SELECT query_id, item_id, rank, 0 AS list, 1.0 / (1 + rank) AS part FROM k UNION ALL SELECT b.query_id, item_id, rank, 1, CASE WHEN coalesce(peak, 0) >= 1.1 THEN 0.25 ELSE 1.0 END / (1 + rank) FROM ({_BRANCH.format(score='sparse_score')}) b LEFT JOIN pk USING (query_id)),
    f AS (SELECT query_id, item_id, round(sum(part), 9) AS score, min(rank) AS best, min(list) AS first FROM l GROUP BY ALL)
    SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, first, item_id)::INT AS rank FROM f QUALIFY rank <= 10"""
)
def rrf_adaptive(spark, d):
    """Fusion in which the sparse branch counts less where the dense one has a clear first."""
    dense, sparse = branch(spark, d, "dense_score"), branch(spark, d, "sparse_score")
    peak = F.max(F.when(F.col("rank") == 1, F.col("score"))) / F.nullif(F.median(F.when(F.col("rank").between(2, 10), F.col("score"))), F.lit(0.0))
    peaks = dense.groupBy("query_id").agg(F.when(F.count(F.lit(1)) < 5, 0.0).otherwise(peak).alias("peak"))
    weighted = sparse.join(peaks, "query_id", "left").withColumn("w", F.when(F.coalesce("peak", F.lit(0.0)) >= 1.1, 0.25).otherwise(1.0))
    return R.fused([dense, weighted], [1.0, F.col("w")], k=1, limit=10).select("query_id", "item_id", "rank")


@query(f"SELECT id AS item_id, bucket, round(weight, 6) AS weight, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, bucket)::INT AS place FROM ({_TOKENS.format(key='item_id', table='eval_item')}) QUALIFY place <= 5")
def sparse_heaviest(spark, d):
    """The five heaviest buckets of each item's sparse vector."""
    vectors = R.sparse_vectors(table(spark, d, "eval_item").where("text is not null"), "item_id", "text")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.round("weight", 9).desc(), "bucket"))
    return vectors.withColumn("place", place).where("place <= 5").select("item_id", "bucket", F.round("weight", 6).alias("weight"), "place")
