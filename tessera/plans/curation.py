"""Deduplication, spans, snapshots and gates over whole tables."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as C
from ..operators import curate as K
from ..operators import passages as P
from ..sources.tables import table
from .registry import query

_FORM = r"trim(regexp_replace(regexp_replace(lower(query), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT query_id, category FROM (SELECT query_id, category, row_number() OVER (PARTITION BY category, {_FORM} ORDER BY len(coalesce(relevant_chunk_ids, [])) DESC, length(query) DESC, query_id) AS n FROM golden_draft WHERE query IS NOT NULL AND trim(query) <> '') WHERE n = 1")
def dedupe_exact(spark, d):
    drafts = table(spark, d, "golden_draft").where("query is not null and trim(query) <> ''").withColumn("form", T.dedupe_form(F.col("query")))
    labels = F.size(F.coalesce("relevant_chunk_ids", F.array().cast("array<string>")))
    return K.newest(drafts, ["category", "form"], labels.desc(), F.length("query").desc(), F.col("query_id")).select("query_id", "category")


def _token_sets(spark, d):
    drafts = table(spark, d, "golden_draft").where("query is not null and category is not null")
    return drafts.select(F.col("query_id").alias("id"), F.col("category").alias("scope"), T.token_set(F.col("query")).alias("tokens"))


@query(
    f"""WITH s AS (SELECT min(query_id) AS id, category AS scope, tokens FROM (SELECT query_id, category, list_sort(list_distinct(regexp_extract_all(lower(query), '{T.WORD}'))) AS tokens FROM golden_draft WHERE query IS NOT NULL AND category IS NOT NULL) WHERE len(tokens) > 0 GROUP BY scope, tokens)
    SELECT id_a, id_b, round(x / u, 6) AS similarity FROM (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.tokens, b.tokens)) AS x, len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens)) AS u FROM s a JOIN s b ON a.scope = b.scope AND a.id < b.id) WHERE x / u >= 0.8 - 1e-12"""
)
def dedupe_jaccard(spark, d):
    """Pairs of representatives; `dedupe_members` has every draft with its class."""
    return K.jaccard_pairs(_token_sets(spark, d), 0.8).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH r AS (SELECT DISTINCT query_id, category, tokens, CASE WHEN len(tokens) > 0 THEN md5(array_to_string(tokens, ' ')) ELSE query_id END AS class_id FROM (SELECT query_id, category, list_sort(list_distinct(regexp_extract_all(lower(query), '{T.WORD}'))) AS tokens FROM golden_draft WHERE query IS NOT NULL AND category IS NOT NULL)),
    l AS (SELECT a.query_id, a.category, a.class_id, count(*) AS links FROM r a JOIN r b ON a.category = b.category AND (a.query_id <> b.query_id OR a.class_id <> b.class_id) WHERE len(list_intersect(a.tokens, b.tokens)) >= (0.8 - 1e-12) * (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) AND len(a.tokens) > 0 AND len(b.tokens) > 0 GROUP BY ALL)
    SELECT query_id, category, class_id, min(query_id) OVER (PARTITION BY category, class_id) AS representative, count(*) OVER (PARTITION BY category, class_id) AS members, coalesce(links, 0) AS links FROM r LEFT JOIN l USING (query_id, category, class_id)"""
)
def dedupe_members(spark, d):
    """Every draft with its class of equal token sets and the number of drafts of its category at 0.8 or more."""
    found = K.jaccard_members(_token_sets(spark, d), 0.8)
    return found.select(F.col("id").alias("query_id"), F.col("scope").alias("category"), "class_id", "representative", "members", "links")


@query()
def dedupe_greedy(spark, d):
    """Every draft with the one that stands for it, richer drafts first: more labels, then longer questions."""
    drafts = table(spark, d, "golden_draft").where("query is not null and category is not null")
    rows = drafts.select(
        F.col("query_id").alias("id"), F.col("category").alias("scope"), T.token_set(F.col("query")).alias("tokens"),
        F.size(F.coalesce("relevant_chunk_ids", F.array().cast("array<string>"))).alias("labels"), F.length("query").alias("chars"),
    )
    return K.greedy_members(rows, 0.8, "labels", "chars").select(F.col("id").alias("query_id"), F.col("scope").alias("category"), "kept_by")


_SPANS = """SELECT item_id, doc_id, s - 1 AS s, s - 1 + n AS e FROM (SELECT i.item_id, d.doc_id, length(i.text) AS n, unnest(list_filter(range(1, length(d.text) - length(i.text) + 2), lambda x: substr(d.text, x::INT, length(i.text)) = i.text)) AS s
    FROM eval_item i JOIN documents d ON contains(d.text, i.text) WHERE i.text <> '')"""


@query(
    f"""WITH c AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk_index, start, least(start + 400, n) AS stop FROM (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 350)) AS start FROM documents WHERE length(text) > 0))
    SELECT s.item_id, s.doc_id, c.chunk_index, (least(e, stop) - greatest(s, start))::INT AS shared FROM ({_SPANS}) s JOIN c USING (doc_id) WHERE s < stop AND start < e AND (least(e, stop) - greatest(s, start) >= 0.5 * (e - s) OR least(e, stop) - greatest(s, start) >= 0.5 * (stop - start))"""
)
def span_overlaps(spark, d):
    """Slices of documents that hold half of a passage, or half of which it fills, for every place of the passage."""
    docs = table(spark, d, "documents").where("length(text) > 0")
    spans = P.occurrences(docs, "doc_id", "text", table(spark, d, "eval_item"), "item_id", "text")
    slices = C.hard_slices(docs, "doc_id", "text", 400, 350).select("doc_id", "chunk_index", "start", (F.col("start") + F.length("content")).alias("stop"))
    return K.overlaps(spans, slices).select("item_id", "doc_id", "chunk_index", "shared")


@query("SELECT g.query_id, s.doc_id, (instr(s.content, g.quote) - 1)::INT AS start, instr(s.content, g.quote) > 0 AS found FROM (SELECT DISTINCT query_id, quote, split_part(relevant_chunk_ids[1], '::', 1) AS doc_id FROM golden_draft WHERE quote IS NOT NULL AND len(relevant_chunk_ids) > 0) g JOIN (SELECT doc_id, any_value(content) AS content FROM source_docs WHERE content IS NOT NULL GROUP BY doc_id) s USING (doc_id)")
def quote_anchors(spark, d):
    drafts = table(spark, d, "golden_draft").where(F.col("quote").isNotNull() & (F.size("relevant_chunk_ids") > 0))
    quotes = drafts.select("query_id", "quote", F.split_part(F.col("relevant_chunk_ids")[0], F.lit("::"), F.lit(1)).alias("doc_id")).distinct()
    docs = table(spark, d, "source_docs").where("content is not null").select("doc_id", "content").dropDuplicates(["doc_id"])
    at = F.expr("position(quote in content)")
    return quotes.join(docs, "doc_id").select("query_id", "doc_id", (at - 1).alias("start"), (at > 0).alias("found"))


@query("SELECT doc_id, content_hash, metadata.ingested_at AS at FROM source_docs WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY metadata.ingested_at DESC NULLS LAST, content_hash) = 1")
def newest_documents(spark, d):
    docs = table(spark, d, "source_docs").where("doc_id is not null").select("doc_id", "content_hash", F.col("metadata.ingested_at").alias("at"))
    return K.newest(docs, ["doc_id"], F.col("at").desc_nulls_last(), F.col("content_hash"))


_SNAP = "SELECT doc_id, max(content_hash) AS h FROM source_docs WHERE doc_id IS NOT NULL AND {} GROUP BY doc_id"


@query(
    f"""SELECT doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS change
    FROM ({_SNAP.format("substr(md5(doc_id), 1, 1) <> 'f'")}) o FULL JOIN ({_SNAP.format("substr(md5(doc_id), 1, 1) <> '0'")}) n USING (doc_id)"""
)
def snapshot_changes(spark, d):
    docs = table(spark, d, "source_docs").where("doc_id is not null")
    first = F.substring(F.md5("doc_id"), 1, 1)
    old, new = (docs.where(first != x).groupBy("doc_id").agg(F.max("content_hash").alias("h")) for x in "f0")
    return K.snapshot_changes(old, new, "doc_id", "h")


@query(
    """WITH c AS (SELECT DISTINCT doc_id, split_part(chunk_id, '::', 2)::INT AS i FROM retrieved_chunk WHERE chunk_id IS NOT NULL), n AS (SELECT doc_id, max(i) + 1 AS old_n, (max(i) + 1) // 2 AS new_n FROM c GROUP BY doc_id)
    SELECT doc_id, printf('%s::%05d', doc_id, unnest(range(new_n, old_n))) AS chunk_id FROM n WHERE old_n > new_n"""
)
def stale_chunks(spark, d):
    chunks = table(spark, d, "retrieved_chunk").where("chunk_id is not null").select("doc_id", F.split_part("chunk_id", F.lit("::"), F.lit(2)).cast("int").alias("i"))
    counts = chunks.groupBy("doc_id").agg((F.max("i") + 1).alias("old_n")).withColumn("new_n", F.floor(F.col("old_n") / 2).cast("int"))
    return K.stale(counts)


@query(
    """WITH a AS (SELECT doc_id, md5(content) AS digest FROM source_docs WHERE content IS NOT NULL), o AS (SELECT digest, min(doc_id) AS first FROM a GROUP BY digest)
    SELECT doc_id, digest, first FROM (SELECT DISTINCT doc_id, digest FROM a) JOIN o USING (digest) WHERE doc_id <> first"""
)
def mirrored_documents(spark, d):
    docs = table(spark, d, "source_docs").where("content is not null").select("doc_id", F.md5("content").alias("digest")).distinct()
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "digest").where("doc_id <> first").select("doc_id", "digest", "first")


@query("SELECT count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS only_turns, count(*) FILTER (b AND NOT a) AS only_messages FROM (SELECT coalesce(t.id, m.id) AS id, t.id IS NOT NULL AS a, m.id IS NOT NULL AS b FROM (SELECT DISTINCT answer_message_id AS id FROM feedback_turn) t FULL JOIN (SELECT DISTINCT id FROM message WHERE role = 'assistant') m ON t.id = m.id)")
def reconciled_keys(spark, d):
    turns = table(spark, d, "feedback_turn").select(F.col("answer_message_id").alias("id")).distinct().withColumn("a", F.lit(True))
    answers = table(spark, d, "message").where("role = 'assistant'").select("id").distinct().withColumn("b", F.lit(True))
    both = turns.join(answers, "id", "full")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.agg(F.count_if(a & b).alias("shared"), F.count_if(a & ~b).alias("only_turns"), F.count_if(b & ~a).alias("only_messages"))


@query("SELECT DISTINCT f.answer_message_id AS id, m.conversation_id, m.tenant_id, f.feedback.rating AS rating FROM feedback_turn f JOIN message m ON m.id = f.answer_message_id WHERE f.feedback.rating < 0")
def negative_feedback(spark, d):
    turns = table(spark, d, "feedback_turn").where("feedback.rating < 0").select("answer_message_id", F.col("feedback.rating").alias("rating"))
    return turns.join(table(spark, d, "message"), turns.answer_message_id == F.col("id")).select("id", "conversation_id", "tenant_id", "rating").distinct()


@query("SELECT category, lang, n::INT AS n FROM (SELECT category, lang, query_id, row_number() OVER (PARTITION BY category ORDER BY md5(query_id), query_id) AS n FROM (SELECT DISTINCT query_id, category, lang FROM golden_draft WHERE category IS NOT NULL)) WHERE n <= 20")
def category_quota(spark, d):
    from pyspark.sql import Window

    drafts = table(spark, d, "golden_draft").where("category is not null").select("query_id", "category", "lang").distinct()
    return drafts.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy(F.md5("query_id"), "query_id"))).where("n <= 20").select("category", "lang", "n")


@query("SELECT query_id, list_filter([CASE WHEN len(coalesce(relevant_chunk_ids, [])) = 0 THEN 'no_labels' END, CASE WHEN quote IS NULL THEN 'no_quote' END, CASE WHEN reference_answer IS NULL THEN 'no_answer' END, CASE WHEN NOT coalesce(reviewed_by_human, false) THEN 'unreviewed' END], lambda x: x IS NOT NULL) AS flags FROM golden_draft")
def triage_flags(spark, d):
    drafts = table(spark, d, "golden_draft")
    no_labels = F.size(F.coalesce("relevant_chunk_ids", F.array().cast("array<string>"))) == 0
    checks = {"no_labels": no_labels, "no_quote": F.col("quote").isNull(), "no_answer": F.col("reference_answer").isNull(), "unreviewed": ~F.coalesce("reviewed_by_human", F.lit(False))}
    flags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return drafts.select("query_id", flags.alias("flags"))


_CELLS = "SELECT name, overall['ndcg@10'] AS ndcg, overall['mrr'] AS mrr, p95_ms FROM ablation_cell WHERE name IS NOT NULL"


@query(f"SELECT name, CASE WHEN ndcg IS NULL OR p95_ms IS NULL THEN 'INCOMPARABLE' WHEN ndcg < 0.3 OR p95_ms > 900 OR ndcg < best - 0.2 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM ({_CELLS}) c, (SELECT max(overall['ndcg@10']) AS best FROM ablation_cell)")
def gate_verdicts(spark, d):
    from ..operators.gate import verdicts

    cells = table(spark, d, "ablation_cell").where("name is not null").select("name", F.col("overall")["ndcg@10"].alias("ndcg"), "p95_ms")
    return verdicts(cells, "name", {"ndcg": (0.3, None), "p95_ms": (None, 900.0)}, {"ndcg": 0.2})


@query("SELECT e.name AS encoder, m.mode, s.size FROM (SELECT DISTINCT embedding_model AS name FROM ablation_cell WHERE embedding_model IS NOT NULL) e CROSS JOIN (SELECT DISTINCT retrieval_mode AS mode FROM ablation_cell WHERE retrieval_mode IS NOT NULL) m CROSS JOIN (SELECT DISTINCT chunk_size AS size FROM ablation_cell WHERE chunk_size IS NOT NULL) s")
def option_grid(spark, d):
    cells = table(spark, d, "ablation_cell")
    options = cells.agg(F.collect_set("embedding_model").alias("e"), F.collect_set("retrieval_mode").alias("m"), F.collect_set("chunk_size").alias("s"))
    return options.select(F.explode("e").alias("encoder"), "m", "s").select("encoder", F.explode("m").alias("mode"), "s").select("encoder", "mode", F.explode("s").alias("size"))
