"""Answers, citations and further reports over whole tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import answers as A
from ..operators import retrieve as R
from ..operators import stats as S
from ..sources.tables import table
from .registry import query

_ONCE = "SELECT DISTINCT id, content FROM message WHERE role = 'assistant' AND content IS NOT NULL"


def _answers(spark, d):
    return table(spark, d, "message").where("role = 'assistant' and content is not null").select("id", "content").distinct()


@query(
    rf"""WITH b AS (SELECT id, instr(content, '```citations' || chr(10)) AS place, trim(regexp_replace(substr(content, instr(content, '```citations' || chr(10)) + 13), '\s*```\s*$', '')) AS body FROM ({_ONCE}))
    SELECT id, CASE WHEN place = 0 THEN 'absent' WHEN regexp_matches(body, '^\[.*\]$') AND json_valid(body) THEN 'ok' ELSE 'invalid' END AS status, CASE WHEN place > 0 AND regexp_matches(body, '^\[.*\]$') AND json_valid(body) THEN json_array_length(body) ELSE 0 END::INT AS claims FROM b"""
)
def citation_blocks(spark, d):
    rows = _answers(spark, d).select("id", A.citation_block(F.col("content")).alias("b"))
    return rows.select("id", "b.status", F.coalesce(F.size(F.coalesce("b.claims", F.array().cast("array<struct<n:int,quote:string>>"))), F.lit(0)).alias("claims"))


@query()
def answer_claims(spark, d):
    return A.claim_rows(_answers(spark, d), "id", "content")


@query(rf"SELECT m.id, n, CASE WHEN n > t.n_sources THEN 'invalid' ELSE 'known' END AS state FROM (SELECT id, unnest(list_distinct(regexp_extract_all(content, '\[(\d{{1,6}})\]', 1)))::INT AS n FROM ({_ONCE})) m JOIN (SELECT answer_message_id, max(n_sources) AS n_sources FROM feedback_turn GROUP BY ALL) t ON t.answer_message_id = m.id")
def cited_sources(spark, d):
    marks = _answers(spark, d).select("id", F.explode(T.citation_numbers(F.col("content"))).alias("n"))
    turns = table(spark, d, "feedback_turn").groupBy(F.col("answer_message_id").alias("id")).agg(F.max("n_sources").alias("n_sources"))
    return marks.join(turns, "id").select("id", "n", F.when(F.col("n") > F.col("n_sources"), "invalid").otherwise("known").alias("state"))


@query("SELECT round(sum(least(a.n, coalesce(b.n, 0))) / sum(a.n), 6) AS survival, count(*) AS lines FROM (SELECT line, count(*) AS n FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM source_docs WHERE content IS NOT NULL) WHERE trim(line) <> '' GROUP BY line) a LEFT JOIN (SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE trim(line) <> '' GROUP BY line) b USING (line)")
def line_survival(spark, d):
    def lines(name, column):
        rows = table(spark, d, name).where(F.col(column).isNotNull()).select(F.explode(F.split(column, "\n")).alias("line"))
        return rows.where(F.trim("line") != "").groupBy("line").agg(F.count(F.lit(1)).alias("n"))

    a, b = lines("source_docs", "content"), lines("documents", "text").withColumnRenamed("n", "m")
    both = a.join(b, "line", "left")
    return both.agg(F.round(F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n"), 6).alias("survival"), F.count(F.lit(1)).alias("lines"))


@query("SELECT code, count(*) AS df, count(*) BETWEEN 1 AND 3 AND length(code) >= 6 AS rare FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(content, '[A-Z0-9]+(?:[/-][A-Z0-9]+)+'))) AS code FROM (SELECT DISTINCT doc_id, content FROM source_docs WHERE content IS NOT NULL)) GROUP BY code")
def code_frequency(spark, d):
    docs = table(spark, d, "source_docs").where("content is not null").select("doc_id", "content").distinct()
    df = docs.select("doc_id", F.explode(T.codes(F.col("content"))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("rare", F.col("df").between(1, 3) & (F.length("code") >= 6))


@query("SELECT name, row_number() OVER (ORDER BY overall['ndcg@10'] DESC NULLS LAST, name)::INT AS by_ndcg, row_number() OVER (ORDER BY overall['mrr'] DESC NULLS LAST, name)::INT AS by_mrr, row_number() OVER (ORDER BY p95_ms ASC NULLS LAST, name)::INT AS by_speed FROM ablation_cell WHERE name IS NOT NULL")
def rank_table(spark, d):
    cells = table(spark, d, "ablation_cell").where("name is not null")
    at = lambda c: F.row_number().over(Window.orderBy(c, "name"))  # noqa: E731  one row a run
    o = F.col("overall")
    return cells.select("name", at(o["ndcg@10"].desc_nulls_last()).alias("by_ndcg"), at(o["mrr"].desc_nulls_last()).alias("by_mrr"), at(F.col("p95_ms").asc_nulls_last()).alias("by_speed"))


_E = "list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"SELECT q.vec_id AS query_id, arg_max(c.vec_id, (round({_E}, 6), -c.vec_id)) AS found, round(max({_E}), 6) AS score FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id")
def cache_lookup(spark, d):
    """The best entry, however far; `cache_hits` has the threshold."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("a"))
    c = e.select("vec_id", "label", F.col("embedding").alias("b"))
    pairs = c.join(R.stated(q, R.QUERY_VECTORS), "label").where("query_id <> vec_id").withColumn("s", F.round(V.dot(F.col("a"), F.col("b")), 6))
    return pairs.groupBy("query_id").agg(F.max_by("vec_id", F.struct("s", -F.col("vec_id"))).alias("found"), F.max("s").alias("score"))


_LENGTH = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_COSINE = f"{_E} / nullif({_LENGTH.format('q')} * {_LENGTH.format('c')}, 0)"


@query(f"SELECT q.vec_id AS query_id, h.found, h.score FROM embeddings q LEFT JOIN (SELECT q.vec_id AS id, arg_min(c.vec_id, (-round({_COSINE}, 6), c.vec_id)) AS found, round(max({_COSINE}), 6) AS score FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 AND {_COSINE} >= 0.96 GROUP BY q.vec_id) h ON h.id = q.vec_id WHERE q.vec_id % 100 = 0")
def cache_hits(spark, d):
    """The entry at 0.96 or more, or none. The embeddings have no texts, so every guard is empty here."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding", F.array().cast("array<string>").alias("guard"))
    return R.cached(e.where("vec_id % 100 = 0"), e)


_W = " + ".join(f"(u >= {p})::INT" for p in S.POISSON)


@query(
    f"""WITH w AS (SELECT event_type, value, draw, ('0x' || substr(md5(md5(event_id::VARCHAR) || '/' || draw), 1, 8))::BIGINT / 4294967296.0 AS u FROM events, (SELECT unnest(range(0, 50)) AS draw) WHERE event_type IN ('click', 'view') AND value IS NOT NULL),
    m AS (SELECT draw, sum({_W.replace('u >=', 'u >=')}) FILTER (event_type = 'click') AS nc, sum(({_W}) * value) FILTER (event_type = 'click') AS c, sum({_W}) FILTER (event_type = 'view') AS nv, sum(({_W}) * value) FILTER (event_type = 'view') AS v FROM w GROUP BY draw),
    o AS (SELECT c / nc - v / nv AS d, row_number() OVER (ORDER BY c / nc - v / nv) - 1 AS i FROM m)
    SELECT round(max(d) FILTER (i = 1), 6) AS low, round(max(d) FILTER (i = 48), 6) AS high FROM o"""
)
def unpaired_bootstrap(spark, d):
    """50 resamples, as SQL can check them; `unpaired_interval` draws enough."""
    e = table(spark, d, "events").where("event_type in ('click', 'view') and value is not null")
    rows = e.select("event_type", "value", F.md5(F.col("event_id").cast("string")).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("draw"))
    u = F.conv(F.substring(F.md5(F.concat("h", F.lit("/"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = rows.withColumn("w", sum(((u >= p).cast("int") for p in S.POISSON), F.lit(0)))

    def mean(kind):
        own = F.col("event_type") == kind
        return F.sum(F.when(own, F.col("w") * F.col("value"))) / F.sum(F.when(own, F.col("w")))

    means = rows.groupBy("draw").agg((mean("click") - mean("view")).alias("d")).withColumn("i", F.row_number().over(Window.orderBy("d")) - 1)  # 50 rows
    return means.agg(F.round(F.max(F.when(F.col("i") == 1, F.col("d"))), 6).alias("low"), F.round(F.max(F.when(F.col("i") == 48, F.col("d"))), 6).alias("high"))


@query()
def unpaired_interval(spark, d):
    return S.unpaired_interval(table(spark, d, "events"), "event_type", "click", "view", "value", F.col("event_id"))


@query(f"SELECT doc_id, n::BIGINT AS words, round(1 - 256 / n, 6) AS lost FROM (SELECT doc_id, len(regexp_extract_all(text, '{T.WORD}')) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 256 ORDER BY lost DESC, doc_id LIMIT 10")
def worst_truncations(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_count("text", F.lit(T.WORD)).cast("bigint").alias("words"))
    return docs.where("words > 256").withColumn("lost", F.round(1 - 256 / F.col("words"), 6)).orderBy(F.desc("lost"), "doc_id").limit(10)


@query("SELECT doc_id, source, floor(sum(n) OVER (PARTITION BY source ORDER BY n DESC, doc_id ROWS UNBOUNDED PRECEDING) / 100000)::BIGINT AS batch FROM (SELECT doc_id, source, length(text) AS n FROM documents WHERE text IS NOT NULL)")
def batch_plan(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.length("text").alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return docs.select("doc_id", "source", F.floor(F.sum("n").over(w) / 100000).alias("batch"))


@query("SELECT g.query_id FROM (SELECT DISTINCT query_id FROM golden_draft) g ANTI JOIN (SELECT DISTINCT query_id FROM retrieved_chunk) r USING (query_id)")
def resumable_queries(spark, d):
    done = table(spark, d, "retrieved_chunk").select("query_id").distinct()
    return table(spark, d, "golden_draft").select("query_id").distinct().join(done, "query_id", "left_anti")


@query("SELECT query_id, category, row_number() OVER (ORDER BY i, category, query_id)::INT AS place FROM (SELECT query_id, category, row_number() OVER (PARTITION BY category ORDER BY md5(query_id), query_id) AS i FROM (SELECT DISTINCT query_id, category FROM golden_draft WHERE category IS NOT NULL)) WHERE i <= 5")
def round_robin(spark, d):
    drafts = table(spark, d, "golden_draft").where("category is not null").select("query_id", "category").distinct()
    first = drafts.withColumn("i", F.row_number().over(Window.partitionBy("category").orderBy(F.md5("query_id"), "query_id"))).where("i <= 5")
    return first.select("query_id", "category", F.row_number().over(Window.orderBy("i", "category", "query_id")).alias("place"))  # five rows a category


@query("SELECT query_id, run_name, min(recorded_rank) FILTER (doc_id = gold)::INT AS first, count(*) FILTER (doc_id = gold) AS hits FROM (SELECT r.*, split_part(g.id, '::', 1) AS gold FROM (SELECT DISTINCT run_name, query_id, chunk_id, doc_id, recorded_rank FROM retrieved_chunk) r JOIN (SELECT query_id, min(relevant_chunk_ids[1]) AS id FROM golden_draft WHERE len(relevant_chunk_ids) > 0 GROUP BY query_id) g USING (query_id)) GROUP BY ALL HAVING count(*) FILTER (doc_id = gold) > 0")
def known_item_rank(spark, d):
    gold = table(spark, d, "golden_draft").where(F.size("relevant_chunk_ids") > 0).groupBy("query_id").agg(F.min(F.col("relevant_chunk_ids")[0]).alias("id"))
    rows = table(spark, d, "retrieved_chunk").select("run_name", "query_id", "chunk_id", "doc_id", "recorded_rank").distinct().join(gold, "query_id")
    own = F.col("doc_id") == F.split_part("id", F.lit("::"), F.lit(1))
    return rows.groupBy("query_id", "run_name").agg(F.min(F.when(own, F.col("recorded_rank"))).alias("first"), F.count_if(own).alias("hits")).where("hits > 0")


@query("SELECT model, round(sum(answer_chars / 3.0 * 0.000002), 8) AS cost, round(sum(answer_chars / 3.0 * 0.000002) / nullif(count(*), 0) * 1000, 6) AS per_1000, count(*) FILTER (answer_chars IS NULL) AS unpriced FROM (SELECT DISTINCT answer_message_id, model, answer_chars FROM feedback_turn) GROUP BY model")
def answer_costs(spark, d):
    turns = table(spark, d, "feedback_turn").select("answer_message_id", "model", "answer_chars").distinct()
    cost = F.sum(F.col("answer_chars") / 3.0 * 0.000002)
    return turns.groupBy("model").agg(F.round(cost, 8).alias("cost"), F.round(cost / F.count(F.lit(1)) * 1000, 6).alias("per_1000"), F.count_if(F.col("answer_chars").isNull()).alias("unpriced"))


@query("SELECT category, count(*) AS n, count(DISTINCT relevant_chunk_ids) AS label_sets, round(avg(len(relevant_chunk_ids)), 6) AS labels FROM golden_draft WHERE relevant_chunk_ids IS NOT NULL GROUP BY category HAVING count(*) > 1")
def label_cardinality(spark, d):
    drafts = table(spark, d, "golden_draft").where("relevant_chunk_ids is not null")
    return drafts.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("relevant_chunk_ids").alias("label_sets"), F.round(F.avg(F.size("relevant_chunk_ids")), 6).alias("labels")).where("n > 1")


@query("SELECT name, map_extract(branch_options, 'k')[1] AS k, len(map_keys(branch_options))::INT AS options FROM ablation_cell WHERE name IS NOT NULL AND branch_options IS NOT NULL")
def branch_options(spark, d):
    cells = table(spark, d, "ablation_cell").where("name is not null and branch_options is not null")
    return cells.select("name", F.col("branch_options")["k"].alias("k"), F.size(F.map_keys("branch_options")).alias("options"))
