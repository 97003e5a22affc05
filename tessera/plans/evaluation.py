"""Ranking metrics, agreement and comparison of runs, over whole tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import stats as S
from ..session import written
from ..sources.tables import table
from .registry import query
from .retrieval import branch

LABELS = ["SUPPORTED", "NOT_FOUND", "NO_CLAIM", "CONTRADICTED"]
_LAB = "upper(regexp_replace(trim({}), '[ _-]+', '_', 'g'))"
_IN = "('SUPPORTED','NOT_FOUND','NO_CLAIM','CONTRADICTED')"

_HITS = "SELECT run_name, query_id, chunk_id AS item_id, row_number() OVER (PARTITION BY run_name, query_id ORDER BY recorded_rank NULLS LAST, chunk_id) AS rank FROM (SELECT run_name, query_id, chunk_id, min(recorded_rank) AS recorded_rank FROM retrieved_chunk WHERE run_name IS NOT NULL GROUP BY ALL)"
_GOLD = "SELECT r.run_name, g.query_id, any_value(g.category) AS category, any_value(list_distinct(coalesce(g.relevant_chunk_ids, []))) AS relevant FROM golden_draft g JOIN (SELECT DISTINCT run_name, query_id FROM retrieved_chunk WHERE run_name IS NOT NULL) r USING (query_id) GROUP BY ALL"
_METRICS = f"""WITH gold AS ({_GOLD}), j AS (SELECT g.run_name, g.query_id, g.category, len(g.relevant) AS n, h.item_id, h.rank, coalesce(list_contains(g.relevant, h.item_id)::INT, 0) AS rel FROM gold g LEFT JOIN ({_HITS}) h ON g.run_name = h.run_name AND g.query_id = h.query_id),
    s AS (SELECT *, sum(rel) OVER (PARTITION BY run_name, query_id ORDER BY rank) AS seen FROM j),
    a AS (SELECT run_name, query_id, any_value(category) AS category, any_value(n)::INT AS n_relevant, count(item_id) AS n_returned, sum(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS h1, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS h5, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS h10, sum(CASE WHEN rank <= 20 THEN rel ELSE 0 END) AS h20,
    max(CASE WHEN rel = 1 THEN 1.0 / rank ELSE 0 END) AS rr, sum(CASE WHEN rel = 1 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rel = 1 AND rank <= 20 THEN seen / rank ELSE 0 END) AS ap FROM s GROUP BY run_name, query_id),
    m AS (SELECT run_name, query_id, category, n_relevant, n_returned, """ + ", ".join(
    f"CASE WHEN n_relevant > 0 THEN h{k} / n_relevant END AS recall_{k}, CASE WHEN n_relevant > 0 THEN h{k} / {k} END AS precision_{k}, CASE WHEN n_relevant > 0 THEN (h{k} > 0)::INT::DOUBLE END AS hit_{k}" for k in (1, 5, 10, 20)
) + """, CASE WHEN n_relevant > 0 THEN rr END AS mrr, CASE WHEN n_relevant > 0 THEN dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda r: 1 / log2(r + 1))) END AS ndcg_10, CASE WHEN n_relevant > 0 THEN ap / least(n_relevant, 20) END AS map_20 FROM a)"""
NAMES = [f"{m}_{k}" for k in (1, 5, 10, 20) for m in ("recall", "precision", "hit")] + ["mrr", "ndcg_10", "map_20"]


def _scored(spark, d):
    chunks = table(spark, d, "retrieved_chunk").where("run_name is not null")
    once = chunks.groupBy("run_name", "query_id", "chunk_id").agg(F.min("recorded_rank").alias("r"))
    hits = once.withColumn("rank", F.row_number().over(Window.partitionBy("run_name", "query_id").orderBy(F.col("r").asc_nulls_last(), "chunk_id")))
    drafts = table(spark, d, "golden_draft").groupBy("query_id").agg(F.max("category").alias("category"), F.max(F.coalesce("relevant_chunk_ids", F.array().cast("array<string>"))).alias("relevant"))
    gold = drafts.join(chunks.select("run_name", "query_id").distinct(), "query_id")
    scored = M.query_metrics(hits.select("run_name", "query_id", F.col("chunk_id").alias("item_id"), "rank"), gold.select("run_name", "query_id", "relevant"), ["run_name", "query_id"])
    return scored.join(drafts.select("query_id", "category"), "query_id")


@query(_METRICS + " SELECT run_name, query_id, n_relevant, n_returned, " + ", ".join(f"round({m}, 6) AS {m}" for m in NAMES) + " FROM m")
def query_metrics(spark, d):
    return _scored(spark, d).select("run_name", "query_id", "n_relevant", "n_returned", *[F.round(m, 6).alias(m) for m in NAMES])


@query(_METRICS + " SELECT run_name, category, count(*) AS queries, sum((n_relevant = 0)::INT)::BIGINT AS unlabelled, round(avg(recall_10), 6) AS recall_10, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(mrr), 6) AS mrr, round(avg(map_20), 6) AS map_20 FROM m GROUP BY GROUPING SETS ((), (run_name), (run_name, category))")
def run_evaluation(spark, d):
    return M.summary(_scored(spark, d), ["recall_10", "ndcg_10", "mrr", "map_20"], [[], ["run_name"], ["run_name", "category"]])


@query(_METRICS + " SELECT run_name, query_id, metric, round(value, 6) AS value FROM (UNPIVOT m ON recall_10, ndcg_10, mrr INTO NAME metric VALUE value)")
def metrics_long(spark, d):
    return M.long(_scored(spark, d), ["run_name", "query_id"], ["recall_10", "ndcg_10", "mrr"]).withColumn("value", F.round("value", 6))


@query(_METRICS + " SELECT category, " + ", ".join(f"round(avg(hit_{k}), 6) AS hit_{k}" for k in (1, 5, 10, 20)) + " FROM m WHERE n_relevant > 0 GROUP BY GROUPING SETS ((), (category))")
def candidate_ceiling(spark, d):
    rows = _scored(spark, d).where("n_relevant > 0")
    return rows.groupingSets([[], [F.col("category")]], F.col("category")).agg(*[F.round(F.avg(f"hit_{k}"), 6).alias(f"hit_{k}") for k in (1, 5, 10, 20)])


@query(f"SELECT g.run_name, g.query_id, count(*) AS missing FROM (SELECT run_name, query_id, unnest(relevant) AS item_id FROM ({_GOLD})) g ANTI JOIN (SELECT DISTINCT chunk_id AS item_id FROM retrieved_chunk) c USING (item_id) GROUP BY ALL")
def missing_labels(spark, d):
    chunks = table(spark, d, "retrieved_chunk")
    runs = chunks.where("run_name is not null").select("run_name", "query_id").distinct()
    drafts = table(spark, d, "golden_draft").groupBy("query_id").agg(F.max("relevant_chunk_ids").alias("ids"))
    gold = drafts.join(runs, "query_id").select("run_name", "query_id", F.explode(F.array_distinct("ids")).alias("item_id"))
    known = chunks.select(F.col("chunk_id").alias("item_id")).distinct()
    return gold.join(known, "item_id", "left_anti").groupBy("run_name", "query_id").agg(F.count(F.lit(1)).alias("missing"))


@query("SELECT model, count(*) AS n, round(avg(total_ms), 6) AS mean, list_sort(list(total_ms))[(count(*) // 2) + 1] AS p50, list_sort(list(total_ms))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS p95, max(total_ms) AS max, round(stddev_samp(total_ms), 5) AS deviation FROM feedback_turn WHERE total_ms IS NOT NULL GROUP BY model")
def latency_summary(spark, d):
    return M.latency(table(spark, d, "feedback_turn"), "total_ms", "model")


@query("SELECT source, count(*) AS n, min(length(text))::INT AS shortest, max(length(text))::INT AS longest, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 6) AS median FROM documents WHERE text IS NOT NULL GROUP BY source")
def length_stats(spark, d):
    docs = table(spark, d, "documents").where("text is not null").withColumn("l", F.length("text"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("l").alias("shortest"), F.max("l").alias("longest"), F.round(F.avg("l"), 6).alias("mean"), F.round(F.percentile("l", 0.5), 6).alias("median"))


@query(
    f"""WITH t AS (SELECT source, lang, text, len(regexp_extract_all(text, '{T.WORD}')) AS n FROM documents WHERE text IS NOT NULL)
    SELECT source, lang, count(*) AS n, count(*) FILTER (n > 256) AS truncated, sum(n)::BIGINT AS tokens, sum(least(n, 256))::BIGINT AS kept, round(1 - sum(least(n, 256)) / nullif(sum(n), 0), 6) AS lost FROM t GROUP BY GROUPING SETS ((), (source), (lang))"""
)
def truncation_stats(spark, d):
    docs = table(spark, d, "documents").where("text is not null").withColumn("n", F.regexp_count("text", F.lit(T.WORD)))
    sets = docs.groupingSets([[], [F.col("source")], [F.col("lang")]], F.col("source"), F.col("lang"))
    kept = F.sum(F.least("n", F.lit(256)))
    return sets.agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("n") > 256).alias("truncated"), F.sum("n").alias("tokens"), kept.alias("kept"), F.round(1 - kept / F.nullif(F.sum("n"), F.lit(0)), 6).alias("lost")).withColumnRenamed("c", "n")


_AT = "list_sort(list({0}))[round_even({1} * (count({0}) - 1), 0)::INT + 1]"


@query(
    f"""WITH t AS (SELECT lang, length(text) AS chars, len(regexp_extract_all(text, '{T.WORD}')) AS n FROM documents WHERE text IS NOT NULL),
    s AS (SELECT grouping(lang) = 1 AS overall, lang, count(*) AS texts, count(*) FILTER (n > 256) AS truncated, sum(n)::BIGINT AS tokens, sum(least(n, 256))::BIGINT AS kept, round(1 - sum(least(n, 256)) / nullif(sum(n), 0), 6) AS lost,
    {_AT.format('n', 0.5)}::INT AS p50, {_AT.format('n', 0.95)}::INT AS p95, max(n)::INT AS longest, list_sort(list(round(chars / n, 4)) FILTER (n > 0))[round_even(0.05 * (count(*) FILTER (n > 0) - 1), 0)::INT + 1] AS d FROM t GROUP BY GROUPING SETS ((), (lang))),
    b AS (SELECT *, floor(254 * coalesce(d, 0))::BIGINT AS budget FROM s), g AS (SELECT *, greatest(0, budget - 200)::BIGINT AS suggested FROM b)
    SELECT overall, lang, texts, truncated, tokens, kept, lost, p50, p95, longest, budget, suggested, round(d, 6) AS density_p05, min(suggested) FILTER (NOT overall) OVER () AS safe FROM g"""
)
def truncation_report(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return M.token_report(docs.select("lang", F.regexp_count("text", F.lit(T.WORD)).alias("n"), F.length("text").alias("chars")), 256)


@query("SELECT category, lang, reviewed, count(*) AS n FROM (SELECT category, lang, reviewed_by_human::VARCHAR AS reviewed FROM golden_draft) GROUP BY GROUPING SETS ((category), (lang), (category, reviewed))")
def draft_summary(spark, d):
    drafts = table(spark, d, "golden_draft").select("category", "lang", F.col("reviewed_by_human").cast("string").alias("reviewed"))
    c, lang, r = F.col("category"), F.col("lang"), F.col("reviewed")
    return drafts.groupingSets([[c], [lang], [c, r]], c, lang, r).agg(F.count(F.lit(1)).alias("n"))


_PAIRS = f"""SELECT a, b, weight, stratum FROM (SELECT s.ref, {_LAB.format('s.judge_label')} AS a, {_LAB.format('c.label')} AS b, s.weight, s.stratum FROM (SELECT DISTINCT ref, judge_label, weight, stratum FROM faith_sealed) s
    JOIN (SELECT ref, max(label) AS label FROM faith_cross WHERE {_LAB.format('label')} IN {_IN} GROUP BY ref) c USING (ref)) WHERE a IN {_IN} AND b IN {_IN}"""


def _pairs(spark, d):
    def spelled(c):
        return F.upper(F.regexp_replace(F.trim(F.col(c)), "[ _-]+", "_"))

    sealed = table(spark, d, "faith_sealed").select("ref", spelled("judge_label").alias("a"), "weight", "stratum", "judge_label").distinct()
    cross = table(spark, d, "faith_cross").where(spelled("label").isin(*LABELS)).groupBy("ref").agg(F.max("label").alias("label"))
    return sealed.join(cross, "ref").select("a", spelled("label").alias("b"), "weight", "stratum").where(F.col("a").isin(*LABELS) & F.col("b").isin(*LABELS))


_GRID = f"SELECT x.l AS a, y.l AS b, coalesce(sum(p.weight), 0) AS weight FROM (SELECT unnest({LABELS}) AS l) x CROSS JOIN (SELECT unnest({LABELS}) AS l) y LEFT JOIN ({_PAIRS}) p ON p.a = x.l AND p.b = y.l GROUP BY ALL"


@query(f"SELECT a, b, round(weight, 4) AS weight FROM ({_GRID})")
def confusion_matrix(spark, d):
    return S.confusion(_pairs(spark, d), LABELS, "a", "b", "weight").withColumn("weight", F.round("weight", 4))


@query(
    f"""WITH g AS ({_GRID}), t AS (SELECT sum(weight) AS t FROM g), r AS (SELECT a AS l, sum(weight) AS r FROM g GROUP BY a), c AS (SELECT b AS l, sum(weight) AS c FROM g GROUP BY b),
    k AS (SELECT (SELECT sum(weight) FROM g WHERE a = b) / t AS o, (SELECT sum(r * c) FROM r JOIN c USING (l)) / (t * t) AS e FROM t)
    SELECT round(o, 6) AS observed, round(e, 6) AS expected, round(CASE WHEN 1 - e >= 1e-12 THEN (o - e) / (1 - e) END, 6) AS kappa, round(2 * o - 1, 6) AS pabak FROM k"""
)
def judge_agreement(spark, d):
    return S.agreement(S.confusion(_pairs(spark, d), LABELS, "a", "b", "weight"))


@query(
    f"""WITH g AS ({_GRID}), r AS (SELECT a AS label, sum(weight) AS r, sum(CASE WHEN a = b THEN weight ELSE 0 END) AS hit FROM g GROUP BY a), c AS (SELECT b AS label, sum(weight) AS c FROM g GROUP BY b),
    s AS (SELECT label, hit / nullif(c, 0) AS p, hit / nullif(r, 0) AS q FROM r JOIN c USING (label))
    SELECT label, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p = 0 OR q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM s"""
)
def label_scores(spark, d):
    return S.label_scores(S.confusion(_pairs(spark, d), LABELS, "a", "b", "weight"))


_BRANCH = "SELECT run_name || '/' || query_id AS query_id, chunk_id AS item_id, row_number() OVER (PARTITION BY run_name, query_id ORDER BY {score} DESC, chunk_id) AS rank, run_name || '/' || query_id AS k, query_id AS q FROM (SELECT DISTINCT run_name, query_id, chunk_id, dense_score, sparse_score FROM retrieved_chunk WHERE run_name IS NOT NULL AND query_id IS NOT NULL) WHERE {score} IS NOT NULL AND NOT isnan({score})"
_SIDE = "SELECT h.k AS query_id, max(CASE WHEN list_contains(g.relevant, h.item_id) THEN 1.0 / h.rank ELSE 0 END) AS mrr, max(CASE WHEN list_contains(g.relevant, h.item_id) AND h.rank <= 10 THEN 1.0 ELSE 0 END) AS hit_10 FROM ({branch}) h JOIN (SELECT query_id, max(relevant_chunk_ids) AS relevant FROM golden_draft WHERE len(relevant_chunk_ids) > 0 GROUP BY query_id) g ON g.query_id = h.q GROUP BY ALL"
_BOTH = f"""WITH a AS ({_SIDE.format(branch=_BRANCH.format(score='dense_score'))}), b AS ({_SIDE.format(branch=_BRANCH.format(score='sparse_score'))}),
    p AS (SELECT query_id, 'mrr' AS metric, a.mrr AS a, b.mrr AS b, b.mrr - a.mrr AS diff FROM a JOIN b USING (query_id) UNION ALL SELECT query_id, 'hit_10', a.hit_10, b.hit_10, b.hit_10 - a.hit_10 FROM a JOIN b USING (query_id)),
    s AS (SELECT metric, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(diff) AS d, count(*) FILTER (diff > 1e-9) AS better, count(*) FILTER (diff < -1e-9) AS worse, min(abs(diff)) FILTER (abs(diff) > 1e-9) AS least FROM p GROUP BY metric),
    c AS (SELECT metric, n, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(d, 6) AS diff, better, worse, round(CASE WHEN better + worse = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(greatest(better, worse), better + worse + 1),
    lambda x: exp(lgamma(better + worse + 1) - lgamma(x + 1) - lgamma(better + worse - x + 1) - (better + worse) * ln(2))))) END, 6) AS p, round(least(1, 2 / pow(2, better + worse)), 6) AS least_p, round(least / n, 9) AS step FROM s)"""


def _sides(spark, d):
    gold = table(spark, d, "golden_draft").where(F.size("relevant_chunk_ids") > 0).groupBy("query_id").agg(F.max("relevant_chunk_ids").alias("relevant")).withColumnRenamed("query_id", "q")
    out = []
    for score in ("dense_score", "sparse_score"):
        hits = branch(spark, d, score).withColumn("q", F.element_at(F.split("query_id", "/"), -1)).join(gold, "q")
        rel = F.array_contains("relevant", F.col("item_id"))
        sums = hits.groupBy("query_id").agg(F.max(F.when(rel, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"), F.max(F.when(rel & (F.col("rank") <= 10), 1.0).otherwise(0.0)).alias("hit_10"))
        out.append(M.long(sums, ["query_id"], ["mrr", "hit_10"]))
    return S.paired(*out, ["query_id"])


@query(_BOTH + " SELECT * FROM c")
def branch_comparison(spark, d):
    return S.compared(_sides(spark, d))


_DRAWS = _BOTH + """, w AS (SELECT metric, diff, r.draw, ('0x' || substr(md5(md5(query_id) || '/' || r.draw), 1, 8))::BIGINT / 4294967296.0 AS u FROM p CROSS JOIN (SELECT unnest(range(0, 200)) AS draw) r),
    m AS (SELECT metric, draw, sum(k * diff) / nullif(sum(k), 0) AS m FROM (SELECT *, """ + " + ".join(f"(u >= {p})::INT" for p in S.POISSON) + """ AS k FROM w) GROUP BY ALL),
    o AS (SELECT metric, m, row_number() OVER (PARTITION BY metric ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM m WHERE m IS NOT NULL),
    t AS (SELECT metric, round(max(m) FILTER (i = floor(n * 0.025)), 6) AS low, round(max(m) FILTER (i = least(n - 1, floor(n * 0.975))), 6) AS high FROM o GROUP BY metric)"""


@query(_DRAWS + " SELECT * FROM t")
def branch_bootstrap(spark, d):
    """200 resamples, as SQL can check them; `branch_intervals` draws enough."""
    return S.bootstrap(_sides(spark, d), F.col("query_id"))


@query(
    _DRAWS + """ SELECT metric, diff, low, high, p, CASE WHEN better = 0 AND worse = 0 THEN 'identical' WHEN least_p > 0.05 THEN 'underpowered' WHEN (low > 0 OR high < 0) AND p <= 0.05 AND sign(diff) = sign(better - worse) THEN 'real difference'
    WHEN (low > 0 OR high < 0) AND p <= 0.05 THEN 'contradictory' WHEN NOT (low > 0 OR high < 0) AND p > 0.05 THEN 'within noise' ELSE 'inconclusive' END AS verdict FROM c JOIN t USING (metric)"""
)
def branch_verdict(spark, d):
    """By the 200 resamples of `branch_bootstrap`; `branch_decisions` draws enough."""
    pairs = written(_sides(spark, d))
    return S.verdict(S.compared(pairs), S.bootstrap(pairs, F.col("query_id")))


@query()
def branch_intervals(spark, d):
    return S.intervals(_sides(spark, d), F.col("query_id"))


@query()
def branch_decisions(spark, d):
    pairs = written(_sides(spark, d))
    return S.verdict(S.compared(pairs), S.intervals(pairs, F.col("query_id")))


@query("SELECT ref, stratum, round(n / least(n, 20), 6) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY md5('7/' || ref), ref) AS i FROM (SELECT DISTINCT ref, stratum FROM faith_sealed)) WHERE i <= 20")
def stratified_sample(spark, d):
    refs = table(spark, d, "faith_sealed").select("ref", "stratum").distinct()
    return S.stratified_sample(refs, "stratum", "ref", 20, "7").select("ref", "stratum", "weight")


@query("SELECT name AS run, e.key AS metric, e.value AS value, CASE WHEN e.value = max(e.value) OVER (PARTITION BY e.key) THEN 'top' WHEN e.value >= max(e.value) OVER (PARTITION BY e.key) - 0.05 THEN 'equivalent' ELSE 'beaten' END AS state FROM (SELECT name, unnest(map_entries(overall)) AS e FROM ablation_cell WHERE name IS NOT NULL) WHERE e.value IS NOT NULL")
def winner_set(spark, d):
    cells = table(spark, d, "ablation_cell").where("name is not null").select(F.col("name").alias("run"), F.explode("overall").alias("metric", "value")).where("value is not null")
    return S.winners(cells, "run", "metric", "value", 0.05)


@query("WITH w AS (SELECT name, p95_ms, overall['ndcg@10'] AS v FROM ablation_cell WHERE name IS NOT NULL AND p95_ms IS NOT NULL) SELECT arg_min(name, (p95_ms, name)) AS cheapest, count(*) AS members FROM w WHERE v >= (SELECT max(v) FROM w) - 0.05")
def cheapest_winner(spark, d):
    cells = table(spark, d, "ablation_cell").where("name is not null and p95_ms is not null").select("name", "p95_ms", F.col("overall")["ndcg@10"].alias("v"))
    best = F.max("v").over(Window.partitionBy(F.lit(0)))
    return cells.withColumn("best", best).where("v >= best - 0.05").agg(F.min_by("name", F.struct("p95_ms", "name")).alias("cheapest"), F.count(F.lit(1)).alias("members"))


@query("WITH r AS (SELECT run_name, CASE WHEN list_contains(g.relevant, c.chunk_id) THEN true ELSE false END AS rel, c.dense_score AS s FROM (SELECT DISTINCT run_name, query_id, chunk_id, dense_score FROM retrieved_chunk WHERE dense_score IS NOT NULL AND NOT isnan(dense_score)) c JOIN (SELECT query_id, max(relevant_chunk_ids) AS relevant FROM golden_draft WHERE relevant_chunk_ids IS NOT NULL GROUP BY query_id) g USING (query_id)), k AS (SELECT *, rank() OVER (PARTITION BY run_name ORDER BY s) + (count(*) OVER (PARTITION BY run_name, s) - 1) / 2 AS place FROM r) SELECT run_name, count(*) FILTER (rel) AS positives, count(*) FILTER (NOT rel) AS negatives, round((sum(place) FILTER (rel) - count(*) FILTER (rel) * (count(*) FILTER (rel) + 1) / 2) / nullif(count(*) FILTER (rel) * count(*) FILTER (NOT rel), 0), 6) AS auc FROM k GROUP BY run_name")
def score_auc(spark, d):
    gold = table(spark, d, "golden_draft").where("relevant_chunk_ids is not null").groupBy("query_id").agg(F.max("relevant_chunk_ids").alias("relevant"))
    rows = table(spark, d, "retrieved_chunk").select("run_name", "query_id", "chunk_id", "dense_score").where(~F.isnan("dense_score")).distinct().join(gold, "query_id")
    return M.auc(rows.withColumn("rel", F.array_contains("relevant", F.col("chunk_id"))), "dense_score", "rel", "run_name")


@query("SELECT model, round(avg((finish_reason = 'stop')::INT::DOUBLE), 6) AS stopped, count(*) FILTER (cache_hit) AS cached, count(*) FILTER (finish_reason IS NULL) AS unknown, round(sum(answer_chars) / nullif(count(*), 0), 6) AS chars FROM (SELECT DISTINCT answer_message_id, model, finish_reason, cache_hit, answer_chars FROM feedback_turn) GROUP BY model")
def turn_summary(spark, d):
    turns = table(spark, d, "feedback_turn").select("answer_message_id", "model", "finish_reason", "cache_hit", "answer_chars").distinct()
    return turns.groupBy("model").agg(
        F.round(F.avg((F.col("finish_reason") == "stop").cast("double")), 6).alias("stopped"), F.count_if("cache_hit").alias("cached"),
        F.count_if(F.col("finish_reason").isNull()).alias("unknown"), F.round(F.sum("answer_chars") / F.count(F.lit(1)), 6).alias("chars"),
    )


@query("WITH h AS (SELECT ref, gold, labelled_at FROM faith_human WHERE gold IS NOT NULL) SELECT count(*) AS votes, count(DISTINCT ref) AS refs, count(*) FILTER (" + _LAB.format("gold") + " = 'SUPPORTED') AS supported, round(count(*) FILTER (" + _LAB.format("gold") + " = 'SUPPORTED') / nullif(count(*) FILTER (" + _LAB.format("gold") + " <> 'NO_CLAIM'), 0), 6) AS faithfulness FROM h")
def faithfulness(spark, d):
    label = F.upper(F.regexp_replace(F.trim("gold"), "[ _-]+", "_"))
    rows = table(spark, d, "faith_human").where("gold is not null")
    right = F.count_if(label == "SUPPORTED")
    return rows.agg(F.count(F.lit(1)).alias("votes"), F.countDistinct("ref").alias("refs"), right.alias("supported"), F.round(right / F.nullif(F.count_if(label != "NO_CLAIM"), F.lit(0)), 6).alias("faithfulness"))


@query(r"WITH c AS (SELECT DISTINCT id, content FROM message WHERE role = 'assistant' AND content IS NOT NULL) SELECT round(avg((len(regexp_extract_all(content, '\[\d+\]')) > 0)::INT::DOUBLE), 6) AS cited, round(avg(len(regexp_extract_all(content, '\[\d+\]'))), 6) AS marks, count(*) AS answers FROM c")
def citation_coverage(spark, d):
    rows = table(spark, d, "message").where("role = 'assistant' and content is not null").select("id", "content").distinct()
    n = F.regexp_count("content", F.lit(r"\[\d+\]"))
    return rows.agg(F.round(F.avg((n > 0).cast("double")), 6).alias("cited"), F.round(F.avg(n), 6).alias("marks"), F.count(F.lit(1)).alias("answers"))


@query("SELECT lang, list_sort(list(length(text)))[round_even(0.95 * (count(*) - 1), 0)::BIGINT + 1]::INT AS p95, list_sort(list(length(text)))[round_even(0.5 * (count(*) - 1), 0)::BIGINT + 1]::INT AS p50 FROM documents WHERE text IS NOT NULL GROUP BY lang")
def nearest_rank_lengths(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("lang", F.length("text").alias("l"))
    at = lambda p: M.value_at(F.rint(F.lit(p) * (F.col("n") - 1)))
    return M.ordered_values(rows, "l", "lang").groupBy("lang").agg(at(0.95).alias("p95"), at(0.5).alias("p50"))
