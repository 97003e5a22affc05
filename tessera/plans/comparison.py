"""Comparison of branches, groups and runs, and the rules of a release gate, over whole tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gate as G
from ..operators import metrics as M
from ..operators import stats as S
from ..sources.tables import table
from .evaluation import _BOTH, _GRID, _METRICS, _pairs, _scored, _sides, LABELS
from .registry import query

_P = """CASE WHEN better + worse = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(greatest(better, worse), better + worse + 1), lambda x: exp(lgamma(better + worse + 1) - lgamma(x + 1) - lgamma(better + worse - x + 1) - (better + worse) * ln(2))))) END"""


def _tests(source: str, group: str, corrected: bool) -> str:
    family = f"(SELECT count(DISTINCT {group}) * count(DISTINCT metric) FROM ts)" if corrected else "1"
    return f"""ts AS (SELECT {group}, metric, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(diff) AS d, count(*) FILTER (diff > 1e-9) AS better, count(*) FILTER (diff < -1e-9) AS worse FROM {source} GROUP BY ALL),
    tt AS (SELECT *, {_P} AS p, 0.05 / {family} AS alpha FROM ts),
    tests AS (SELECT {group}, metric, CASE WHEN metric LIKE 'hit%' THEN 'mcnemar' ELSE 'sign' END AS test, n, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(d, 6) AS diff, better, worse, round(p, 6) AS p, round(alpha, 9) AS alpha,
    CASE WHEN better + worse = 0 AND abs(d) < 1e-12 THEN 'identical' WHEN least(1, 2 / pow(2, better + worse)) >= alpha THEN 'underpowered' WHEN p >= alpha THEN 'within noise' WHEN (better - worse) * d <= 0 THEN 'split' ELSE 'real difference' END AS verdict FROM tt)"""


_CATEGORY = "cat AS (SELECT query_id AS q, coalesce(max(category), '(none)') AS category FROM golden_draft GROUP BY query_id), g AS (SELECT cat.category, p.* FROM p JOIN cat ON cat.q = string_split(p.query_id, '/')[-1])"


def _by_category(spark, d):
    known = table(spark, d, "golden_draft").groupBy(F.col("query_id").alias("q")).agg(F.coalesce(F.max("category"), F.lit("(none)")).alias("category"))
    return _sides(spark, d).withColumn("q", F.element_at(F.split("query_id", "/"), -1)).join(known, "q")


@query(f"{_BOTH}, {_CATEGORY}, {_tests('g', 'category', True)} SELECT * FROM tests")
def group_comparison(spark, d):
    """The two branches in each category, with alpha divided by the number of tests."""
    return S.tested(_by_category(spark, d), "category")


@query(
    f"""{_BOTH}, {_CATEGORY}, s2 AS (SELECT category, metric, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(diff) AS d FROM g GROUP BY ALL)
    SELECT category, metric, n, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(d, 6) AS delta, row_number() OVER (PARTITION BY metric ORDER BY round(d, 9) DESC, category)::INT AS rank FROM s2"""
)
def group_deltas(spark, d):
    """Categories by how much the second branch gains, for metrics that don't depend on the number of labels."""
    rows = _by_category(spark, d).where(S.starts(F.col("metric"), S.SCALE_FREE))
    sums = rows.groupBy("category", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg("diff").alias("d"))
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.round("d", 9).desc(), "category"))
    return sums.select("category", "metric", "n", F.round("ma", 6).alias("mean_a"), F.round("mb", 6).alias("mean_b"), F.round("d", 6).alias("delta"), rank.alias("rank"))


@query()
def group_contrasts(spark, d):
    """The category that gains most against every other one, by 10 000 resamples."""
    return S.group_contrast(_by_category(spark, d).where("metric = 'mrr'"), "category", F.col("query_id"))


@query()
def comparison_rows(spark, d):
    """The two branches by the test that suits each metric, with flags for rows that can't be read."""
    return S.flagged(_sides(spark, d), F.col("query_id"))


_LONG = _METRICS + ", l AS (SELECT run_name, query_id, metric, value FROM (UNPIVOT m ON ndcg_10, mrr, hit_1 INTO NAME metric VALUE value))"
_AGAINST = "pr AS (SELECT l.run_name, l.query_id, l.metric, o.value AS a, l.value AS b, l.value - o.value AS diff FROM l JOIN l o ON o.query_id = l.query_id AND o.metric = l.metric WHERE o.run_name = ({one}) AND l.run_name <> o.run_name)"


def _against(rows, one):
    base = rows.where(F.col("run_name") == one).select("query_id", "metric", F.col("value").alias("a"))
    return rows.where(F.col("run_name") != one).join(base, ["query_id", "metric"]).withColumn("b", F.col("value")).withColumn("diff", F.col("b") - F.col("a"))


_BASE = "SELECT run_name FROM l GROUP BY run_name ORDER BY count(DISTINCT query_id) DESC, run_name LIMIT 1"


@query(f"{_LONG}, {_AGAINST.format(one=_BASE)}, {_tests('pr', 'run_name', False)} SELECT * FROM tests")
def ablation_tests(spark, d):
    """Every run against the one of most queries, on the queries that both have, without correction."""
    rows = M.long(_scored(spark, d), ["run_name", "query_id"], ["ndcg_10", "mrr", "hit_1"])
    base = rows.groupBy("run_name").agg(F.countDistinct("query_id").alias("n")).orderBy(F.desc("n"), "run_name").first()
    return S.tested(_against(rows, base.run_name if base else ""), "run_name", corrected=False)


_TOP = "SELECT run_name FROM (SELECT run_name, round(avg(value), 9) AS v FROM l WHERE metric = 'ndcg_10' GROUP BY run_name) ORDER BY v DESC, run_name LIMIT 1"


@query(
    f"""{_LONG}, {_AGAINST.format(one=_TOP)}, {_tests('pr', 'run_name', True)}, u AS (SELECT run_name, count(*) FILTER (verdict = 'real difference' AND diff < 0) AS worse, count(*) FILTER (verdict = 'real difference' AND diff > 0) AS better, count(*) AS usable FROM tests GROUP BY run_name)
    SELECT r.run_name, CASE WHEN r.run_name = ({_TOP}) THEN 'top' WHEN usable IS NULL THEN 'incomparable' WHEN worse = 0 THEN 'equivalent' WHEN worse = usable THEN 'beaten' ELSE 'contested' END AS bucket, coalesce(worse, 0) AS worse, coalesce(better, 0) AS better
    FROM (SELECT DISTINCT run_name FROM l) r LEFT JOIN u USING (run_name)"""
)
def winner_buckets(spark, d):
    """All runs against the best by mean ndcg, with alpha divided by the number of tests."""
    rows = M.long(_scored(spark, d), ["run_name", "query_id"], ["ndcg_10", "mrr", "hit_1"])
    means = rows.where("metric = 'ndcg_10'").groupBy("run_name").agg(F.round(F.avg("value"), 9).alias("v"))
    first = means.orderBy(F.desc("v"), "run_name").first()
    top = first.run_name if first else ""
    return S.winner_buckets(S.tested(_against(rows, top), "run_name"), rows, "run_name", top)


@query(
    """WITH c AS (SELECT name, e.key AS metric, e.value AS value FROM (SELECT name, unnest(map_entries(overall)) AS e FROM ablation_cell WHERE name IS NOT NULL) WHERE e.value IS NOT NULL UNION ALL SELECT name, 'p95_ms', p95_ms FROM ablation_cell WHERE name IS NOT NULL AND p95_ms IS NOT NULL),
    b AS (SELECT metric, value FROM c WHERE name = (SELECT min(name) FROM c))
    SELECT c.name, c.metric, round(c.value - b.value, 6) AS delta, CASE WHEN abs(c.value - b.value) < 1e-12 THEN 'tie' WHEN (c.value > b.value) = (c.metric <> 'p95_ms') THEN 'candidate' ELSE 'baseline' END AS side FROM c JOIN b USING (metric) WHERE c.name <> (SELECT min(name) FROM c)"""
)
def metric_directions(spark, d):
    """Which side each metric speaks for: more is better for some, less for the others."""
    cells = table(spark, d, "ablation_cell").where("name is not null")
    rows = cells.select("name", F.explode("overall").alias("metric", "value")).unionByName(cells.select("name", F.lit("p95_ms").alias("metric"), F.col("p95_ms").alias("value"))).where("value is not null")
    first = rows.agg(F.min("name")).first()[0]
    both = rows.where(F.col("name") != first).join(rows.where(F.col("name") == first).select("metric", F.col("value").alias("base")), "metric")
    delta = F.col("value") - F.col("base")
    side = F.when(F.abs(delta) < 1e-12, "tie").when((delta > 0) == S.starts(F.col("metric"), S.HIGHER_BETTER), "candidate").otherwise("baseline")
    return both.select("name", "metric", F.round(delta, 6).alias("delta"), side.alias("side"))


_RULES = f"""WITH cells AS (SELECT name, embedding_model, chunk_size, overall['ndcg@10'] AS ndcg, p95_ms FROM ablation_cell WHERE name IS NOT NULL),
    champ AS (SELECT * FROM cells WHERE ndcg IS NOT NULL ORDER BY ndcg DESC, name LIMIT 1), k AS (SELECT (SELECT sum(weight) FROM ({_GRID}) WHERE a = b) / t AS o, (SELECT sum(r * c) FROM (SELECT a AS l, sum(weight) AS r FROM ({_GRID}) GROUP BY a) JOIN (SELECT b AS l, sum(weight) AS c FROM ({_GRID}) GROUP BY b) USING (l)) / (t * t) AS e FROM (SELECT sum(weight) AS t FROM ({_GRID}))),
    v AS (SELECT (SELECT count(*) FILTER (label IS NULL) / count(*) FROM faith_cross) AS unjudged, (SELECT (o - e) / (1 - e) FROM k) AS kappa),
    rules AS (SELECT c.name, 'comparability' AS kind, 'same_encoder' AS rule, CASE WHEN c.embedding_model IS NOT DISTINCT FROM h.embedding_model THEN 'PASS' ELSE 'FAIL' END AS outcome FROM cells c, champ h
    UNION ALL SELECT c.name, 'comparability', 'explicit_identity', CASE WHEN c.embedding_model IS NULL OR c.embedding_model LIKE '%latest%' THEN 'FAIL' ELSE 'PASS' END FROM cells c
    UNION ALL SELECT c.name, 'validity', 'unjudged', CASE WHEN v.unjudged IS NULL THEN 'SKIP' WHEN v.unjudged <= 0.1 THEN 'PASS' ELSE 'FAIL' END FROM cells c, v
    UNION ALL SELECT c.name, 'validity', 'kappa', CASE WHEN v.kappa IS NULL THEN 'SKIP' WHEN v.kappa >= 0.2 THEN 'PASS' ELSE 'FAIL' END FROM cells c, v
    UNION ALL SELECT c.name, 'absolute', 'ndcg', CASE WHEN c.ndcg >= 0.3 THEN 'PASS' ELSE 'FAIL' END FROM cells c
    UNION ALL SELECT c.name, 'absolute', 'p95_ms', CASE WHEN c.p95_ms <= 900 THEN 'PASS' ELSE 'FAIL' END FROM cells c
    UNION ALL SELECT c.name, 'regression', 'ndcg', CASE WHEN c.ndcg IS NULL THEN 'FAIL' WHEN c.ndcg >= h.ndcg - 0.2 THEN 'PASS' ELSE 'FAIL' END FROM cells c, champ h
    UNION ALL SELECT c.name, 'regression', 'p95_ms', CASE WHEN c.p95_ms IS NULL THEN 'FAIL' WHEN h.p95_ms IS NULL THEN 'SKIP' WHEN c.p95_ms <= h.p95_ms + 200 THEN 'PASS' ELSE 'FAIL' END FROM cells c, champ h)"""


def _rules(spark, d):
    cells = table(spark, d, "ablation_cell").where("name is not null").select("name", "embedding_model", "chunk_size", F.col("overall")["ndcg@10"].alias("ndcg"), "p95_ms")
    champion = cells.where("ndcg is not null").orderBy(F.desc("ndcg"), "name").limit(1)
    unjudged = table(spark, d, "faith_cross").agg(F.avg(F.col("label").isNull().cast("double")).alias("unjudged"))
    kappa = S.agreement(S.confusion(_pairs(spark, d), LABELS, "a", "b", "weight")).select("kappa")
    return G.rules(
        cells, champion, unjudged.crossJoin(kappa), "name",  # one row and one row
        same={"same_encoder": "embedding_model"}, explicit="embedding_model", most_unjudged=0.1, least_kappa=0.2,
        limits={"ndcg": (0.3, None), "p95_ms": (None, 900.0)}, drops={"ndcg": 0.2, "p95_ms": -200.0},
    )


@query(_RULES + " SELECT name, kind, rule, outcome FROM rules")
def gate_rules(spark, d):
    """Every rule of the gate for every cell against the best one."""
    return _rules(spark, d)


@query(
    _RULES + """, w AS (SELECT name, bool_or(outcome = 'FAIL' AND kind = 'comparability') AS blocked, bool_or(outcome = 'FAIL') AS failed FROM rules GROUP BY name)
    SELECT name, CASE WHEN blocked THEN 'INCOMPARABLE' WHEN failed THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN blocked THEN 2 WHEN failed THEN 1 ELSE 0 END::INT AS exit_code FROM w"""
)
def gate_status(spark, d):
    return G.status(_rules(spark, d), "name")
