"""Histories, histograms, spend and limits over whole tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ops as O
from ..sources.tables import table
from .registry import query

EDGES = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0]


@query(
    """WITH m AS (SELECT DISTINCT id, conversation_id, role, created_at, content FROM message WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL)
    SELECT id, conversation_id, last_value(CASE WHEN role = 'user' THEN id END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS question_id FROM m QUALIFY role = 'assistant'"""
)
def asof_questions(spark, d):
    """Questions by time alone; `answer_questions` goes by the key first."""
    rows = table(spark, d, "message").where("conversation_id is not null and created_at is not null").select("id", "conversation_id", "role", "created_at", "content").distinct()
    return O.as_of(rows, "conversation_id", ["created_at", "id"], F.col("role") == "user", "id", "question_id").where("role = 'assistant'").select("id", "conversation_id", "question_id")


@query(
    """WITH m AS (SELECT DISTINCT id, conversation_id, role, created_at, user_message_id FROM message)
    SELECT a.id, a.conversation_id, CASE WHEN a.user_message_id IS NOT NULL THEN max(k.id) ELSE arg_max(u.id, (u.created_at, u.id)) END AS question_id FROM m a LEFT JOIN (SELECT DISTINCT id FROM m) k ON k.id = a.user_message_id
    LEFT JOIN m u ON a.user_message_id IS NULL AND u.role = 'user' AND u.conversation_id = a.conversation_id AND u.created_at <= a.created_at WHERE a.role = 'assistant' GROUP BY a.id, a.conversation_id, a.created_at, a.user_message_id"""
)
def answer_questions(spark, d):
    """Each answer's question by its key, and by time only where there is no key."""
    return O.questions(table(spark, d, "message"))


@query("SELECT tenant_id, id, age::INT AS age FROM (SELECT tenant_id, id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS age FROM (SELECT DISTINCT tenant_id, id, created_at FROM message WHERE tenant_id IS NOT NULL AND content IS NOT NULL AND trim(content) <> '')) WHERE age <= 10")
def last_history(spark, d):
    rows = table(spark, d, "message").where("tenant_id is not null and content is not null and trim(content) <> ''").select("tenant_id", "id", "created_at").distinct()
    return O.last_rows(rows, "tenant_id", [F.desc("created_at"), F.desc("id")], 10).select("tenant_id", "id", "age")


@query("SELECT event_id, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 0) ORDER BY ts, event_id LIMIT 50")
def event_page(spark, d):
    cursor = [F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit(0).cast("bigint")]
    return O.page_after(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], cursor, 50)


_CELLS = " UNION ALL ".join(f"SELECT event_type, {e}::DOUBLE AS le, count(*) FILTER (value <= {e}) AS count FROM events WHERE value IS NOT NULL GROUP BY event_type" for e in EDGES) + " UNION ALL SELECT event_type, 'inf'::DOUBLE, count(*) FROM events WHERE value IS NOT NULL GROUP BY event_type"


@query(_CELLS)
def value_histogram(spark, d):
    return O.histogram(table(spark, d, "events"), "value", EDGES, "event_type")


@query(
    f"""WITH h AS ({_CELLS}), r AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(count) OVER w, 0) AS under, 0.95 * max(count) OVER (PARTITION BY event_type) AS target FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le))
    SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (target - under) / (count - under) END, 6) AS value FROM r WHERE count >= target AND under < target"""
)
def histogram_p95(spark, d):
    return O.histogram_quantile(O.histogram(table(spark, d, "events"), "value", EDGES, "event_type"), 0.95, "event_type")


@query("SELECT event_type, day::VARCHAR AS day, n, coalesce(n - lag(n) OVER (PARTITION BY event_type ORDER BY day), 0) AS delta FROM (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)")
def daily_delta(spark, d):
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    delta = F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))
    return days.withColumn("delta", F.coalesce(delta, F.lit(0))).withColumn("day", F.col("day").cast("string"))


@query("WITH l AS (SELECT day, n, lag(n) OVER (ORDER BY day) AS before FROM (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)) SELECT min(day)::VARCHAR AS knee FROM l WHERE before IS NOT NULL AND n <= before * 1.05")
def knee(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("before", F.lag("n").over(Window.orderBy("day"))).where("before is not null and n <= before * 1.05").agg(F.min("day").cast("string").alias("knee"))


@query("SELECT event_id, (user_id % 4)::VARCHAR AS tenant, round(sum(value) OVER (PARTITION BY user_id % 4, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS spent FROM events")
def daily_spend(spark, d):
    rows = O.running_spend(table(spark, d, "events"), (F.col("user_id") % 4).cast("string"), "ts", "value", "event_id")
    return rows.select("event_id", "tenant", F.round("spent", 4).alias("spent"))


_STEPS = "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(
    _STEPS + """, r AS (SELECT user_id, event_id, n, sec, 2.0::DOUBLE AS level, true AS allowed FROM e WHERE n = 1
    UNION ALL SELECT user_id, event_id, n, sec, CASE WHEN l >= 1 THEN l - 1 ELSE l END, l >= 1 FROM (SELECT e.*, least(3.0, r.level + greatest(0.0, e.sec - r.sec) * 0.02 / 60) AS l FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT user_id, event_id, allowed FROM r"""
)
def token_bucket(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    rows = e.withColumn("seconds", F.col("us") / 1e6).select("user_id", "event_id", "ts", "seconds")
    return O.token_bucket(rows, "user_id", "seconds", ["ts", "event_id"], per_minute=0.02, burst=3).select("user_id", "event_id", "allowed")


@query(
    _STEPS + """, r AS (SELECT user_id, event_id, n, coalesce(failed, false)::INT AS cnt, NULL::DOUBLE AS since, 'closed' AS state FROM e WHERE n = 1
    UNION ALL SELECT user_id, event_id, n, CASE WHEN named = 'open' OR failed IS NULL THEN cnt WHEN NOT failed THEN 0 ELSE cnt + 1 END,
    CASE WHEN named = 'open' OR failed IS NULL THEN since WHEN NOT failed THEN NULL WHEN cnt + 1 >= 3 OR named = 'probe' THEN sec ELSE NULL END, named FROM (SELECT e.*, r.cnt, r.since,
    CASE WHEN r.since IS NOT NULL AND e.sec - r.since < 86400 THEN 'open' WHEN r.since IS NULL THEN 'closed' ELSE 'probe' END AS named FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT user_id, event_id, state FROM r"""
)
def circuit_states(spark, d):
    e = table(spark, d, "events")
    event = F.struct((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") == "error").alias("failed"))
    rows = e.select("user_id", "event_id", "ts", event.alias("event"))
    return O.circuit_breaker(rows, "user_id", "event", ["ts", "event_id"], 3, 86400.0).select("user_id", "event_id", "state")


@query("SELECT user_id, event_type, date_trunc('hour', ts) AS slot, min(event_id) AS leader, count(*) AS merged FROM events GROUP BY ALL")
def single_flight(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("slot")).agg(F.min("event_id").alias("leader"), F.count(F.lit(1)).alias("merged"))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n > 32")
def evicted_entries(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("event_id", "user_id", F.row_number().over(w).alias("n")).where("n > 32").drop("n")


@query("SELECT event_id, coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) > 3600000000, false) AS expired FROM events")
def expired_entries(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.coalesce(us(F.lead("ts").over(w)) - us(F.col("ts")) > 3_600_000_000, F.lit(False)).alias("expired"))


@query("SELECT user_id, sum((event_type <> coalesce(before, event_type))::INT)::BIGINT AS switches FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id")
def group_switches(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").withColumn("before", before)
    return rows.groupBy("user_id").agg(F.count_if(F.col("event_type") != F.coalesce("before", "event_type")).alias("switches"))


@query("SELECT user_id, count(*) AS islands, max(n) AS longest FROM (SELECT user_id, grp, count(*) AS n FROM (SELECT user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, (epoch_us(ts) - coalesce(epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0) > 7200000000)::INT AS brk FROM events)) GROUP BY ALL) GROUP BY user_id")
def gap_islands(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = table(spark, d, "events").withColumn("brk", (us(F.col("ts")) - F.coalesce(us(F.lag("ts").over(w)), F.lit(0)) > 7_200_000_000).cast("int"))
    runs = rows.withColumn("grp", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("islands"), F.max("n").alias("longest"))


@query("SELECT a.id, a.user_message_id AS parent, b.role AS parent_role, round((epoch_us(a.created_at) - epoch_us(b.created_at)) / 1000.0, 3) AS wait_ms FROM (SELECT DISTINCT id, user_message_id, created_at FROM message WHERE user_message_id IS NOT NULL) a LEFT JOIN (SELECT DISTINCT id, role, created_at FROM message) b ON b.id = a.user_message_id")
def message_trees(spark, d):
    rows = table(spark, d, "message")
    a = rows.where("user_message_id is not null").select("id", F.col("user_message_id").alias("parent"), "created_at").distinct()
    b = rows.select(F.col("id").alias("parent"), F.col("role").alias("parent_role"), F.col("created_at").alias("asked")).distinct()
    wait = (F.unix_micros("created_at") - F.unix_micros("asked")) / 1000.0
    return a.join(b, "parent", "left").select("id", "parent", "parent_role", F.round(wait, 3).alias("wait_ms"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'2000-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, n, total FROM (SELECT c.c_custkey, count(o.o_orderkey) AS n, round(coalesce(sum(o.o_totalprice), 0), 2) AS total FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL)")
def customer_orders(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    out = table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))
