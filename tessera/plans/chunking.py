"""Chunkers over whole tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as C
from ..sources.tables import table
from .registry import query


def _docs(spark, d):
    return table(spark, d, "source_docs").where("content is not null").select("doc_id", "content").dropDuplicates(["doc_id"])


_SLICES = "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk_index, start::INT AS start, substr(content, start::INT + 1, 800) AS content FROM (SELECT doc_id, content, unnest(range(0, length(content), 700)) AS start FROM (SELECT doc_id, any_value(content) AS content FROM source_docs WHERE length(content) > 0 GROUP BY doc_id))"


@query(_SLICES)
def chunk_hard_slices(spark, d):
    return C.hard_slices(_docs(spark, d), "doc_id", "content", 800, 700)


@query(f"SELECT doc_id, chunk_index, coalesce(right(lag(content) OVER w, 50), '') || content || coalesce(left(lead(content) OVER w, 50), '') AS padded FROM ({_SLICES}) WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def chunk_neighbours(spark, d):
    return C.neighbour_context(C.hard_slices(_docs(spark, d), "doc_id", "content", 800, 700), 50).select("doc_id", "chunk_index", "padded")


@query(f"SELECT count(*) AS n, min(l)::INT AS shortest, max(l)::INT AS longest, round(avg(l), 6) AS mean, round(quantile_cont(l, 0.5), 6) AS median FROM (SELECT length(content) AS l FROM ({_SLICES}))")
def chunk_sizes(spark, d):
    rows = C.hard_slices(_docs(spark, d), "doc_id", "content", 800, 700).select(F.length("content").alias("l"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("l").alias("shortest"), F.max("l").alias("longest"), F.round(F.avg("l"), 6).alias("mean"), F.round(F.percentile("l", 0.5), 6).alias("median"))


@query()
def chunk_fixed(spark, d):
    return C.chunked(_docs(spark, d), "doc_id", "content", "fixed")


@query()
def chunk_semantic(spark, d):
    return C.chunked(_docs(spark, d), "doc_id", "content", "semantic")


@query()
def chunk_structure(spark, d):
    return C.chunked(_docs(spark, d), "doc_id", "content", "structure")


@query()
def chunk_budgeted(spark, d):
    """Chunks of at most 120 words."""
    return C.chunked(_docs(spark, d), "doc_id", "content", "budget", limit=120)


@query()
def chunk_hybrid(spark, d):
    return C.hybrid(_docs(spark, d), "doc_id", "content")


@query()
def chunk_parent_child(spark, d):
    return C.parent_child(_docs(spark, d), "doc_id", "content")


@query(
    r"""WITH l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id) AS i FROM (SELECT doc_id, unnest(string_split(content, chr(10))) AS line FROM (SELECT doc_id, any_value(content) AS content FROM source_docs WHERE content IS NOT NULL GROUP BY doc_id)))
    SELECT doc_id, count(*) AS headings, min(length(regexp_extract(line, '^(#{1,6})\s', 1)))::INT AS depth FROM l WHERE regexp_matches(line, '^#{1,6}\s+\S') GROUP BY doc_id"""
)
def heading_lines(spark, d):
    lines = _docs(spark, d).select("doc_id", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike(r"^#{1,6}\s+\S"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("headings"), F.min(F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))).alias("depth"))


@query(
    f"""WITH s AS (SELECT doc_id, chunk_index, content, len(regexp_extract_all(content, '{T.WORD}')) AS n FROM ({_SLICES}))
    SELECT doc_id, chunk_index, n AS words, sum(n) OVER (PARTITION BY doc_id ORDER BY chunk_index)::BIGINT AS running, floor(chunk_index / 8)::BIGINT AS batch FROM s"""
)
def context_batches(spark, d):
    rows = C.hard_slices(_docs(spark, d), "doc_id", "content", 800, 700).withColumn("words", F.regexp_count("content", F.lit(T.WORD)).cast("bigint"))
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return rows.select("doc_id", "chunk_index", "words", F.sum("words").over(w).alias("running"), F.floor(F.col("chunk_index") / 8).alias("batch"))


@query(
    r"""WITH d AS (SELECT doc_id, any_value(content) AS c FROM source_docs WHERE length(content) > 0 GROUP BY doc_id),
    p AS (SELECT doc_id, substr(c, (k * (length(c) // 12))::INT + 1, 2000) AS s FROM d, (SELECT unnest(range(0, 12)) AS k))
    SELECT doc_id, round(sum(length(s)) / nullif(sum(len(regexp_extract_all(s, '[\p{L}\p{N}_]+'))), 0), 6) AS density FROM p GROUP BY doc_id"""
)
def density_calibration(spark, d):
    docs = _docs(spark, d).where(F.length("content") > 0)
    step = F.floor(F.length("content") / 12).cast("int")
    pieces = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.substring(F.col("content"), k * step + 1, F.lit(2000)))).alias("s"))
    return pieces.groupBy("doc_id").agg(F.round(F.sum(F.length("s")) / F.nullif(F.sum(F.regexp_count("s", F.lit(T.WORD))), F.lit(0)), 6).alias("density"))
