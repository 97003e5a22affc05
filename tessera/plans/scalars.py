"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..sources.tables import table
from .registry import query

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
_WS = "\\s+"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{T.WORD}'))::INT AS words, list_sort(list_distinct(regexp_extract_all(lower(text), '{T.WORD}')))::VARCHAR[] AS tokens FROM documents WHERE text IS NOT NULL")
def word_tokens(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(T.words(F.col("text"))).alias("words"), T.token_set(F.col("text")).alias("tokens"))


@query(
    r"""SELECT doc_id, sha256(regexp_replace(array_to_string(list_transform(string_split(replace(replace(content, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)),
    lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), chr(10)), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS digest FROM source_docs WHERE content IS NOT NULL"""
)
def content_hashes(spark, d):
    docs = table(spark, d, "source_docs").where("content is not null")
    return docs.select("doc_id", T.content_hash(F.col("content")).alias("digest"))


_DEDUPE_SQL = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT query_id, {_DEDUPE_SQL.format('query')} AS form, concat_ws('-', category, substr(sha1({_DEDUPE_SQL.format('query')}), 1, 10)) AS key FROM golden_draft WHERE query IS NOT NULL")
def dedupe_forms(spark, d):
    drafts = table(spark, d, "golden_draft").where("query is not null")
    return drafts.select("query_id", T.dedupe_form(F.col("query")).alias("form"), T.query_key(F.col("category"), F.col("query")).alias("key"))


@query(
    r"""SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(metadata.title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS s
    FROM source_docs WHERE metadata.title IS NOT NULL)"""
)
def title_slugs(spark, d):
    docs = table(spark, d, "source_docs").where("metadata.title is not null")
    return docs.select("doc_id", T.slug(F.col("metadata.title")).alias("slug"))


@query(
    f"""SELECT chunk_id, substr(h,1,12) || '5' || substr(h,14,3) || substr('89ab', (('0x' || substr(h,17,1))::INT % 4) + 1, 1) || substr(h,18,15) AS point_id
    FROM (SELECT chunk_id, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(chunk_id)) AS h FROM (SELECT DISTINCT chunk_id FROM retrieved_chunk WHERE chunk_id IS NOT NULL))"""
)
def point_ids(spark, d):
    chunks = table(spark, d, "retrieved_chunk").select("chunk_id").where("chunk_id is not null").distinct()
    return chunks.select("chunk_id", T.name_uuid(NAMESPACE, F.col("chunk_id")).alias("point_id"))


@query("SELECT query_id, substr(sha256(array_to_string(list_sort(list_distinct(relevant_chunk_ids)), chr(10))), 1, 16) AS digest FROM golden_draft WHERE relevant_chunk_ids IS NOT NULL")
def label_digests(spark, d):
    drafts = table(spark, d, "golden_draft").where("relevant_chunk_ids is not null")
    return drafts.select("query_id", T.label_digest(F.col("relevant_chunk_ids")).alias("digest"))


@query(r"""SELECT doc_id, (i - 1)::INT AS sentence, ps[i] AS content FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?…])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), '\n[ \t\n\x0B\f\r]*\n', chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ps
    FROM documents WHERE text IS NOT NULL))""")
def sentence_pieces(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence", "content"))


@query(
    r"""SELECT id, list_distinct_ordered AS cited, regexp_replace(regexp_replace(content, '\s*\[\d+\]', '', 'g'), '^ +| +$', '', 'g') AS plain FROM (SELECT id, content,
    list_reduce(list_prepend([]::INT[], list_transform(regexp_extract_all(content, '\[(\d{1,6})\]', 1), lambda x: [x::INT])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END) AS list_distinct_ordered
    FROM message WHERE content IS NOT NULL)"""
)
def citation_marks(spark, d):
    rows = table(spark, d, "message").where("content is not null")
    return rows.select("id", T.citation_numbers(F.col("content")).alias("cited"), T.without_citations(F.col("content")).alias("plain"))


@query(
    r"""SELECT doc_id, CASE WHEN length(f) > 220 THEN rtrim(substr(f, 1, 220)) || '…' ELSE f END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents WHERE text IS NOT NULL)"""
)
def previews(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(r"SELECT doc_id, list_sort(regexp_extract_all(text, '[0-9][0-9.,%/]*')) AS numbers, len(list_distinct(regexp_extract_all(text, '[A-Z0-9]+(?:[/-][A-Z0-9]+)+')))::INT AS codes FROM documents WHERE text IS NOT NULL")
def digit_tokens(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.digit_tokens(F.col("text")).alias("numbers"), F.size(T.codes(F.col("text"))).alias("codes"))


@query("SELECT id, (" + " OR ".join(f"contains(lower(content), '{m.replace(chr(39), chr(39) * 2)}')" for m in T.REFUSAL_MARKERS) + ") AS refused FROM message WHERE content IS NOT NULL")
def refusal_marks(spark, d):
    return table(spark, d, "message").where("content is not null").select("id", T.looks_refused(F.col("content")).alias("refused"))


_ENGLISH = "[" + ",".join(f"'{w}'" for w in T.COMMON_ENGLISH.split()) + "]"


@query(
    f"""SELECT doc_id, CASE WHEN l = 0 OR (l - n) * 2 > l THEN 'unknown' WHEN regexp_matches(lower(text), '[{T.VIETNAMESE_LETTERS}]') THEN 'vi'
    WHEN list_has_any(regexp_extract_all(regexp_replace(lower(text), '[''’ʼ]', '', 'g'), '{T.WORD}'), {_ENGLISH}) THEN 'en' ELSE 'unknown' END AS lang FROM (SELECT doc_id, text,
    len(regexp_extract_all(text, '\\p{{L}}')) AS l, len(regexp_extract_all(text, '\\p{{Latin}}')) AS n FROM documents WHERE text IS NOT NULL)"""
)
def rule_languages(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.language(F.col("text")).alias("lang"))


def _words_sql(block: str) -> str:
    return "[" + ",".join(f"'{w}'" for w in block.split()) + "]"


_CORE, _SOCIAL = _words_sql(T.SOCIAL_CORE), _words_sql(f"{T.SOCIAL_CORE} {T.SOCIAL_PARTICLES} {T.SOCIAL_ADDRESS}")
_STOP = _words_sql(f"{T.COMMON_ENGLISH} {T.SOCIAL_CORE} {T.SOCIAL_PARTICLES} {T.REFERENCE_WORDS} {T.VIETNAMESE_FUNCTION}")


@query(
    f"""WITH t AS (SELECT id, regexp_extract_all(regexp_replace(lower(content), '[''’ʼ]', '', 'g'), '{T.WORD}') AS ws FROM message WHERE role = 'user' AND content IS NOT NULL),
    c AS (SELECT id, len(ws) > 0 AND len(list_filter(ws, lambda w: NOT list_contains({_SOCIAL}, w))) = 0 AND list_has_any(ws, {_CORE}) AS social, len(list_filter(ws, lambda w: NOT list_contains({_STOP}, w))) AS content FROM t)
    SELECT id, CASE WHEN social THEN 'no_retrieval' WHEN content = 0 THEN 'clarify' ELSE 'retrieve' END AS route, false AS needs_rewrite, CASE WHEN social THEN 'social' WHEN content = 0 THEN 'no_content' ELSE 'content' END AS reason FROM c"""
)
def question_routes(spark, d):
    turns = table(spark, d, "message").where("role = 'user' and content is not null")
    return turns.select("id", T.route(F.col("content"), F.lit(False)).alias("r")).select("id", "r.*")


_FLAT = r"lower(regexp_replace(text, '[ \t ]+', ' ', 'g'))"


@query(
    "SELECT doc_id, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches({_FLAT}, '{r.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, r in T.INJECTION_RULES.items())
    + "], lambda x: x IS NOT NULL) AS flags FROM documents WHERE text IS NOT NULL"
)
def injection_scan(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.injection_flags(F.col("text")).alias("flags"))


@query(
    r"""SELECT doc_id, list_filter(regexp_extract_all(text, '\p{L}+'), lambda w: (regexp_matches(w, '\p{Latin}') AND regexp_matches(w, '[\p{Cyrillic}\p{Greek}]')) OR (regexp_matches(w, '\p{Cyrillic}') AND regexp_matches(w, '\p{Greek}'))) AS words
    FROM documents WHERE text IS NOT NULL"""
)
def mixed_scripts(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.mixed_script_words(F.col("text")).alias("words"))


@query()
def redactions(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.redacted(F.col("text")).alias("text"))


@query(
    f"""WITH l AS (SELECT doc_id, content, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '') AS ls FROM source_docs WHERE content IS NOT NULL)
    SELECT doc_id, round(len(list_filter(ls, lambda x: regexp_matches(x, '\\S {{3,}}\\S'))) / nullif(len(ls), 0), 6) AS gutter,
    round(list_sum(list_transform(ls, lambda x: len(regexp_extract_all(x, '{T.WORD}')))) / nullif(len(ls), 0), 6) AS per_line FROM l"""
)
def layout_quality(spark, d):
    docs = table(spark, d, "source_docs").where("content is not null")
    return docs.select("doc_id", F.round(T.gutter_ratio(F.col("content")), 6).alias("gutter"), F.round(T.words_per_line(F.col("content")), 6).alias("per_line"))


@query(
    f"""WITH l AS (SELECT doc_id, content, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '') AS ls, length(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS seen FROM source_docs WHERE content IS NOT NULL)
    SELECT doc_id, len(regexp_extract_all(content, '{T.WORD}')) >= 60 AND len(regexp_extract_all(content, '\\p{{L}}')) / nullif(seen, 0) >= 0.6 AND len(list_filter(ls, lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r] {{3,}}[^ \\t\\n\\x0B\\f\\r]'))) / nullif(len(ls), 0) <= 0.3
    AND coalesce(list_sum(list_transform(ls, lambda x: len(regexp_extract_all(x, '{T.WORD}')))), 0) / nullif(len(ls), 0) >= 10 AS prose FROM l"""
)
def prose_documents(spark, d):
    docs = table(spark, d, "source_docs").where("content is not null")
    return docs.select("doc_id", T.looks_like_prose(F.col("content")).alias("prose"))


@query(r"SELECT doc_id, lower(regexp_extract(metadata.source_url, '(\.[^./]+)$', 1)) AS format, regexp_matches(metadata.source_url, '^https?://') AS is_web FROM source_docs WHERE metadata.source_url IS NOT NULL")
def url_formats(spark, d):
    docs = table(spark, d, "source_docs").where("metadata.source_url is not null")
    url = F.col("metadata.source_url")
    return docs.select("doc_id", T.file_format(url).alias("format"), url.rlike("^https?://").alias("is_web"))


@query(
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS size,
    round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, len(embedding)::INT AS dims FROM embeddings"""
)
def vector_norms(spark, d):
    e = table(spark, d, "embeddings")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("size"), F.round(total, 5).alias("total"), F.size("embedding").alias("dims"))


@query(
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS w FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL)
    SELECT doc_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 65536)::INT AS bucket, round(max(ln(1 + n)), 6) AS weight FROM f GROUP BY ALL"""
)
def sparse_encoding(spark, d):
    from ..operators.retrieve import sparse_vectors

    docs = table(spark, d, "documents").where("text is not null")
    return sparse_vectors(docs, "doc_id", "text").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query(
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS w FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL),
    b AS (SELECT doc_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 64)::INT AS bucket, sum(ln(1 + n)) AS v FROM f GROUP BY ALL)
    SELECT doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM b"""
)
def dense_encoding(spark, d):
    from ..operators.retrieve import dense_vectors

    docs = table(spark, d, "documents").where("text is not null")
    return dense_vectors(docs, "doc_id", "text", 64).select("doc_id", "bucket", F.round("value", 6).alias("value"))


@query(
    """SELECT event_id, date_trunc('day', ts) AS day, hour(ts)::INT AS hour, ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AS in_range,
    json_extract(props, '$.k')::INT AS k FROM events"""
)
def event_days(spark, d):
    e = table(spark, d, "events")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10", "2024-01-20"))
    return e.select("event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.hour("ts").alias("hour"), F.col("ts").between(lo, hi).alias("in_range"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(
    """SELECT f.answer_message_id AS id, length(q) >= 12 AND contains(a, q) AS found FROM (SELECT DISTINCT answer_message_id, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS q FROM feedback_turn WHERE question IS NOT NULL) f
    JOIN (SELECT DISTINCT id, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS a FROM message WHERE content IS NOT NULL) m ON f.answer_message_id = m.id"""
)
def quoted_questions(spark, d):
    turns = table(spark, d, "feedback_turn").where("question is not null").select("answer_message_id", "question").distinct()
    replies = table(spark, d, "message").where("content is not null").select("id", "content").distinct()
    both = turns.join(replies, turns.answer_message_id == replies.id)
    return both.select("id", T.quote_found(F.col("question"), F.col("content")).alias("found"))


@query(
    """SELECT name, e.key AS metric, e.value AS value FROM (SELECT name, unnest(map_entries(overall)) AS e FROM ablation_cell WHERE name IS NOT NULL)"""
)
def cell_metrics(spark, d):
    cells = table(spark, d, "ablation_cell").where("name is not null")
    return cells.select("name", F.explode("overall").alias("metric", "value"))
