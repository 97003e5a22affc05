"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.tables import table
from . import abuse, canonical, consensus, encoding, langid, leakage, pairs, ranking, similar, splitting

LABELS = ["SUPPORTED", "NOT_FOUND", "NO_CLAIM", "CONTRADICTED"]


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The public vocabulary file; TESSERA_TOKENIZERS names another folder."""
    folder = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, name)


def _language_model(spark: SparkSession, d: str) -> langid.LanguageModel:
    return langid.fit_on([
        (table(spark, d, "source_docs"), "doc_id", "content", "metadata.lang"),
        (table(spark, d, "golden_draft"), "query_id", "query", "lang"),
    ])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a defect."""
    turns = table(spark, d, "feedback_turn").select("answer_message_id", "question")
    found = pairs.defects(turns, table(spark, d, "message").select("id", "content"), _language_model(spark, d))
    return found.where("defect is not null")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents longer than each chunk size, and those with a run that no boundary can divide."""
    report = splitting.split_report(table(spark, d, "source_docs"), "doc_id", "content", splitting.settings_of(table(spark, d, "ablation_cell")))
    kinds = F.array(F.when(F.col("pieces") > 1, F.lit("split")), F.when((F.col("run") > F.col("chunk_size")) & (F.col("forced") > 0), F.lit("forced")))
    rows = report.select("doc_id", "chunk_size", F.explode(kinds).alias("kind"))
    return rows.where("kind is not null").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document for each setting, without its text."""
    settings = splitting.settings_of(table(spark, d, "ablation_cell"))
    docs = table(spark, d, "source_docs").select("doc_id", "content")
    return splitting.split_texts(docs, "doc_id", "content", settings).drop("content").distinct()


def _votes(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        consensus.usable_votes(table(spark, d, "faith_sealed"), "ref", F.concat(F.lit("judge:"), "judge_model"), "judge_label", LABELS),
        consensus.usable_votes(table(spark, d, "faith_human"), "ref", F.concat(F.lit("human:"), "annotator"), "gold", LABELS, "labelled_at"),
        consensus.usable_votes(table(spark, d, "faith_cross"), "ref", F.concat(F.lit("cross:"), "served_model"), "label", LABELS),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _refs(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.col("ref").alias("item")) for t in ("faith_sealed", "faith_human", "faith_cross")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("item is not null").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The consensus label of every ref."""
    fitted = consensus.Consensus(_votes(spark, d), LABELS)
    return fitted.labelled(_refs(spark, d)).select(F.col("item").alias("ref"), "label")


def p3_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of every annotator and judge model."""
    found = consensus.Consensus(_votes(spark, d), LABELS).annotators()
    return found.select("annotator", "votes", F.round("reliability", 6).alias("reliability"), F.round("kappa", 6).alias("kappa"))


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Chance-corrected agreement over all votes."""
    found = consensus.agreement(_votes(spark, d))
    return found.select("items", "votes", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")])


def _languages(spark: SparkSession, d: str) -> DataFrame:
    model = _language_model(spark, d)
    docs = langid.languages(table(spark, d, "source_docs"), "doc_id", "content", "metadata.lang", model, segments=True)
    drafts = langid.languages(table(spark, d, "golden_draft"), "query_id", "query", "lang", model, segments=False)
    return docs.withColumn("item", F.lit("doc")).unionByName(drafts.withColumn("item", F.lit("query")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Records with a missing or wrong language label, and the lines of documents of mixed language."""
    found = _languages(spark, d).where("lang is not null and (seg >= 0 or label is null or label <> lang)")
    return found.select("item", F.col("id").alias("item_id"), "seg", "lang").distinct()


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language, confidence and ambiguity of every record, and of every line of a mixed document."""
    found = _languages(spark, d).withColumn("confidence", F.round("confidence", 6))
    return found.select("item", F.col("id").alias("item_id"), "seg", "lang", "confidence", "ambiguous").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records that look the same and are stored with different characters."""
    docs = canonical.text_classes(table(spark, d, "source_docs"), "doc", "doc_id", "content")
    drafts = canonical.text_classes(table(spark, d, "golden_draft"), "query", "query_id", "query")
    return canonical.same_look_pairs(written(docs.unionByName(drafts)))  # four uses, one pass over the texts


def _similar(spark: SparkSession, d: str) -> similar.SimilarSets:
    drafts = table(spark, d, "golden_draft")
    return similar.SimilarSets(similar.word_sets(drafts, "query_id", "query", "category"), 0.7)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of drafts of one category that share at least 0.7 of their words."""
    return _similar(spark, d).pairs().toDF("query_id_a", "query_id_b")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class and group of every draft, with its class's links."""
    return _similar(spark, d).groups().select(F.col("id").alias("query_id"), F.col("scope").alias("category"), "class", "group", "links")


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk of every query-run with its closeness and place."""
    found = ranking.ideal_point_ranking(table(spark, d, "retrieved_chunk"), ["run_name", "query_id"], "chunk_id", ["dense_score", "sparse_score"])
    return found.withColumn("closeness", F.round("closeness", 9))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The chunk that ranks first in every query-run with a score."""
    found = ranking.ideal_point_ranking(table(spark, d, "retrieved_chunk"), ["run_name", "query_id"], "chunk_id", ["dense_score", "sparse_score"])
    return found.where("place = 1 and closeness is not null").select("run_name", "query_id", "chunk_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encoded(table(spark, d, "documents"), "doc_id", "text", tokenizer_path())


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of evaluation items."""
    fitted = leakage.finders(table(spark, d, "eval_item"), "item_id", "text")
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", fitted).select("doc_id", "item_id")


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """How much leaked text was cut from each document, and which documents fall away."""
    fitted = leakage.finders(table(spark, d, "eval_item"), "item_id", "text")
    return leakage.without_leaks(table(spark, d, "documents"), "doc_id", "text", fitted).where("removed > 0").drop("text")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    labels = abuse.reviewed(table(spark, d, "moderation_label"), docs, "doc_id", "toxic", "text", "lang")
    return abuse.scored(docs, "doc_id", "text", "lang", "source", abuse.fit(labels))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an abusive, hateful or sexually explicit sentence."""
    return _scored(spark, d).where("toxic").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, d).select("doc_id", F.round("score", 4).alias("score"), "toxic")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of such documents in each source."""
    return abuse.rates(_scored(spark, d)).select("source", "documents", "toxic", F.round("rate", 6).alias("rate"), F.round("score", 3).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_pieces, p3_found, p3_annotators, p3_agreement, p4_found, p4_languages, p5_found, p6_found, p6_groups, p7_found, p7_ranking, p8_ids, p9_found, p9_cleaned, p10_found, p10_scores, p10_rates)
}

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_RUN = "[^\\t\\n\\x{0B}\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_VOTE = "replace(trim(regexp_replace(upper({}), '[\\s\\p{{Z}}_\\-]+', ' ', 'g')), ' ', '_')"
_LABELS = "('SUPPORTED', 'NOT_FOUND', 'NO_CLAIM', 'CONTRADICTED')"

# A form written for the checks alone, apart from the operator's tables: invisible characters go, widths, spaces and
# look-alike letters are mapped, NFC composes, and a shape under a tone is put first.
_GONE = "[\\x{AD}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]"
_WIDTHS = "concat(" + ", ".join(f"chr({0xFF01 + i})" for i in range(94)) + ")", "concat(" + ", ".join(f"chr({0x21 + i})" for i in range(94)) + ")"
_LETTERS = "concat('АВЕІЈКМНОРСТУХаеорсухіјѕԁһԛԝӏ', 'ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο', 'ɑɡÐƉ', '‐‑ʼ', chr(160), chr(8239), chr(8287), chr(12288), " + ", ".join(f"chr({c})" for c in range(0x2000, 0x200B)) + ")"
_PLAIN = "concat('ABEIJKMHOPCTYXaeopcyxijsdhqwl', 'ABEZHIKMNOPTYXo', 'agĐĐ', '--’', repeat(' ', 15))"
_SEEN = f"nfc_normalize(translate(translate(regexp_replace(COLUMN, '{_GONE}', '', 'g'), {_WIDTHS[0]}, {_WIDTHS[1]}), {_LETTERS}, {_PLAIN}))"


def _form(column: str) -> str:
    tones = "".join(map(chr, (0x300, 0x301, 0x303, 0x309)))
    ordered = f"regexp_replace(SEEN, '([{tones}])([\\x{{323}}]?)([\\x{{302}}\\x{{306}}])', '\\3\\2\\1', 'g')".replace("SEEN", _SEEN.replace("COLUMN", column))
    late = f"nfc_normalize({ordered})"
    for shape in (0x302, 0x306):
        for letter in ("aeoAEO" if shape == 0x302 else "aA"):
            for tone in tones:
                late = f"replace({late}, concat(nfc_normalize('{letter}{tone}'), chr({shape})), nfc_normalize(concat('{letter}', chr({shape}), '{tone}')))"
    return late


#: Only for operators that SQL can say, over whole tables, in good time; the others have tests against brute force,
#: round trips or held-out accuracy.
ORACLES: dict[str, str] = {
    "p2_found": f"""WITH d AS (SELECT DISTINCT doc_id, content FROM source_docs WHERE content IS NOT NULL), s AS (SELECT DISTINCT chunk_size FROM ablation_cell WHERE chunk_size IS NOT NULL),
        r AS (SELECT doc_id, length(content) AS n, list_max(list_transform(regexp_extract_all(content, '{_RUN}'), lambda x: length(x))) AS run FROM d)
        SELECT DISTINCT doc_id, chunk_size, 'split' AS kind FROM r, s WHERE n > chunk_size UNION SELECT doc_id, chunk_size, 'forced' FROM r, s WHERE run > chunk_size""",
    "p3_agreement": f"""WITH v AS (SELECT ref, 'j' || judge_model AS who, {_VOTE.format('judge_label')} AS label, NULL::TIMESTAMPTZ AS seen FROM faith_sealed UNION ALL SELECT ref, 'h' || annotator, {_VOTE.format('gold')}, labelled_at FROM faith_human
        UNION ALL SELECT ref, 'c' || served_model, {_VOTE.format('label')}, NULL FROM faith_cross),
        u AS (SELECT ref, label FROM v WHERE ref IS NOT NULL AND who IS NOT NULL AND label IN {_LABELS} QUALIFY row_number() OVER (PARTITION BY ref, who ORDER BY seen DESC NULLS LAST, label DESC) = 1),
        c AS (SELECT ref, label, count(*) AS n FROM u GROUP BY ALL), p AS (SELECT ref, sum(n) AS m, sum(n * (n - 1)) AS same FROM c GROUP BY ref HAVING m > 1),
        e AS (SELECT label, sum(n) AS n FROM c WHERE ref IN (SELECT ref FROM p) GROUP BY label),
        t AS (SELECT count(*) AS items, sum(m)::BIGINT AS votes, sum(same / (m - 1)) / sum(m) AS o FROM p), x AS (SELECT sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) AS e FROM e)
        SELECT items, votes, round(o, 9) AS observed, round(e, 9) AS expected, round(1 - (1 - o) / (1 - e), 9) AS alpha FROM t, x""",
    "p5_found": f"""WITH r AS (SELECT DISTINCT 'doc' AS item, doc_id AS id, content AS t FROM source_docs WHERE content IS NOT NULL UNION SELECT DISTINCT 'query', query_id, query FROM golden_draft WHERE query IS NOT NULL),
        f AS (SELECT item, id, t, {_form('t')} AS form FROM r)
        SELECT DISTINCT a.item, a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.item = b.item AND a.form = b.form AND a.id < b.id AND a.t <> b.t WHERE regexp_matches(a.form, '[^[:space:]]')""",
    "p6_found": f"""WITH r AS (SELECT DISTINCT query_id AS id, coalesce(category, '') AS scope, list_distinct({_WORDS.format(_form('query'))}) AS w FROM golden_draft WHERE query IS NOT NULL AND regexp_matches({_form('query')}, '[^[:space:]]'))
        SELECT a.id AS query_id_a, b.id AS query_id_b FROM r a JOIN r b ON a.scope = b.scope AND a.id < b.id WHERE len(list_intersect(a.w, b.w)) >= 0.7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-12""",
    "p7_found": """WITH k AS (SELECT run_name, query_id, chunk_id, max(CASE WHEN NOT isnan(dense_score) THEN dense_score END) AS d, max(CASE WHEN NOT isnan(sparse_score) THEN sparse_score END) AS s FROM retrieved_chunk
        WHERE run_name IS NOT NULL AND query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY run_name, query_id ORDER BY d DESC NULLS LAST, chunk_id) AS rd, row_number() OVER (PARTITION BY run_name, query_id ORDER BY s DESC NULLS LAST, chunk_id) AS rs, count(d) OVER w AS nd, count(s) OVER w AS ns FROM k WINDOW w AS (PARTITION BY run_name, query_id))
        SELECT run_name, query_id, chunk_id FROM r WHERE (nd > 0 AND ns > 0 AND rd <= 2 AND rs <= 2 AND d IS NOT NULL AND s IS NOT NULL) OR (ns = 0 AND nd > 0 AND rd = 1) OR (nd = 0 AND ns > 0 AND rs = 1)""",
    "p9_found": f"""WITH i AS (SELECT item_id, {_WORDS.format(_form('text'))} AS w FROM eval_item WHERE text IS NOT NULL), g AS (SELECT item_id, array_to_string(w[k + 1 : k + 12], ' ') AS p FROM (SELECT item_id, w, unnest(range(0, len(w) - 11)) AS k FROM i)),
        d AS (SELECT doc_id, {_WORDS.format(_form('text'))} AS w FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, array_to_string(w[k + 1 : k + 12], ' ') AS p FROM (SELECT doc_id, w, unnest(range(0, len(w) - 11)) AS k FROM d))
        SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (p)""",
}
