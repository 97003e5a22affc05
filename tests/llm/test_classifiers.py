"""Languages, answer defects and abuse: held-out accuracy and rules."""

import os
import random
from hashlib import md5

import numpy as np
import pytest

from tessera.llm import abuse, langid, pairs
from tessera.llm.canonical import Canonical
from tessera.llm.queries import _language_model

DATA = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.01"

EN = "the ministry reported that the new road had a modest effect on local income and prices".split()
VI = "bộ chủ quản cho biết con đường mới có tác động khiêm tốn đến thu nhập và giá cả".split()
FR = "le ministère a indiqué que la nouvelle route avait eu un effet modeste sur les revenus".split()


@pytest.fixture(scope="module")
def model(spark):
    return _language_model(spark, DATA)


def test_held_out_lines(model):
    assert model.judged(model.rows(" ".join(EN)))[0] == "en"
    assert model.judged(model.rows(" ".join(VI)))[0] == "vi"
    assert model.judged(model.rows(" ".join(FR)))[0] == "fr"
    assert model.judged(model.rows(langid.without_accents(" ".join(VI))))[0] == "vi"
    assert model.judged(model.rows(" ".join(EN + VI)))[0] == "mixed"
    assert model.judged(model.rows("")) == (None, 0.0, True)


def test_codewords_are_apart():
    code = langid.codewords(4)
    assert code.shape == (4, 7) and min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) == 4


def test_language_rows(spark, model):
    both = " ".join(EN) + ".\n\n" + " ".join(VI) + "."
    rows = [("a", " ".join(EN), "en_GB"), ("b", " ".join(VI), None), ("c", both, "en"), ("d", None, "en"), ("e", " ", "en"), ("f", "123", "und"), (None, "x", "en")]
    df = spark.createDataFrame(rows, "id string, t string, lang string")
    got = {(r.id, r.seg): (r.lang, r.label) for r in langid.languages(df, "id", "t", "lang", model, True).collect()}
    assert got == {("a", -1): ("en", "en"), ("b", -1): ("vi", None), ("c", -1): ("mixed", "en"), ("c", 0): ("en", "en"), ("c", 2): ("vi", "en"), ("f", -1): (None, None)}
    assert langid.languages(df.limit(0), "id", "t", "lang", model, True).count() == 0


def test_encoded_runs_are_no_language(model):
    r = random.Random(1)
    noise = "".join(r.choice("abcXYZ/+9") for _ in range(900))
    assert model.judged(model.rows(" ".join(EN) + " " + noise))[0] == "en"


def test_endings():
    closed = ["A b.", "A b [1]", "A b [1].", "| a | b |", "x\n```json\n[]\n```", "Really?", "a “b.”"]
    opened = ["A b", "A b,", "x\n```json\n[", "- item one\n- item", "| a | b", "Text. Article 12.", "The value was 43.5%"]
    assert {pairs.ending(t) for t in closed} == {"closed"} and {pairs.ending(t) for t in opened} == {"open"}
    assert pairs.ending("45.4%") == pairs.ending("Yes") == "short"


def test_refusals():
    yes = ["I cannot help with that.", "Xin lỗi, tôi không thể trả lời câu hỏi này. Bạn cần gì thêm không?", "The sources hold no answer to it [1].", "None of the passages mention Huế. I will leave this one unanswered.", "Je ne peux pas répondre."]
    no = ["Although the bank could not provide data for Huế, the value elsewhere was 5%.", "Sorry for the long list: the main cause was trade.", "The figure is not given, but the report puts it at 3%.", "I cannot say for 2019. In 2020 it was 5%."]
    assert all(map(pairs.is_refusal, yes)) and not any(map(pairs.is_refusal, no))


def test_copies():
    q = "what is it".split()
    for a in (q, q + q, ["question", *q], ["what", "really", "is", "it"], [*q, "now"]):
        assert pairs.is_copy(q, a)
    for a in (q[:2], [*q, "a", "b"], ["x", "is", "it"], []):
        assert not pairs.is_copy(q, a)
    assert not pairs.is_copy([], ["a"])


def test_shortened_neighbours_across_parts(spark):
    whole = [f"{c}{i} begins here and goes on to a full end." for c in "abcdefgh" for i in range(40)]
    cut = [t[:20] for t in whole[::7]]
    rows = [(md5(t.encode()).hexdigest(), t) for t in whole + cut + ["", cut[0]]]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    df = spark.createDataFrame(rows, "key string, form string").repartition(5)
    assert {r.key for r in pairs.shortened(df).collect()} == {md5(t.encode()).hexdigest() for t in cut}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_shortened_is_the_same_for_any_number_of_parts(spark):
    texts = ["It is a wor", "It is a word.", "See rule 5.", "See rule 5. It holds.", "See rule 5.3 for the fee.", "It ends.", "It ends. Then more.", "It ends. Then other."]
    texts += [f"Item {n} costs 3.{rest}" for n in range(10, 40) for rest in ("", " More", " More still.", "5 million.")]
    texts += ["x" * 80, "x" * 90, "x" * 80 + ".", "x" * 80 + ". y", "x" * 80 + ".5"]
    want = {t for t in texts if any(pairs.goes_on(t, other) for other in texts)}
    assert "See rule 5." in want and "Item 10 costs 3." in want and "It ends." not in want
    df = spark.createDataFrame([(md5(t.encode()).hexdigest(), t) for t in texts], "key string, form string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in (1, 2, 16, 150):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            assert {r.key for r in pairs.shortened(df).collect()} == {md5(t.encode()).hexdigest() for t in want}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_defects(spark, model):
    q = "What did the ministry report about the new road"
    turns = [(str(i), q) for i in range(9)] + [("0", q), ("10", q), ("none", q), (None, q), ("9", None)]
    answers = {
        "0": None, "1": " [1] ", "2": q.upper() + "?", "3": "I cannot answer this.", "4": " ".join(EN), "5": " ".join(VI).capitalize() + ".",
        "6": " ".join(EN).capitalize() + ".", "10": "You asked me this: " + q, "7": "45.4%", "8": "", "9": " ".join(EN).capitalize() + ".",
    }
    got = pairs.defects(spark.createDataFrame(turns, "answer_message_id string, question string"), spark.createDataFrame([*answers.items(), ("3", answers["3"])], "id string, content string"), model)
    assert {r.answer_message_id: r.defect for r in got.collect()} == {
        "0": "empty", "1": "empty", "2": "copy", "3": "refusal", "4": "truncated", "5": "other_language", "6": None, "7": None, "8": "empty", "9": None, "10": "copy",
    }


def test_spellings_meet():
    assert abuse.spelled_out("you i d i o t now") == "you idiot now"
    assert abuse.words_of("i.d.i.o.t") == ["idiot"] and abuse.words_of("14,5%") == ["#", "#"]
    assert set(abuse.features("1diot")) & set(abuse.features("idiot")) and set(abuse.features("iiidiot")) & set(abuse.features("idiot"))


def test_abuse_on_held_out_text(spark):
    r = random.Random(2)
    bad = ["you stupid {} liar", "go away you {} fool", "hit the {} liar again", "that {} fool is worthless"]
    good = ["the {} report was published", "prices of {} rose in the region", "a {} study of fools gold mining", "the {} office counted households"]
    names = [f"n{i}" for i in range(60)]

    def doc(toxic):
        lines = [r.choice(good).format(r.choice(names)) + "." for _ in range(r.randint(2, 6))]
        if toxic:
            lines.insert(r.randrange(len(lines)), r.choice(bad).format(r.choice(names)) + "!")
        return " ".join(lines)

    rows = [(doc(i % 2), i % 2, "en") for i in range(400)]
    noisy = [(t, 1 - x if r.random() < 0.05 else x, lang) for t, x, lang in rows]
    model = abuse.fit(noisy)
    test = [(doc(i % 2), i % 2) for i in range(200)]
    marked = model.scores([t for t, _ in test]) >= model.threshold("en")
    assert (marked == np.array([x for _, x in test], bool)).mean() > 0.97
    df = spark.createDataFrame([(1, test[1][0], "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, test[0][0], "xx", "s")], "doc_id bigint, text string, lang string, source string")
    got = {x.doc_id: x for x in abuse.scored(df, "doc_id", "text", "lang", "source", model).collect()}
    assert got[1].toxic and not got[2].toxic and got[2].score == 0 and not got[3].toxic and not got[4].toxic
    rates = {x.source: (x.documents, x.toxic) for x in abuse.rates(abuse.scored(df, "doc_id", "text", "lang", "source", model)).collect()}
    assert rates == {"s": (3, 1), None: (1, 0)}
    assert abuse.scored(df.limit(0), "doc_id", "text", "lang", "source", model).count() == 0


def test_abuse_without_labels():
    model = abuse.fit([("some text", 0, "en")])
    assert (model.scores(["a", None, ""]) < model.threshold("en")).all()


def test_canonical_before_judging(model):
    assert model.judged(model.rows(Canonical()(["​".join(" ".join(EN))])[0]))[0] == "en"


def test_short_sentence_amid_stronger_words_is_mixed():
    model = object.__new__(langid.LanguageModel)
    strong, weak = np.zeros((20, len(langid.LANGS))), np.zeros((5, len(langid.LANGS)))
    strong[:, 0], weak[:, 1] = 8.0, 6.0
    rows = np.concatenate((strong, weak, strong))
    assert model.judged(rows)[0] == langid.MIXED
    assert model.judged(strong)[0] == langid.LANGS[0] and model.judged(rows[16:25])[0] == langid.LANGS[0]
