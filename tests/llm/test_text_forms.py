"""Canonical form, encoding, splitting and leakage."""

import random
import unicodedata

import pytest

from tessera.llm import canonical, encoding, leakage, splitting
from tessera.llm.automaton import SuffixAutomaton
from tessera.llm.queries import tokenizer_path

FORM = canonical.Canonical()


def test_look_alikes_become_equal_and_visible_differences_stay():
    same = {
        "Tỷ lệ": ["Tỷ lệ", "Ｔỷ lệ", "T​ỷ　lệ", "Τỷ lệ", "Tỷ lệ﻿"],
        "Đà Nẵng": ["Ðà Nẵng", "Ɖà Nẵng"],
        "ế": ["ế", "é̂", "é̂", "ế"],
        "ậ": ["ậ", "ậ", "ậ"],
        "report": ["rероrt", "ｒｅｐｏｒｔ"],
        "fi": ["ﬁ"],
    }
    for plain, others in same.items():
        assert FORM([plain, *others]) == [plain] * (len(others) + 1)
    visible = ["km²", "km2", "A", "a", "co", "cô", "a b", "a  b", "x.", "x", "1", "l", "–", "-", "½"]
    assert len(set(FORM(visible))) == len(visible)
    assert FORM([None, "", " ", "a\nb"]) == [None, "", " ", "a\nb"]


def test_form_is_stable_on_random_text():
    r = random.Random(4)
    alphabet = "".join(canonical.COMMON) + "".join(canonical.SEVERAL) + "".join(canonical.SINGLE)[::9] + "aeoAEOuUyY" + canonical.TONES + "̛̣̂̆" + " \n"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(400)]
    once = FORM(texts)
    assert FORM(once) == once
    assert all(unicodedata.normalize("NFC", t) == t for t in once)


def test_canonical_column_keeps_clashing_columns(spark):
    df = spark.createDataFrame([("k", "ａ", 1), (None, None, 2)], "form string, given_text string, k0 int")
    got = canonical.canonical_form(df, "given_text", "form").orderBy("k0").collect()
    assert [tuple(r) for r in got] == [("ａ", 1, "a"), (None, 2, None)]
    assert canonical.canonical_form(df.limit(0), "given_text").count() == 0


def test_pairs_that_look_the_same(spark):
    rows = [("b", "a b"), ("a", "a b"), ("c", "a b"), ("c", "a b"), ("d", "A b"), ("e", None), ("f", " "), ("g", " "), (None, "a b"), ("h", "​")]
    df = spark.createDataFrame(rows, "id string, t string")
    pairs = canonical.same_look_pairs(canonical.text_classes(df, "x", "id", "t"))
    assert sorted(map(tuple, pairs.collect())) == [("x", "a", "b"), ("x", "a", "c")]
    assert canonical.same_look_pairs(canonical.text_classes(df.limit(0), "x", "id", "t")).count() == 0


def test_automaton_against_substrings():
    r = random.Random(5)
    for _ in range(60):
        texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(3)]
        a = SuffixAutomaton(texts)
        probe = "".join(r.choice("abc") for _ in range(12))
        state = matched = 0
        for i, c in enumerate(probe, 1):
            state, matched = a.step(state, matched, c)
            want = max(n for n in range(i + 1) if any(probe[i - n : i] in t for t in texts) or n == 0)
            assert matched == want


@pytest.fixture(scope="module")
def encoder():
    return encoding.Encoder(encoding.compiled(encoding.vocabulary(tokenizer_path())))


def test_encoding_is_that_of_the_reference_libraries(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = encoding.vocabulary(tokenizer_path())
    exact = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    parts = ["the", " and", "Tỷ", " lệ", "é", "漢", "  ", "\n\n", "\t", "12", "'s", "...", "😀", "x" * 40, " ", "\x1c", "<|endoftext|>", "ing", "á"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["ab" * 5000, "z" * 20000, "", " "]
    assert [encoder(t) for t in texts] == [exact.encode_ordinary(t) for t in texts]
    assert encoder(None) == []


def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 7), (3, "", 7), (1, "a b", 7)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in encoding.encoded(df, "doc_id", "text", tokenizer_path()).collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert encoding.encoded(df.limit(0), "doc_id", "text", tokenizer_path()).count() == 0


def test_pieces_fit_overlap_and_cover():
    r = random.Random(7)
    for _ in range(300):
        text = "".join(r.choice(["word ", "s. ", "\n", "\n\n", "# H\n", "x" * r.randint(1, 90), " ", "é́"]) for _ in range(r.randint(0, 90)))
        size = r.randint(10, 80)
        overlap = r.randint(0, size // 2)
        bounds = splitting.Boundaries(text)
        made = splitting.pieces(bounds, size, overlap)
        assert made[0][0] == 0 and made[-1][1] == len(text)
        assert all(b - a <= size for a, b, _ in made)
        for before, after in zip(made, made[1:], strict=False):
            assert after[0] == before[1] - overlap and after[1] > before[1]
        if bounds.longest > size:
            assert any(kind == 0 for *_, kind in made[1:])
        if len(text) <= size:
            assert len(made) == 1


def test_strongest_boundary_wins():
    text = "aaaa bbbb. cccc dddd\n\neeee ffff. gggg hhhh"
    assert [text[a:b] for a, b, _ in splitting.pieces(splitting.Boundaries(text), 30, 0)] == ["aaaa bbbb. cccc dddd\n\n", "eeee ffff. gggg hhhh"]


def test_split_rows(spark):
    df = spark.createDataFrame([("a", "x" * 50), ("b", None), (None, "y"), ("c", ""), ("a", "x" * 50)], "id string, t string")
    rows = splitting.split_report(df, "id", "t", [(20, 5), (100, 0)]).collect()
    assert sorted((r.doc_id, r.chunk_size, r.pieces, r.forced) for r in rows) == [("a", 20, 4, 3), ("a", 20, 4, 3), ("a", 100, 1, 0), ("a", 100, 1, 0), ("c", 20, 1, 0), ("c", 100, 1, 0)]
    made = splitting.split_texts(df, "id", "t", [(20, 5)]).where("doc_id = 'a'").dropDuplicates(["piece"]).orderBy("piece").collect()
    assert made[0].cut == "start" and made[1].cut == "forced" and all(len(r.content) <= 20 for r in made)
    cells = spark.createDataFrame([(400, 20), (400, 20), (None, None), (800, None), (0, 1)], "chunk_size int, chunk_overlap int")
    assert splitting.settings_of(cells) == [(400, 20), (800, 0)]


def test_passages_against_word_windows():
    r = random.Random(8)
    items = [(i, " ".join(f"w{r.randint(0, 5)}" for _ in range(r.randint(3, 30)))) for i in range(12)]
    finder = leakage.PassageFinder(items, 5)
    for _ in range(150):
        words = [f"w{r.randint(0, 6)}" for _ in range(60)]
        start = r.choice(items)[1].split()
        words[10:10] = start[: r.randint(0, len(start))]
        text = ", ".join(words)
        windows = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        want = {i for i, t in items for j in range(len(t.split()) - 4) if tuple(t.split()[j : j + 5]) in windows}
        assert set(finder.items(text)) == want


def test_leaks_ignore_case_marks_and_look_alikes(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([(1, passage), (2, passage), (3, "too short"), (4, None), (None, passage)], "item_id bigint, text string")
    near = " ".join(passage.split()[:11]) + " gap"
    rows = [(1, "Pre. " + passage.upper().replace(" ", ",\n")), (2, near), (3, None), (4, ""), (5, passage.replace("o", "о").replace(" ", " ")), (1, passage), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    fitted = leakage.finders(items, "item_id", "text")
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaks(docs, "doc_id", "text", fitted).collect()) == [(1, 1), (1, 2), (5, 1), (5, 2)]
    clean = {r.doc_id: r for r in leakage.without_leaks(docs.where("doc_id <> 1"), "doc_id", "text", fitted).collect()}
    assert clean[5].dropped == 1 and clean[5].text is None and clean[2].removed == 0 and clean[3].text is None
    longer = spark.createDataFrame([(9, "keep this " + passage + ". and this " + "x " * 40)], "doc_id bigint, text string")
    kept = leakage.without_leaks(longer, "doc_id", "text", fitted).first()
    assert kept.text.startswith("keep this . and this") and kept.removed == 13
    parts = leakage.finders(items, "item_id", "text", block=10)
    assert len(parts) > 1
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaks(docs, "doc_id", "text", parts).collect()) == [(1, 1), (1, 2), (5, 1), (5, 2)]
    empty = leakage.finders(items.limit(0), "item_id", "text")
    assert leakage.leaks(docs, "doc_id", "text", empty).count() == 0


def test_cleaned_text_is_as_stored(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    stored = "Это \u200dмир, می\u200cخواهم \uff21. " + passage.replace("e", "\u0435").replace(" ", "\u00a0") + "! Đà Nẵng e\u0301 ℃ №5 " + "filler " * 40
    docs = spark.createDataFrame([(1, stored), (2, None), (3, "")], "doc_id bigint, text string")
    fitted = leakage.finders(spark.createDataFrame([(1, passage)], "item_id bigint, text string"), "item_id", "text")
    got = {r.doc_id: r for r in leakage.without_leaks(docs, "doc_id", "text", fitted).collect()}
    assert got[1].text == stored[: stored.index("on\u0435")] + stored[stored.index("! Đà") :] and got[1].removed == 13 and got[1].dropped == 0
    assert got[2].text is None and got[2].dropped == 0 and got[3].text == ""
