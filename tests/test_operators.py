import random
from math import comb, log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunk as C
from tessera.operators import curate as K
from tessera.operators import gate as G
from tessera.operators import metrics as M
from tessera.operators import ops as O
from tessera.operators import retrieve as R
from tessera.operators import stats as S


def test_dense_top_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 10)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(4)
    got = R.dense_top(df.where("id % 7 = 0"), df, 5).collect()

    def cos(a, b):
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 9) if na and nb else 0.0

    for q, v in rows:
        if q % 7 == 0 and v is not None:
            want = sorted(((-cos(v, w), i) for i, w in rows if w is not None))[:5]
            assert [(x.item_id) for x in sorted(got, key=lambda x: x.rank) if x.query_id == q] == [i for _, i in want]


def test_cosine_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "JOIN_BLOCK", 20)
    monkeypatch.setattr(R, "JOIN_STRIP", 7)
    r = random.Random(5)
    rows = [(i, "ab"[i % 2], [r.gauss(0, 1) for _ in range(4)]) for i in range(150)]
    rows += [(150, "a", [0.0] * 4), (151, "a", None), (152, None, [1.0] * 4), (153, "a", [2 * x for x in rows[4][2]])]
    df = spark.createDataFrame(rows, "id bigint, s string, v array<double>").repartition(4)
    got = [(x.id_a, x.id_b) for x in R.cosine_pairs(df, 0.6).collect()]

    def cos(a, b):
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 9) if na and nb else 0.0

    full = [x for x in rows if x[1] and x[2]]
    want = {(i, j) for i, s, v in full for j, s2, w in full if i < j and s == s2 and cos(v, w) >= 0.6}
    assert len(got) == len(set(got)) and set(got) == want and (4, 153) in want
    assert any(i % 100 for i, _ in want)


def test_cache_needs_similarity_and_equal_digits(spark):
    rows = [(1, "a", [1.0, 0.0], ["5"]), (2, "a", [2.0, 0.1], ["5"]), (3, "a", [1.0, 0.0], ["6"]), (4, "b", [1.0, 0.0], ["5"]), (5, "a", [0.0, 1.0], ["5"]), (6, "a", [0.0, 0.0], ["5"])]
    df = spark.createDataFrame(rows, "id int, space string, v array<double>, guard array<string>")
    got = {r.query_id: r.found for r in R.cached(df, df).collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: None, 5: None, 6: None}


def test_token_report(spark):
    rows = [("vi", n, 3 * n) for n in range(1, 41)] + [("en", n, 5 * n) for n in (10, 20, 30)] + [("en", 0, 7)]
    df = spark.createDataFrame(rows, "lang string, n int, chars int").repartition(3)
    got = {(r.overall, r.lang): r for r in M.token_report(df, 30, 2, 10).collect()}
    vi, en, both = got[False, "vi"], got[False, "en"], got[True, None]
    assert (vi.p50, vi.p95, vi.longest, vi.truncated, vi.budget, vi.suggested) == (21, 38, 40, 10, 84, 64)
    assert (en.p50, en.density_p05, en.budget, en.suggested, en.truncated) == (20, 5.0, 140, 120, 0)
    assert both.texts == 44 and both.safe == 64 and both.density_p05 == 3.0


def test_fusion_ties_and_errors(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, item_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "x", 2)], "query_id string, item_id string, rank int")
    got = R.fused([a, b]).orderBy("rank").collect()
    assert [r.item_id for r in got] == ["x", "y"] and got[0].best == 1 and got[0].lists == 2
    assert R.fused([a, b], limit=1).count() == 1
    with pytest.raises(ValueError):
        R.fused([a], k=-1)
    with pytest.raises(ValueError, match="unknown filter"):
        R.metadata_filter({"colour": 1}, {})
    with pytest.raises(ValueError, match="empty"):
        R.metadata_filter({"lang": []}, {"lang": F.lit("vi")})
    assert R.tenant_view(a.withColumn("tenant_id", F.lit("t")), None).count() == 0


def test_metrics_of_labelled_and_unlabelled_queries(spark):
    hits = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 3), ("c", "x", 1)], "q string, item_id string, rank int")
    gold = spark.createDataFrame([("a", ["y", "w", "y"]), ("b", ["x"]), ("c", [])], "q string, relevant array<string>")
    got = {r.q: r for r in M.query_metrics(hits, gold, ["q"]).collect()}
    assert got["a"].recall_5 == 0.5 and got["a"].precision_5 == 0.2 and got["a"].mrr == 0.5
    assert got["a"].ndcg_10 == pytest.approx((1 / log2(3)) / (1 + 1 / log2(3)))
    assert got["a"].map_20 == pytest.approx(0.25)
    assert got["b"].mrr == 0 and got["b"].n_returned == 0
    assert got["c"].mrr is None and got["c"].n_relevant == 0


def test_mcnemar_is_exact(spark):
    df = spark.createDataFrame([(b, w) for b in range(9) for w in range(9)], "b int, w int")
    for r in df.select("b", "w", S.mcnemar(F.col("b"), F.col("w")).alias("p")).collect():
        n, top = r.b + r.w, max(r.b, r.w)
        want = 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, k) for k in range(top, n + 1)) / 2**n)
        assert r.p == pytest.approx(want)


def test_resamples_fill_the_tails(spark, monkeypatch):
    from statistics import NormalDist

    w = S.poisson_weights(np.array([-5, 7, 2**62]), 20_000)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and np.abs(np.corrcoef(w) - np.eye(3)).max() < 0.03
    r = random.Random(6)
    rows = [(f"q{i}", m, r.gauss(0.1, 1)) for i in range(400) for m in ("x", "y")]
    df = spark.createDataFrame(rows, "q string, metric string, diff double").repartition(4)
    asked = []
    sums = S.resample_sums
    monkeypatch.setattr(S, "resample_sums", lambda *a: asked.append(a[-1]) or sums(*a))
    got = {x.metric: x for x in S.intervals(df, F.col("q")).collect()}
    seeds = {x.q: x.h for x in df.select("q", F.xxhash64("q").alias("h")).collect()}
    z = NormalDist().inv_cdf(0.975)
    for m in ("x", "y"):
        own = [(q, v) for q, n, v in rows if n == m]
        weights = S.poisson_weights(np.array([seeds[q] for q, _ in own]), 10_000).astype(float)
        v = np.array([v for _, v in own])
        means = sorted((v @ weights / weights.sum(axis=0)).tolist())
        assert got[m].low == pytest.approx(means[250], abs=2e-6) and got[m].high == pytest.approx(means[9750], abs=2e-6)
        error = v.std() / len(v) ** 0.5
        assert abs(got[m].low - (v.mean() - z * error)) < 0.15 * error and abs(got[m].high - (v.mean() + z * error)) < 0.15 * error
    two = S.unpaired_interval(df, "metric", "x", "y", "diff", F.concat("metric", "q")).first()
    x, y = (np.array([v for _, n, v in rows if n == m]) for m in ("x", "y"))
    error = (x.var() / len(x) + y.var() / len(y)) ** 0.5
    assert abs(two.low - (x.mean() - y.mean() - z * error)) < 0.15 * error and abs(two.high - (x.mean() - y.mean() + z * error)) < 0.15 * error
    one = S.stratified_bootstrap(df.withColumn("w", F.lit(1.0)), "metric", "w", "diff", F.concat("metric", "q")).first()
    middle, error = (x.mean() + y.mean()) / 2, error / 2
    assert abs(one.low - (middle - z * error)) < 0.15 * error and abs(one.high - (middle + z * error)) < 0.15 * error
    assert asked == [10_000, 10_000, 5_120]


def test_kappa_and_unknown_label(spark):
    pairs = spark.createDataFrame([("x", "x", 2.0), ("x", "y", 1.0), ("y", "y", 3.0)], "a string, b string, weight double")
    got = S.agreement(S.confusion(pairs, ["x", "y"], "a", "b", "weight")).first()
    assert got.observed == pytest.approx(5 / 6, abs=1e-6) and got.kappa == pytest.approx(2 / 3, abs=1e-6)
    same = spark.createDataFrame([("x", "x", 2.0)], "a string, b string, weight double")
    assert S.agreement(S.confusion(same, ["x", "y"], "a", "b", "weight")).first().kappa is None
    with pytest.raises(Exception, match="unknown label"):
        S.confusion(same, ["y"], "a", "b", "weight").collect()


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False), (0.5, False), (2.0, True)], "s double, p boolean")
    assert M.auc(df.withColumn("g", F.lit(1)), "s", "p", "g").first().auc == pytest.approx(3.5 / 4)


def test_chunks_cover_and_fit():
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice(["word ", "longer ", "end. ", "\n", "\n\n", "x" * r.randint(1, 90), "é"]) for _ in range(r.randint(0, 120)))
        spans = C.recursive(text, 80, 20)
        assert all(0 < b - a <= 80 for a, b in spans)
        covered = set().union(*[range(a, b) for a, b in spans]) if spans else set()
        assert {i for i, c in enumerate(text) if not c.isspace()} <= covered


def test_structure_and_sections():
    text = "# A\nfoo\n## B\nbar\n# C\nbaz"
    found = C.headings(text)
    assert C.section_at(found, text.index("bar")) == ["A", "B"] and C.section_at(found, text.index("baz")) == ["C"]
    assert [text[a:b] for a, b in C.structured(text, 0, 100)] == ["# A\nfoo", "## B\nbar", "# C\nbaz"]
    assert C.semantic("One. Two.") == [(0, 9)] and C.semantic("  ") == []


def test_chunked_rows(spark):
    df = spark.createDataFrame([("a", "# T\n" + "w " * 900), ("b", None), ("c", " "), (None, "x")], "id string, t string")
    rows = C.chunked(df, "id", "t", "fixed", size=300, overlap=50).collect()
    assert {r.doc_id for r in rows} == {"a"} and rows[0].chunk_id == "a::00000" and rows[0].section == ["T"]
    family = C.parent_child(df, "id", "t", 200, 4).collect()
    assert all(r.parent_start <= r.start and r.end <= r.parent_end for r in family)
    assert len({r.chunk_id for r in family}) == len(family) == C.chunked(df, "id", "t", "family", size=200, factor=4).count()
    with pytest.raises(ValueError):
        C.chunked(df, "id", "t", "other")


def test_jaccard_against_brute_force(spark):
    r = random.Random(3)
    rows = [(f"i{n:03d}", "a" if n % 3 else "b", sorted({f"w{r.randint(0, 14)}" for _ in range(r.randint(0, 9))})) for n in range(150)]
    df = spark.createDataFrame(rows, "id string, scope string, tokens array<string>")
    got = {(x.id_a, x.id_b) for x in K.jaccard_pairs(df, 0.8).collect()}
    reps = {}
    for i, s, t in sorted(rows):
        if t:
            reps.setdefault((s, tuple(t)), i)
    want = set()
    items = [(i, s, set(t)) for (s, t), i in reps.items()]
    for i, s, t in items:
        for j, s2, t2 in items:
            if i < j and s == s2 and len(t & t2) >= 0.8 * len(t | t2) - 1e-12:
                want.add((i, j))
    assert got == want


def test_jaccard_members_against_all_records(spark):
    r = random.Random(4)
    rows = [(f"i{n % 140:03d}", "a" if n % 3 else "b", sorted({f"w{r.randint(0, 9)}" for _ in range(r.randint(0, 6))})) for n in range(150)]
    rows += rows[:5] + [("i000", "a", ["w1", "w2"]), ("i001", "b", ["w2", "w1"]), ("i002", "a", ["w1", "w2"])]
    df = spark.createDataFrame(rows, "id string, scope string, tokens array<string>")
    records = {(i, s, tuple(sorted(t))) for i, s, t in rows}
    want = []
    for i, s, t in records:
        own = sorted(j for j, s2, u in records if s2 == s and u == t) if t else [i]
        links = sum((j, u) != (i, t) and s2 == s and bool(t) and bool(u) and len({*t} & {*u}) >= 0.8 * len({*t} | {*u}) - 1e-12 for j, s2, u in records)
        want.append((i, s, own[0], len(own), links))
    got = K.jaccard_members(df, 0.8).collect()
    assert sorted((x.id, x.scope, x.representative, x.members, x.links) for x in got) == sorted(want)
    assert any(x.members > 1 for x in got)
    scoped = spark.createDataFrame([("x", "a", ["p"] * 1), ("x", "b", ["q", "r", "s", "t"]), ("y", "b", ["q", "r", "s", "t", "u"])], "id string, scope string, tokens array<string>")
    assert [tuple(x) for x in K.jaccard_pairs(scoped, 0.8).collect()] == [("x", "y", 0.8, "b")]


def test_upsert_and_changes(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    fresh = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = K.upserted(store, fresh, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, K.upserted(once, fresh, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert dict(map(tuple, K.snapshot_changes(store, fresh, "id", "v").collect())) == {1: "removed", 2: "changed", 3: "added"}


def test_questions_go_by_key_first(spark):
    rows = [
        ("u1", "c", "user", 1, None), ("u2", "c", "user", 2, None), ("a1", "c", "assistant", 3, "u1"), ("a2", "c", "assistant", 4, "u2"),
        ("a3", "c", "assistant", 5, None), ("a4", "c", "assistant", 6, "gone"), ("a5", "d", "assistant", 1, None), ("a6", None, "assistant", 1, "u1"),
        ("a7", None, "assistant", 9, None), ("a8", "e", "assistant", 7, None), ("z9", "e", "user", 7, None), ("u0", "e", "user", 7, None), ("a9", "e", "assistant", 6, None), ("a1", "c", "assistant", 3, "u1"),
    ]
    df = spark.createDataFrame(rows, "id string, conversation_id string, role string, created_at int, user_message_id string").repartition(4)
    got = O.questions(df).collect()
    want = {"a1": "u1", "a2": "u2", "a3": "u2", "a4": None, "a5": None, "a6": "u1", "a7": None, "a8": "z9", "a9": None}
    assert len(got) == len(want) and {r.id: r.question_id for r in got} == want


def test_token_bucket_and_breaker(spark):
    times = [("u", float(t), i) for i, t in enumerate([0, 1, 2, 3, 30, 31, 90])] + [("v", 0.0, 9)]
    df = spark.createDataFrame(times, "u string, s double, i int")
    got = {(r.u, r.i): r.allowed for r in O.token_bucket(df, "u", "s", ["s"], per_minute=2, burst=2).collect()}
    assert [got["u", i] for i in range(7)] == [True, True, False, False, True, False, True] and got["v", 9]
    events = [("u", (float(t), f), i) for i, (t, f) in enumerate([(0, True), (1, True), (2, None), (3, True), (4, False), (40, False), (41, True)])]
    df = spark.createDataFrame(events, "u string, e struct<at:double,failed:boolean>, i int")
    states = {r.i: r.state for r in O.circuit_breaker(df, "u", "e", ["i"]).collect()}
    assert [states[i] for i in range(7)] == ["closed", "closed", "closed", "closed", "open", "probe", "closed"]


def test_versions():
    versions = ["1.0.0", "1.0.0-rc.1", "1.0.0-alpha", "1.0.0-rc.10", "0.9.9"]
    assert sorted(versions, key=G.version_key) == ["0.9.9", "1.0.0-alpha", "1.0.0-rc.1", "1.0.0-rc.10", "1.0.0"]
