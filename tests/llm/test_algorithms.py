"""Consensus, near-duplicates and ranking."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import consensus, ranking, similar

LABELS = ["A", "B", "C"]


def test_votes_spelling_repeats_and_latest(spark):
    rows = [("r1", "x", " not-found", 1), ("r1", "x", "Not Found", 1), ("r1", "x", "no_claim", 2), ("r2", "x", "?", 1), ("r3", None, "NO CLAIM", 1), (None, "x", "NO CLAIM", 1), ("r4", "y", None, 1)]
    df = spark.createDataFrame(rows, "ref string, who string, label string, at int").withColumn("at", F.timestamp_seconds("at"))
    got = consensus.usable_votes(df, "ref", F.col("who"), "label", ["NOT_FOUND", "NO_CLAIM"], "at")
    assert [tuple(r) for r in got.collect()] == [("r1", "x", "NO_CLAIM")]
    assert consensus.usable_votes(df.limit(0), "ref", F.col("who"), "label", LABELS).count() == 0


def test_consensus_trusts_reliable_annotators(spark, monkeypatch):
    r = random.Random(1)
    truth = {f"i{n}": r.choice(LABELS) for n in range(250)}
    votes = []
    for item, label in truth.items():
        for who in ("good1", "good2"):
            votes.append((item, who, label if r.random() < 0.97 else r.choice(LABELS)))
        for who in ("bad1", "bad2", "bad3"):
            votes.append((item, who, LABELS[(LABELS.index(label) + 1) % 3] if r.random() < 0.6 else r.choice(LABELS)))
    df = spark.createDataFrame(votes, "item string, annotator string, label string")
    items = df.select("item").distinct().unionByName(spark.createDataFrame([("none",)], "item string"))
    results = []
    for most in (20_000, 1):  # small models are broadcast, larger ones joined
        monkeypatch.setattr(consensus, "MOST_BROADCAST", most)
        fitted = consensus.Consensus(df, LABELS, rounds=8)
        results.append({x.item: x for x in fitted.labelled(items).collect()})
    right = sum(results[0][i].label == t for i, t in truth.items())
    assert right >= 240 and results[0]["none"].votes == 0
    assert {i: x.label for i, x in results[0].items()} == {i: x.label for i, x in results[1].items()}
    who = {x.annotator: x for x in fitted.annotators().collect()}
    assert min(who[g].reliability for g in ("good1", "good2")) > 0.85 > 0.6 > max(who[b].reliability for b in ("bad1", "bad2", "bad3"))


def test_agreement_is_krippendorff_alpha(spark):
    votes = [("1", "A"), ("1", "A"), ("2", "A"), ("2", "B"), ("3", "B"), ("3", "B"), ("3", "B"), ("4", "A")]
    got = consensus.agreement(spark.createDataFrame(votes, "item string, label string")).first()
    n, counts = 7, {"A": 3, "B": 4}
    observed = (2 / 1 + 0 + 6 / 2) / n
    expected = sum(c * (c - 1) for c in counts.values()) / (n * (n - 1))
    assert got.items == 3 and got.votes == n and got.alpha == pytest.approx(1 - (1 - observed) / (1 - expected))
    assert consensus.agreement(spark.createDataFrame([], "item string, label string")).first().alpha is None


def test_bits_estimate_similarity():
    r = np.random.default_rng(2)
    sets = [r.integers(-(2**62), 2**62, 200) for _ in range(2)]
    sets[1][:150] = sets[0][:150]
    offsets = np.array([0, 200, 400])
    minima = similar.minhash(offsets, np.concatenate(sets))
    lanes = (minima[: similar.LANES, 0] & 3) == (minima[: similar.LANES, 1] & 3)
    corrected = (lanes.mean() - 0.25) / 0.75
    assert abs(corrected - 150 / 250) < 0.15 and abs((minima[:, 0] == minima[:, 1]).mean() - 0.6) < 0.1
    assert similar.packed(minima).shape == (2, 8) and similar.bands(minima, np.zeros(2, np.int64)).shape == (2, similar.BANDS)


def test_similar_pairs_against_brute_force(spark):
    r = random.Random(3)
    base = [[f"w{r.randint(0, 400)}" for _ in range(18)] for _ in range(25)]
    rows = []
    for n in range(160):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"n{r.randint(0, 9)}"
        r.shuffle(words)
        rows.append((f"q{n:03d}", ("a", "b", None)[n % 3], " ".join(words) + r.choice(["", "?", "​"])))
    rows += [("z1", "a", "???"), ("z2", "a", "???"), ("z3", "a", "!"), ("z4", "a", None), ("z5", "a", " "), rows[0]]
    df = spark.createDataFrame(rows, "id string, scope string, t string")
    found = similar.SimilarSets(similar.word_sets(df, "id", "t", "scope"), 0.7)
    got = {tuple(x) for x in found.pairs().collect()}
    words = {i: (s, frozenset(t.replace("​", "").replace("?", "").lower().split())) for i, s, t in rows if t and t.strip("?! ")}
    want = {("z1", "z2")}
    for i, (s, a) in words.items():
        for j, (s2, b) in words.items():
            if i < j and s == s2 and len(a & b) >= 0.7 * len(a | b) - 1e-12:
                want.add((i, j))
    assert got == want
    groups = {x.id: x.group for x in found.groups().collect()}
    parent = {i: i for i in groups}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in want:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert groups == {i: root(i) for i in groups}


def test_no_rows(spark):
    found = similar.SimilarSets(similar.word_sets(spark.createDataFrame([], "id string, t string, scope string"), "id", "t", "scope"), 0.7)
    assert found.pairs().count() == 0 and found.groups().count() == 0


def test_shared_top_wins_whatever_the_scales(spark):
    r = random.Random(4)
    rows = []
    for q in range(40):
        chunks = list(range(20))
        r.shuffle(chunks)
        scale, shift = 10 ** r.uniform(-3, 4), r.uniform(-50, 50)
        first, second = chunks[0], chunks[1]
        for c in chunks:
            dense = shift + scale * (10 if c == second else 9 if c == first else r.random())
            sparse = {first: 5000.0, chunks[2]: 4000.0}.get(c, r.random())
            rows.append(("run", f"q{q}", f"c{c:02d}", dense, sparse if c % 3 or c in (first, chunks[2]) else r.choice([None, float("nan")])))
        rows.append(("want", f"q{q}", f"c{first:02d}", None, None))
    df = spark.createDataFrame([x for x in rows if x[0] == "run"] * 2, "run string, q string, c string, d double, s double")
    got = {x.q: x.c for x in ranking.ideal_point_ranking(df, ["run", "q"], "c", ["d", "s"]).where("place = 1").collect()}
    assert got == {q: c for run, q, c, *_ in rows if run == "want"}


def test_ranking_edges(spark):
    rows = [("a", "x", 1.0, None, 5), ("a", "y", 2.0, None, 5), ("b", "x", None, None, 5), ("c", "x", None, 3.0, 5), ("d", "y", 1.0, 1.0, 5), ("d", "x", 1.0, 1.0, 5), (None, "x", 1.0, 1.0, 5), ("e", None, 1.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "g string, k string, s0 double, s1 double, place int")
    got = {(x.g, x.k): (x.closeness, x.place) for x in ranking.ideal_point_ranking(df, ["g"], "k", ["s0", "s1"]).collect()}
    assert got["a", "y"][1] == 1 and got["b", "x"] == (None, 1) and got["c", "x"] == (1.0, 1)
    assert got["d", "x"] == (1.0, 1) and got["d", "y"] == (1.0, 2) and len(got) == 6
    assert ranking.ideal_point_ranking(df.limit(0), ["g"], "k", ["s0", "s1"]).count() == 0
