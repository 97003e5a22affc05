from pyspark.sql import functions as F

from tessera.operators import answers as A


def test_sentences_and_claims():
    assert A.sentences("Ông Ts. Nam nói vậy. Hết!\n- ý một [1]\n* ý hai") == ["Ông Ts. Nam nói vậy.", "Hết!", "ý một [1]", "ý hai"]
    assert A.claims("Short [1]. This sentence is long enough to count [2][1][2].") == [("This sentence is long enough to count .", [2, 1])]
    assert A.sentences("") == []


def test_replies_and_places():
    assert A.numbered_replies("[1] a\n b\n[2] c", 2) == ["a b", "c"]
    assert A.numbered_replies("[1] a\n[3] c", 2) is None and A.numbered_replies("[1] a\n[1] b", 1) is None
    text = "one  two\nthree four"
    assert text[slice(*A.located("two three", text))] == "two\nthree" and A.located("five", text) is None and A.located(" ", text) is None
    assert A.snapped(text, 6, 7) == (5, 8)


def test_json_and_numbers():
    assert A.canonical_json({"b": 1, "a": ["é"]}) == '{"a":["é"],"b":1}' and A.checksum({}) == A.checksum({})
    assert A.redacted_values({"a": ["x", 1, None]}, str.upper) == {"a": ["X", 1, None]}
    assert A.resamples(0.025) == 5120 and A.resamples(1e-9) == 200_000 and A.plain_letters("Tỷ") == "Ty"


def test_blocks_and_paths(spark):
    rows = [("a", 'T.\n\n```citations\n[{"n": 1, "quote": "q"}]\n```'), ("b", "plain"), ("c", "T\n```citations\n[{"), ("d", None)]
    df = spark.createDataFrame(rows, "id string, t string").select("id", A.citation_block(F.col("t")).alias("b"))
    got = {r.id: r.b for r in df.collect()}
    assert got["a"].status == "ok" and got["a"].answer == "T." and got["a"].claims[0].n == 1
    assert got["b"].status == "absent" and got["b"].answer == "plain" and got["c"].status == "invalid"
    paths = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "d"]), (["a"], ["a", "b"]), (["x"], ["a"]), ([], ["a"])], "p array<string>, q array<string>")
    assert [r[0] for r in paths.select(A.common_start(F.col("p"), F.col("q"))).collect()] == [["a", "b"], ["a"], [], []]


def test_verification(spark):
    claims = spark.createDataFrame([("a", 1, "one two"), ("a", 2, "nothing"), ("a", 9, "x")], "id string, n int, quote string")
    sources = spark.createDataFrame([("a", 1, "one  two three"), ("a", 2, "else")], "id string, n int, content string")
    assert dict(A.verified_claims(claims, sources).select("n", "state").collect()) == {1: "verified", 2: "unverified", 9: "invalid"}
