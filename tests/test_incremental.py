import pytest
from pyspark.sql import functions as F

from tessera.operators import incremental as I
from tessera.operators import stats as S


def test_update_actions(spark):
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "q")], "doc_id string, chunk_index int, digest string")
    new = spark.createDataFrame([("a", 0, "x"), ("a", 1, "z"), ("a", 2, "n"), ("c", 0, "q")], "doc_id string, chunk_index int, digest string")
    got = {(r.doc_id, r.chunk_index): (r.action, r.old_index) for r in I.index_update(old, new).collect()}
    assert got == {("a", 0): ("keep", None), ("a", 1): ("reuse", 2), ("a", 2): ("encode", None), ("b", 0): ("delete", None), ("c", 0): ("encode", None)}


def test_cache_and_lookup(spark):
    rows = [("s", "a", 10), ("s", "a", 90), ("s", "b", 95), ("s", "c", 99), ("s", "d", 1)]
    df = spark.createDataFrame(rows, "space string, key string, at int").withColumn("at", F.timestamp_seconds("at"))
    kept = I.cache_state(df, "space", "key", "at", F.timestamp_seconds(F.lit(100)), 50, 2).orderBy("age").collect()
    assert [(r.key, r.writes) for r in kept] == [("c", 1), ("b", 1)]
    texts, store = spark.createDataFrame([("x",), ("y",)], "t string"), spark.createDataFrame([("x", [1.0])], "t string, v array<double>")
    assert I.looked_up(texts.where("t = 'x'"), store, "t", "v").first().v == [1.0]
    with pytest.raises(Exception, match="no stored vector"):
        I.looked_up(texts, store, "t", "v").collect()


def test_trees_and_merges(spark):
    spans = spark.createDataFrame([("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "d", "gone")], "trace string, id string, parent string")
    assert {r.id: r.depth for r in I.trace_tree(spans).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}
    m = spark.createDataFrame([("x", 1.0)], "name string, v double")
    with pytest.raises(Exception, match="both tables"):
        I.merged_metrics(m, m, "name").collect()
    assert I.remaining(spans, spans.where("id = 'a'"), "id").count() == 3


def test_calibration_and_interval(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (True, True), (None, True)], "p boolean, a boolean")
    got = S.calibration(df, F.col("p"), F.col("a")).first()
    assert (got.tp, got.fp, got.fn) == (2, 1, 1) and got.precision == pytest.approx(2 / 3, abs=1e-6) and got.bias == 0
    rows = spark.createDataFrame([(i, "s" if i % 2 else "t", 1.0, float(i % 2)) for i in range(60)], "i int, s string, w double, v double")
    same = S.stratified_bootstrap(rows, "s", "w", "v", F.col("i"), 60).first()
    assert same.low == same.high == 0.5
