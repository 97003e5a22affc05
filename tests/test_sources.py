import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as S


def test_documents_of_several_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Xin chào\n", encoding="utf-8")
    (tmp_path / "b.html").write_text("<h1>Một <b>hai</b></h1><script>x</script><p>A&amp;B</p><table><tr><td>1</td></tr></table>", encoding="utf-8")
    (tmp_path / "c.md").write_text("# T\n\ntext\n\n| a |\n| - |\n## U\n", encoding="utf-8")
    rows = {r.path.rsplit("/", 1)[1]: r for r in S.documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].content == "Xin chào\n"
    assert rows["b.html"].content == "Một hai\nA&B\n1" and rows["b.html"].tables == 1
    assert [(h.depth, h.title) for h in rows["c.md"].headings] == [(1, "T"), (2, "U")] and rows["c.md"].tables == 1
    (tmp_path / "d.exe").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported file"):
        S.documents(spark, str(tmp_path)).collect()


def test_manifest_round_trip_and_repeated_key(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("doc_id string, pages int")
    df = spark.createDataFrame([("b", 2), ("a", 1)], schema)
    S.write_manifest(df, str(tmp_path / "m"), schema, "doc_id")
    assert [tuple(r) for r in S.manifest(spark, str(tmp_path / "m"), schema, "doc_id").orderBy("doc_id").collect()] == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="repeated key"):
        S.write_manifest(df.unionByName(df), str(tmp_path / "n"), schema, "doc_id")
    with pytest.raises(ValueError, match="unexpected schema"):
        S.require_schema(df, _parse_datatype_string("doc_id string, pages bigint"))


def test_json_lines(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("k string, n int, t string")
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in [{"k": "a", "n": 1, "t": "x"}, {"k": "a", "n": 2, "t": "y"}, {"k": "b", "n": 1, "t": " "}]) + "\n")
    assert [tuple(r) for r in S.latest_lines(spark, str(path), schema, "k", "n", "t").collect()] == [("a", 2, "y")]
    with pytest.raises(Exception, match="repeated key"):
        S.json_lines(spark, str(path), schema, "k").collect()
    path.write_text('{"k": \n')
    with pytest.raises(Exception):
        S.json_lines(spark, str(path), schema).collect()


def test_frames_samples_and_stats(spark, tmp_path):
    df = spark.createDataFrame([(1, "event: token\ndata: a\ndata: b\n\ndata: [DONE]\n\n")], "id int, body string")
    assert [(r.event, r.data) for r in S.event_frames(df, "body", "id").orderBy("frame").collect()] == [("token", "a\nb"), ("message", "[DONE]")]
    lines = spark.createDataFrame([("# HELP x",), ('x_bucket{le="+Inf",stage="a"} 3',), ("y 1.5",), ("bad",)], "value string")
    got = {r.name: (r.labels, r.value) for r in S.metric_samples(lines).collect()}
    assert got == {"x_bucket": ({"le": "+Inf", "stage": "a"}, 3.0), "y": ({}, 1.5)}
    (tmp_path / "s.csv").write_text("Type,Name,Request Count,95%\nGET,/chat,10,N/A\n")
    assert [tuple(r) for r in S.load_stats(spark, str(tmp_path / "s.csv")).collect()] == [("/chat", "Request Count", 10.0)]


def test_verified_files(spark):
    m = spark.createDataFrame([("p", "d1")], "path string, sha256 string")
    ok = spark.createDataFrame([("p", "text", "d1")], "path string, content string, digest string")
    assert S.verified(m, ok).select("content").first()[0] == "text"
    with pytest.raises(Exception, match="missing or changed"):
        S.verified(m, ok.withColumn("digest", F.lit("d2"))).collect()
