"""Readers, writers and streams over temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators.ranking import latest
from weftline.session import table
from weftline.sources import readers, sinks
from weftline.streaming import events as streams


def test_readers_by_suffix(spark, tmp_path):
    rows = [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "r.csv").write_text("k,v\n1,a\n2,b\n")
    (tmp_path / "r.tsv").write_text("k\tv\n1\ta\n2\tb\n")
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "r.parquet"))
    for name in ("r.json", "r.jsonl", "r.csv", "r.tsv", "r.parquet"):
        assert sorted((int(r.k), r.v) for r in readers.read_records(spark, str(tmp_path / name)).collect()) == [(1, "a"), (2, "b")]
    assert readers.read_records(spark, str(tmp_path / "missing.parquet")) is None
    assert readers.first_there(spark, [str(tmp_path / "no.csv"), str(tmp_path / "r.csv")]).count() == 2
    with pytest.raises(ValueError, match="no reader"):
        readers.read_records(spark, "x.bin")


def test_aliases(spark):
    df = spark.createDataFrame([("f", "w", "x")], "`Form` string, `Variable Name` string, other string")
    found = readers.resolve_aliases(df, {"table": ["form", "A"], "variable": ["var", "B"], "label": ["Label"]}, required=("table",))
    assert found.columns == ["table", "variable"] and tuple(found.first()) == ("f", "w")
    with pytest.raises(ValueError, match="label"):
        readers.resolve_aliases(df, {"label": ["Label"]}, required=("label",))
    assert [readers.letter_index(x) for x in ("A", "Z", "AA")] == [0, 25, 26]


def test_nested_outputs_and_truth(spark):
    df = spark.createDataFrame([("x", [("A", 1), ("B", 2)])], "t string, recommendations array<struct<d:string,s:int>>")
    assert sorted((r.t, r.d) for r in readers.nested_outputs(df).collect()) == [("x", "A"), ("x", "B")]
    truth = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", ""), ("c", "3")], "k string, v string")
    assert readers.duplicate_keys(truth, ["k", "v"]).count() == 2
    assert [readers.kb_shape(c) for c in (["chunk_id", "CHUNK_TEXT"], ["metadata_variable", "SDTM_Variable"], ["x"])] == ["structured", "mapping", "generic"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", 1, 0.2), ("t", 2, 0.9)], "t string, k int, s double")
    path = str(tmp_path / "table")
    sinks.replace_table(df, path)
    sinks.replace_table(df.limit(1), path)
    assert spark.read.parquet(path).count() == 1
    assert [x.k for x in sinks.nested(df, "t", "s", ["k"]).first().recommendations] == [2, 1]
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    for kind in ("csv", "json", "parquet", "orc"):
        sinks.write_records(df, str(tmp_path / kind), kind)
    with pytest.raises(ValueError, match="no writer"):
        sinks.write_records(df, path, "xls")


SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def files(spark, small, tmp_path):
    folder = str(tmp_path / "in")
    for k in range(3):
        table(spark, small, "events").where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_stream_equals_batch(spark, small, files, tmp_path):
    stream = streams.summary(streams.read_events(spark, files, SCHEMA, "*.parquet"), late="3650 days")
    found = streams.run_to_table(stream, "found", str(tmp_path / "c1"), "complete")
    assert sorted(map(str, found.collect())) == sorted(map(str, streams.summary(table(spark, small, "events")).collect()))


def test_upsert_stream_keeps_the_latest(spark, small, files, tmp_path):
    target = str(tmp_path / "target")
    streams.upsert_stream(streams.read_events(spark, files, SCHEMA, "*.parquet"), target, str(tmp_path / "c2"), ["user_id"], "ts", "event_id")
    expected = latest(table(spark, small, "events"), ["user_id"], "ts", "event_id")
    assert sorted(map(str, streams.newest_version(spark, target).select("user_id", "event_id").collect())) == sorted(map(str, expected.select("user_id", "event_id").collect()))


def test_token_bucket(spark):
    rows = [(1, s) for s in (0, 0, 0, 1, 10)] + [(2, 0)]
    df = spark.createDataFrame(rows, "k int, t int").select("k", F.timestamp_seconds("t").alias("t"))
    # 24 a minute: two tokens at most, 0.4 more a second.
    found = streams.token_bucket(df, "k", "t", 24.0).collect()
    assert sorted((r.k, r.seconds, r.admitted) for r in found) == [(1, 0.0, False), (1, 0.0, True), (1, 0.0, True), (1, 1.0, False), (1, 10.0, True), (2, 0.0, True)]


def test_token_bucket_stream(spark, tmp_path):
    rows = [(1, s) for s in (0, 0, 0, 1, 10)] + [(2, 0)]
    spark.createDataFrame(rows, "k int, t int").select("k", F.timestamp_seconds("t").alias("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t timestamp").parquet(str(tmp_path / "in"))
    found = streams.run_to_table(streams.token_bucket(stream, "k", "t", 24.0), "admitted", str(tmp_path / "c3"))
    assert found.where("admitted").count() == 4 and found.count() == 6


def test_resume(spark):
    todo, done = spark.range(10), spark.range(4)
    assert streams.resume(todo, done, ["id"]).count() == 6


def test_json_lines_and_documents(spark, tmp_path):
    rows = [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "pretty.json").write_text(json.dumps(rows, indent=2))
    for name in ("lines.json", "pretty.json"):
        assert sorted((r.k, r.v) for r in readers.read_records(spark, str(tmp_path / name)).collect()) == [(1, "a"), (2, "b")]


def test_checkpoints_by_precedence_and_identity(spark, tmp_path):
    base = str(tmp_path / "out")
    recs = lambda v: [{"table_name": "t", "domain_recommendations": [{"variable_name": v, "score": 0.5}, {"variable_name": "", "score": 0.1}]}]
    assert readers.checkpoint(spark, base) is None
    (tmp_path / "out.json").write_text(json.dumps(recs("done")))
    (tmp_path / "out.tmp.json").write_text(json.dumps({"model_name": "m", "checkpoint_context": "c", "recommendations": recs("half")}))
    names = lambda **k: [r.variable_name for r in readers.checkpoint(spark, base, **k).collect()]
    assert names() == names(model="m") == names(model="m", context="c") == ["half"]
    assert names(model="other") == names(model="m", context="d") == ["done"]
    (tmp_path / "out.tmp.json").write_text(json.dumps(recs("bare")))
    assert names() == ["bare"] and names(model="m") == ["done"]


def test_truth_is_checked(spark):
    with pytest.raises(ValueError, match="filled and unique"):
        readers.checked_truth(spark.createDataFrame([("a",), ("a",)], "k string"), ["k"])
    assert readers.checked_truth(spark.createDataFrame([("a",), ("b",)], "k string"), ["k"]).count() == 2


def test_replaced_tables_survive_failed_runs(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # a run that ended between its moves
    sinks.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.old").exists()
    with pytest.raises(Exception, match="boom"):
        sinks.replace_table(spark.range(2).select(F.raise_error(F.lit("boom")).alias("id")), path)
    assert spark.read.parquet(path).count() == 5


def test_upserts_rewrite_touched_parts_only(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "target")
    rows = [(k, t, k * 100 + t) for t in range(6) for k in ((0, 1, 2, 3) if t == 0 else (t % 4,))]
    for t in range(6):
        spark.createDataFrame([r for r in rows if r[1] == t], "k long, t long, v long").coalesce(1).write.mode("append").parquet(str(source))
    stream = streams.read_events(spark, str(source), "k long, t long, v long", "*.parquet")
    streams.upsert_stream(stream, target, str(tmp_path / "c"), ["k"], "t", "v", parts=8)
    latest_ = {}
    for k, t, v in rows:
        latest_[k] = max(latest_.get(k, (0, 0)), (t, v))
    assert {r.k: (r.t, r.v) for r in streams.newest_version(spark, target).collect()} == latest_
    kept = [p.name for p in (tmp_path / "target").glob("v*/part=*")]
    assert len(kept) < 4 + 6 * 2  # parts that no state names are gone


def test_windows_go_to_files_when_they_are_closed(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:50:00"), (3, "2024-01-01 05:00:00")]
    spark.createDataFrame(rows, "event_id long, t string").selectExpr("event_id", "cast(t as timestamp_ntz) as ts", "'a' as event_type", "1.0D as value").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), "event_id long, ts timestamp_ntz, event_type string, value double", "*.parquet")
    found = streams.run_to_files(streams.summary(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [(r.kind, r.n, r.total) for r in found.collect()] == [("a", 2, 2.0)]
