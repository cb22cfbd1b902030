"""Sources, sinks, streaming and the driver contract."""

import json
import zipfile

import numpy as np
import pytest

import __spark_entry__
from railcorpus.sources import files, reports


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿k,v,"t"\n1,2.5,"x, y"\n2,,\n', "utf-8")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), "k int, v double, t string, included boolean", ["k", "t", "included"])
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, "x, y", None), (2, None, None)]


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/a.csv", "a,b,c\n1,x,9\n,,\n2,,8\n")
    df = files.read_zipped_csv(spark, str(tmp_path / "a.zip"), "in/a.csv", ["b", "a"])
    assert {tuple(r) for r in df.collect()} == {("x", "1"), (None, "2")}
    with pytest.raises(Exception, match="lacks"):
        files.read_zipped_csv(spark, str(tmp_path / "a.zip"), "in/a.csv", ["zz"]).collect()
    with pytest.raises(Exception, match="expected"):
        files.read_zipped_csv(spark, str(tmp_path / "a.zip"), "in/a.csv", ["a"], "00").collect()


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"post_id":"1","tokens":["a"]}\n\n{"post_id":"2","tokens":[]}\n')
    assert files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "post_id string, tokens array<string>").count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"a": {"b": 3}}))
    assert files.load_settings(str(tmp_path / "s.json"), {"a.b": 3}) == {"a": {"b": 3}}
    with pytest.raises(ValueError):
        files.load_settings(str(tmp_path / "s.json"), {"a.b": 4})
    s = files.signed({"x": 1})
    assert files.verify_signed(s) and not files.verify_signed({**s, "x": 2})
    assert files.latest_passing([{"run_id": "1", "ok": True}, {"run_id": "2", "ok": False}], ok=True)["run_id"] == "1"


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "e.npz", ids=np.array(["a", "b"]), m=np.eye(2, dtype="f4"))
    assert {r.key: r.embedding for r in files.read_array_file(spark, str(tmp_path / "e.npz"), "ids", "m").collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    np.savez(tmp_path / "c.npz", indptr=[0, 2, 2], indices=[0, 3], data=[5, 1])
    assert {tuple(r) for r in files.read_sparse_file(spark, str(tmp_path / "c.npz"), ["x", "y"]).collect()} == {("x", 0, 5), ("x", 3, 1)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.0), (None, None)], "k string, v double")
    assert reports.markdown_table(df) == "| k | v |\n|---|---|\n| a\\|b | 1.0 |\n| — | — |\n"
    assert "\\multicolumn" in reports.latex_table({"A_1": df})
    assert "NA" in reports.heatmap_svg(df.selectExpr("k", "'c' as c", "v"), "k", "c", "v")
    assert reports.bars_svg(df, "k", "v").count("<rect") == 2
    marked = spark.createDataFrame([("t", "a", 3.0, True), ("t", "b", 4.0, None), ("u", "a", None, False)], "t string, c string, v double, yes boolean")
    assert reports.heatmap_svg(marked, "t", "c", "v", marker="yes").count("<circle") == 1 and "<circle" not in reports.heatmap_svg(marked, "t", "c", "v")
    grid = spark.createDataFrame([(4, 1.0, 0.5, 2.0), (8, 2.0, 1.0, 3.0), (9, None, None, None)], "q int, m double, l double, h double")
    panels = reports.whisker_panels_svg([("by quota", grid), ("none", grid.limit(0))], "q", "m", "l", "h")
    assert panels.count("<circle") == 2 == panels.count("<path") and "by quota" in panels
    assert "polyline" in reports.band_svg(spark.createDataFrame([(1, 2.0, 1.0, 3.0), (2, 1.0, 0.0, 4.0)], "x int, m double, l double, h double"), "x", "m", "l", "h")
    assert reports.chain_svg([("post", "text"), ("words", "a b")]).count("<rect") == 2
    with pytest.raises(ValueError):
        reports.few_rows(df, 1)
    files.write_csv(str(tmp_path / "c"), df, df.select("k"))
    files.write_json_lines(df, str(tmp_path / "j"))
    files.write_tables(str(tmp_path / "t"), one=df)
    assert spark.read.parquet(str(tmp_path / "t/one.parquet")).count() == 2
    listed = files.manifest(spark, str(tmp_path), ["j"])
    assert files.manifest_problems(listed, listed).count() == 0 and files.manifest_problems(listed, listed.limit(0)).count() == listed.count()
    assert zipfile.ZipFile(files.archive(str(tmp_path / "j"), str(tmp_path / "j.zip"))).namelist()


def test_cache_is_keyed_by_its_making(spark, tmp_path):
    made = []
    cache = files.Cache(spark, str(tmp_path))
    make = lambda: made.append(1) or spark.range(3)
    assert cache.table("x", "f1", {"k": 1}, make).count() == 3 == cache.table("x", "f1", {"k": 1}, make).count() and len(made) == 1
    cache.table("x", "f2", {"k": 1}, make)
    assert len(made) == 2


def test_streamed_windows(spark, tmp_path):
    from railcorpus.streaming.windows import windowed_counts

    rows = [(1, "2024-01-01 00:01:00", "a", 1.0), (2, "2024-01-01 00:07:00", "a", 3.0), (3, "2024-01-01 00:08:00", "b", 5.0), (4, "2024-01-01 02:00:00", "b", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "10 minutes", "5 minutes").writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = {(r.event_type, r.n, r.total) for r in spark.sql("select * from windows").collect()}
    assert got == {("a", 1, 1.0), ("a", 1, 3.0), ("b", 1, 5.0)}


def test_contract(spark):
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 90
    assert __spark_entry__.entry(spark).count() > 0
