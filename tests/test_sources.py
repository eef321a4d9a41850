"""Readers, writers and streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from taxonaut.operators.resolve import DatasetConfig
from taxonaut.sources import readers, writers
from taxonaut.streaming import resolve as streaming


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a ,b\n1,"x\ny"\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "x\ny")]
    (tmp_path / "b.csv").write_text("a ,a\n1,2\n")
    with pytest.raises(ValueError, match="duplicate"):
        readers.read_csv(spark, str(tmp_path / "b.csv"))


def test_json_array(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text("\ufeff" + json.dumps([{"id": "1", "n": {"x": 2}}, {"id": "2"}]), encoding="utf-8")
    got = readers.read_json_array(spark, str(path), "id string, n struct<x: int>").orderBy("row_no").collect()
    assert [(r["row_no"], r["id"], r["n"]["x"] if r["n"] else None) for r in got] == [(0, "1", 2), (1, "2", None)]
    path.write_text('[{"id": "1"}, "odd", 3]')
    with pytest.raises(Exception, match="not an object"):
        readers.read_json_array(spark, str(path), "id string").collect()
    assert [r["record"] for r in readers.read_json_array(spark, str(path), "id string", strict=False).orderBy("row_no").collect()] == [None, '"odd"', "3"]


def test_dictionary_keeps_order(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"z": {"a": 1}, "b": "s"}')
    assert [(r["pos"], r["key"]) for r in readers.read_dictionary(spark, str(tmp_path / "d.json")).orderBy("pos").collect()] == [(0, "z"), (1, "b")]


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(["A", "B", {"category_id": "C", "name": "c", "path": ["x", "c"]}, "D", "E"]))
    assert [(r["ord"], r["name"]) for r in readers.read_registry(spark, str(tmp_path / "r.json")).orderBy("ord").collect()][2] == (2, "c")
    for bad in (["A"] * 5, ["A", "B"], ["A", "B", "C", "D", ""]):
        with pytest.raises(ValueError):
            readers.registry_from_items(spark, bad)


def test_manifest(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    good = {"data/raw/x.bin": hashlib.sha256(b"abc").hexdigest()}
    readers.verify_digests(spark, str(tmp_path), good)
    for bad in ({"x.bin": "0"}, {"y.bin": "0"}):
        with pytest.raises(ValueError):
            readers.verify_digests(spark, str(tmp_path), bad)


def test_grid(spark):
    cells = spark.createDataFrame([("s", 1, 1, "v"), ("s", 2, 1, None), ("s", 1, 2, "w")], "sheet string, row int, col int, value string")
    ranges = spark.createDataFrame([("s", 1, 1, 3, 1)], "sheet string, r1 int, c1 int, r2 int, c2 int")
    got = {(r["row"], r["col"]): (r["value"], r["inherited"]) for r in readers.expand_grid(cells, ranges).collect()}
    assert got == {(1, 1): ("v", False), (2, 1): ("v", True), (3, 1): ("v", True), (1, 2): ("w", False)}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("train", 1), ("val", 2)], "split string, x int")
    out = str(tmp_path / "out")
    writers.write_splits(rows, out)
    assert spark.read.parquet(out).where("split = 'val'").first()["x"] == 2
    with pytest.raises(FileExistsError):
        writers.publish({out: rows})
    writers.publish({out: rows.limit(1), str(tmp_path / "more"): rows}, overwrite=True)
    assert spark.read.parquet(out).count() == 1
    writers.write_json_lines(rows, F.to_json(F.struct("x")), str(tmp_path / "lines"))
    assert readers.read_json_lines(spark, str(tmp_path / "lines"), "x int").count() == 2
    assert json.loads(writers.json_text(rows, ["x"]))[0] == {"split": "train", "x": 1}
    assert "| train | 1 |" in writers.markdown_table(rows, ["x"])


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("labeled", "a", "x", i) for i in range(5)], "label_status string, level_1 string, level_4 string, n int").withColumn("ts", F.timestamp_seconds(F.col("n") * 40000).cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = streaming.read_events(spark, str(tmp_path / "in"))
    registry = spark.createDataFrame([("d:a.x", "x")], "category_id string, name string")
    out = streaming.resolve_stream(stream, DatasetConfig("d", path_fields=("level_1", "level_4")), registry)
    query = streaming.windowed_counts(out, "ts", ["resolution_status"]).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {r["resolution_status"]: r["n"] for r in spark.sql("select resolution_status, sum(n) n from counts group by 1").collect()} == {"resolved": 5}
