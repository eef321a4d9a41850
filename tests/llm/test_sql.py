"""Queries of operators that SQL can express, on the smallest data."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from taxonaut.llm import queries, sql, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(sql.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = con.sql(queries.oracle_sql()[name])
    df = getattr(queries, name)(spark, SF)
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    rows = lambda got, columns: sorted(tuple(repr(r[columns.index(c)]) for c in order) for r in got)
    assert rows(df.collect(), df.columns) == rows(expected.fetchall(), expected.columns)


def test_archives_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_BYTES", 100)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    sizes = [0, 1, 99, 100, 101, 400, 401, 1600, 1601, 9000]
    got = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", warc.size_class(F.col("n")).alias("size")).collect()
    assert [r["size"] for r in got] == [0, 0, 0, 0, 1, 1, 2, 2, 3, 4]
    rows = [(i, "u", chr(97 + i % 26) * sizes[i % 10]) for i in range(200)]
    path = str(tmp_path / "w")
    back = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path=path).collect()
    assert sorted(r["page_id"] for r in back) == list(range(200))
    assert all(r["payload_bytes"] == sizes[r["page_id"] % 10] for r in back)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", True).load(path).select(F.col("path")).collect()
    assert len(files) > 40
    for f in files:
        blocks = [len(r["block"]) for r in warc.read(spark, f["path"]).collect()]
        assert sum(blocks) <= 1000 or len(blocks) == 1
