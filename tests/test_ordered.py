"""Places within keys, lists in chunks, and points inside of ranges, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from taxonaut.operators import corpus, ordered, ranges, standards
from taxonaut.plans import labels


def test_places_do_not_depend_on_partitions(spark):
    random.seed(4)
    rows = [("hot" if i % 2 else random.choice(["a", "b", None]), random.choice([None, *range(40)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, o int, i int")
    expected = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        expected |= {r[2]: (n, len(own)) for n, r in enumerate(own)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "4", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert {r["i"]: (r["position"], r["total"]) for r in ordered.numbered(df.repartition(5), ["k"], ["o", "i"]).collect()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ordered.numbered(df.limit(0), ["k"], ["o"]).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 7, 100])
def test_lists_come_in_chunks(spark, chunk):
    rows = [("x", i, None if i % 5 == 4 else f"d{i:02}") for i in range(20)] + [(None, 0, "only"), ("y", 2, "b"), ("y", 1, "a")]
    found = ordered.chunked(spark.createDataFrame(rows, "k string, o int, d string"), ["k"], ["o"], "d", F.col("o") != 3, {"first": F.col("d")}, chunk).collect()
    assert all(len(r["items"]) <= chunk for r in found) and all((r["first"] is not None) == (r["chunk"] == 0) for r in found)
    lists = lambda k: [x for r in sorted((r for r in found if r["k"] == k), key=lambda r: r["chunk"]) for x in r["items"]]
    assert lists("x") == [d for _, o, d in rows[:20] if o != 3] and lists("y") == ["a", "b"] and lists(None) == ["only"]
    assert sorted(r["chunk"] for r in found if r["k"] == "x") == list(range(-(-20 // chunk)))
    with pytest.raises(ValueError):
        ordered.chunked(spark.range(1), ["id"], ["id"], "id", chunk=0)


def test_categories_and_corpora_keep_hot_keys_in_bounded_rows(spark):
    rows = [("hot", i, " " if i % 3 == 1 else f"d{i}") for i in range(30)] + [("cold", 1, None), ("cold", 2, "z")]
    df = spark.createDataFrame(rows, "k string, o int, d string").repartition(4)
    found = corpus.aggregate_categories(df, ["k"], "o", "d", 8).orderBy("chunk").collect()
    hot = [r for r in found if r["k"] == "hot"]
    assert [r["chunk"] for r in hot] == [0, 1, 2, 3] and {r["extra"] for r in hot} == {29} and [r["description"] for r in hot] == ["d0", None, None, None]
    assert [x for r in hot for x in r["descriptions"]] == [f"d{i}" for i in range(1, 30) if i % 3 != 1] and max(len(r["descriptions"]) for r in hot) <= 8
    assert [(r["description"], r["descriptions"]) for r in found if r["k"] == "cold"] == [("", ["z"])]
    entries = df.select(F.col("o").alias("order"), F.col("k").alias("category_id"), F.concat(F.lit("n"), "o").alias("name"), F.coalesce(F.trim("d"), F.lit("")).alias("description"), F.array("k").alias("path"), F.lit(None).cast("string").alias("code"))
    built = corpus.build_corpus(entries, 8).where("category_id = 'hot'").orderBy("chunk").collect()
    assert [(r["name"], r["path"]) for r in built] == [("n0", ["hot"])] + [(None, None)] * 3 and sum(len(r["descriptions"]) for r in built) == 19


def test_annotations_keep_every_member(spark):
    rows = [("a", i, m) for i, m in enumerate("zyxwvzy")] + [("b", 9, None), (None, 3, "n")]
    found = standards.annotations(spark.createDataFrame(rows, "k string, r int, m string"), ["k"], "r", "m", chunk=2).orderBy("k", "chunk").collect()
    assert [(r["k"], r["chunk"], r["start_row"], r["end_row"], r["first_member"], r["members"]) for r in found] == [
        (None, 0, 3, 3, "n", ["n"]), ("a", 0, 0, 6, "z", ["v", "w"]), ("a", 1, 0, 6, "z", ["x", "y"]), ("a", 2, 0, 6, "z", ["z"]), ("b", 0, 9, 9, None, []),
    ]


@pytest.mark.parametrize("seed", range(2))
def test_points_meet_all_boxes_that_hold_them(spark, seed):
    random.seed(seed)
    end = lambda a: a + random.choice([-1, 0, 0, 1, 2, 5, 31, 32, 33, 1000, 10**6])
    boxes = [(i, random.choice("st"), a, end(a), b, end(b)) for i in range(60) for a, b in [(random.randint(-40, 40), random.randint(-40, 40))]]
    boxes += [(90, "s", -(1 << 63), (1 << 63) - 1, 0, 0), (91, "s", None, 5, 0, 9), (92, None, -50, 50, -50, 50)]
    points = [(i, random.choice("st"), random.randint(-50, 50), random.randint(-50, 50)) for i in range(150)] + [(900, "s", None, 1), (901, None, 1, 1), (902, "s", 1 << 62, 0), (902, "s", 1 << 62, 0)]
    found = ranges.within(spark.createDataFrame(points, "p int, k string, x long, y long"), spark.createDataFrame(boxes, "b int, k string, x1 long, x2 long, y1 long, y2 long"), [("x", "x1", "x2"), ("y", "y1", "y2")], ["k"])
    holds = lambda low, v, high: None not in (low, v, high) and low <= v <= high
    assert sorted((r["p"], r["b"]) for r in found.collect()) == sorted((p[0], b[0]) for p in points for b in boxes if p[1] is not None and p[1] == b[1] and holds(b[2], p[2], b[3]) and holds(b[4], p[3], b[5]))


def test_wide_ranges_are_not_expanded(spark):
    points = spark.range(1000).select((F.col("id") * 1_000_003).alias("x"))
    wide = spark.createDataFrame([(0, 10**15), (5, 5), (1_000_003, 1_000_003)], "a long, b long")
    assert ranges.within(points, wide, [("x", "a", "b")]).count() == 1001
    assert ranges.within(points, wide.limit(0), [("x", "a", "b")]).count() == 0 and ranges.within(points.limit(0), wide, [("x", "a", "b")]).count() == 0
    with pytest.raises(ValueError, match="share"):
        ranges.within(points, points, [("x", "x", "x")])


def test_merged_grid(spark):
    cells = spark.createDataFrame([("s", 2, 2, "group"), ("s", 3, 2, None), ("s", 4, 2, "hidden"), ("s", 2, 3, "plain"), ("s", 5, 9, "w"), ("s", 6, 9, "out"), ("t", 3, 2, "other")], "sheet string, row int, col int, value string")
    merged = spark.createDataFrame([("s", 2, 2, 4, 2), ("s", 3, 2, 9, 9), ("s", 5, 9, 5, 1 << 20)], "sheet string, r1 int, c1 int, r2 int, c2 int")
    got = {(r["sheet"], r["row"], r["col"]): (r["value"], r["anchor_row"], r["anchor_col"], r["start_row"], r["end_row"], r["inherited"]) for r in standards.merged_grid(cells, merged).collect()}
    assert got[("s", 2, 2)] == ("group", 2, 2, 2, 4, False) and got[("s", 3, 2)] == got[("s", 4, 2)] == ("group", 2, 2, 2, 4, True)
    assert got[("s", 2, 3)] == ("plain", 2, 3, None, None, False) and got[("t", 3, 2)] == ("other", 3, 2, None, None, False)
    assert got[("s", 5, 9)] == (None, 3, 2, 3, 9, True) and len(got) == 7


def test_digest_of_a_list_in_many_chunks_is_that_of_the_whole(spark):
    rows = [(k, i, "" if i % 4 == 3 or (k == "gap" and 4 < i < 16) else f"é{i}") for k, n in (("hot", 50), ("gap", 20), ("one", 1), ("blank", 0)) for i in range(n)]
    entries = spark.createDataFrame(rows, "category_id string, order int, description string").repartition(4).select("*", F.lit("n").alias("name"), F.array(F.lit("p"), F.lit("q")).alias("path"), F.lit(None).cast("string").alias("code"))
    for chunk in (4, 7, 1000):
        found = {r["category_id"]: r for r in labels._flat(corpus.build_corpus(entries, chunk)).collect()}
        assert set(found) == {"hot", "gap", "one"}
        for k, r in found.items():
            said = [d for key, i, d in rows if key == k and i and d]
            assert (r["descriptions"], r["description"], r["path"], r["code"]) == (hashlib.sha256(",".join(said).encode()).hexdigest(), "é0", "p>q", "")
            assert r["extra"] == len([x for x in rows if x[0] == k]) - 1
    assert labels._flat(corpus.build_corpus(entries.limit(0))).count() == 0


def test_a_category_of_many_chunks_is_one_row_of_the_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "aggregate_categories", lambda *a, f=corpus.aggregate_categories: f(*a, 3))
    spark.range(20).selectExpr("id as p_partkey", "'b' as p_brand", "'n' as p_name", "concat('t', id) as p_type").write.parquet(f"{tmp_path}/part.parquet")
    (r,) = labels.aggregate_categories(spark, str(tmp_path)).collect()
    assert (r["description"], r["descriptions"], r["extra"]) == ("t0", ",".join(f"t{i}" for i in range(1, 20)), 19)
