"""Column functions against small Python restatements."""

import hashlib
import re
import uuid

import pytest
from pyspark.sql import functions as F

from taxonaut.functions import arrays, ids, text

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_white_space_is_pythons(spark):
    rows = [(f"a{c}b",) for c in SPACES] + [("a\u200bb",), (None,), ("　 a 　",)]
    got = spark.createDataFrame(rows, "x string").select("x", text.clean(F.col("x")), text.compact(F.col("x"))).collect()
    for x, cleaned, compacted in got:
        assert cleaned == re.sub(r"\s+", " ", (x or "").strip())
        assert compacted == re.sub(r"\s+", "", x or "")


@pytest.mark.parametrize(("raw", "name", "code"), [("名称（A1-1-3）", "名称", "A1-1-3"), ("x (A01) ", "x", "A01"), ("x【A】", "x", "A"), ("x [B2]", "x", "B2"), ("x (see)1", "x (see)1", None), ("x (备注)", "x (备注)", None), ("（A）", "", "A")])
def test_codes(spark, raw, name, code):
    assert one(spark, raw, text.strip_code) == name
    assert one(spark, raw, text.extract_code) == code


@pytest.mark.parametrize(("raw", "name", "code"), [("A1-1: 名", "名", "A1-1"), ("A1：名（B2）", "A1：名", "B2"), ("名", "名", "")])
def test_trailing_code_wins(spark, raw, name, code):
    assert tuple(one(spark, raw, text.split_code)) == (name, code)


@pytest.mark.parametrize(("raw", "family"), [("VARCHAR2(32)", "STRING"), ("bigint unsigned", "INTEGER"), ("geometry", "GEOMETRY"), ("", ""), (None, "")])
def test_types(spark, raw, family):
    assert one(spark, raw, text.normalize_type) == family


def test_levels(spark):
    for raw, level in (("1", "L1"), ("level2", "L2"), ("L3", "L3"), (" ", ""), (None, "")):
        assert one(spark, raw, text.normalize_level) == level
    with pytest.raises(Exception, match="Unsupported data level"):
        one(spark, "5", text.normalize_level)
    assert tuple(one(spark, "3 4", text.standard_level)) == (None, "3 4")
    assert tuple(one(spark, "2级", text.standard_level)) == ("L2", "2级")


def test_names_and_categories(spark):
    assert one(spark, " A--b 中 文!", text.normalize_name) == "a_b_中_文"
    assert one(spark, "物流-公告（A1）", text.parse_category)["parts"] == ["物流", "公告"]
    assert not one(spark, "a-公告", text.parse_category)["multi_part"]
    assert one(spark, "", text.parse_category)["malformed"]


def test_ids(spark):
    got = spark.range(200).select(F.col("id").cast("string"), ids.uuid5(F.col("id"), F.lit("é")), ids.permuted(F.array(*[F.lit(c) for c in "abcde"]), F.col("id"), 5)).collect()
    for key, made, items in got:
        assert made == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{key}\x1fé"))
        digest, expected = hashlib.sha256(key.encode()).digest(), list("abcde")
        for i in range(4, 0, -1):
            j = digest[i] % (i + 1)
            expected[i], expected[j] = expected[j], expected[i]
        assert items == expected
    row = spark.createDataFrame([("a ", None, "c")], "a string, b string, c string").select(ids.qualified_id("d", [F.col(c) for c in "abc"]))
    assert row.first()[0] == "d:a..c"


def test_paths(spark):
    df = spark.createDataFrame([(["a", "a\u3000", None, "\t", "\u00a0a\n", "b", "a"],)], "p array<string>")
    assert df.select(arrays.dedupe_path(F.col("p"))).first()[0] == ["a", "b", "a"]
    assert df.select(arrays.path_with_leaf(F.array().cast("array<string>"), F.lit("x"))).first()[0] == ["x"]
    assert df.select(arrays.suffix(F.array(F.lit("a"), F.lit("b")), F.lit(5))).first()[0] == "a / b"
    assert df.select(arrays.deepest_level([F.lit("a"), F.lit(" "), F.lit(None).cast("string")])).first()[0] == 0


def test_fingerprints_and_choices_are_bounded(spark, monkeypatch):
    from taxonaut.operators import choices

    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, source string")
    one = ids.fingerprint(rows, ["k"]).first()[0]
    assert one == ids.fingerprint(rows.withColumn("source", F.lit("z")), ["k"]).first()[0] == ids.fingerprint(rows.drop("source"), ["k"]).first()[0]
    assert one != ids.fingerprint(rows.withColumn("v", F.lit("z")), ["k"]).first()[0]
    assert [r["choice_id"] for r in choices.choice_ids(rows, "k").orderBy("k").collect()] == ["1", "2"]
    monkeypatch.setattr(ids, "MOST_ROWS", 1)
    monkeypatch.setattr(choices, "MOST_RANKED", 1)
    for work in (ids.fingerprint(rows, ["k"]), choices.choice_ids(rows, "k")):
        with pytest.raises(Exception, match="over 1"):
            work.collect()
