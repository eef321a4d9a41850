"""JSON files cut into byte ranges of every size, against Python's own parser."""

import hashlib
import json
import random

import pytest

from taxonaut.sources import json_files, readers


@pytest.fixture
def ranges_of(spark):
    """Byte ranges of a given size."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], "1")

    yield use
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def value(level=0):
    pick = random.random()
    if level > 2 or pick < 0.5:
        return random.choice([1, -2.5, True, None, "plain", 'quote " in', "brace } in", "} , { [", 'back \\ slash \\" }', "类 😀", "", "\n}\t{"])
    return [value(level + 1) for _ in range(random.randint(0, 3))] if pick < 0.7 else {random.choice("abc}") + str(i): value(level + 1) for i in range(random.randint(0, 3))}


@pytest.mark.parametrize("size", [61, 1 << 20])
def test_arrays_of_anything(spark, tmp_path, ranges_of, size):
    random.seed(size)
    ranges_of(size)
    items = [value() for _ in range(25)] + [{"a": i, "t": "x}" * (i % 5)} for i in range(15)] + ["end", 7]
    for n, (lead, style) in enumerate((("", {}), ("﻿ \n", {"indent": 2}), ("", {"separators": (",", ":"), "ensure_ascii": False}))):
        (tmp_path / f"{n}.json").write_text(lead + json.dumps(items, **style) + ("\n" if n else ""), encoding="utf-8")
    found = json_files.items(spark, str(tmp_path)).selectExpr("file", "row_no", "to_json(item) as j", "item is null as none", "bad").collect()
    assert {r["bad"] for r in found} == {None}
    for n in range(3):
        own = sorted((r for r in found if r["file"].endswith(f"/{n}.json")), key=lambda r: r["row_no"])
        assert [r["row_no"] for r in own] == list(range(len(items))) and [json.loads(r["j"]) for r in own] == items


@pytest.mark.parametrize("size", [83, 1 << 20])
def test_objects(spark, tmp_path, ranges_of, size):
    random.seed(1)
    ranges_of(size)
    entries = {f"k{i}": random.choice([{"x": i, "t": "} { \" ,"}, {"y": {"z": [1, {}]}}, "text", {}]) for i in range(30)}
    (tmp_path / "d.json").write_text(json.dumps(entries, indent=1, ensure_ascii=False) + "\n")
    (tmp_path / "e.json").write_text(json.dumps(entries))
    for name in ("d", "e"):
        found = readers.read_dictionary(spark, str(tmp_path / f"{name}.json")).orderBy("pos").collect()
        assert [r["pos"] for r in found] == list(range(30)) and [(r["key"], r["value"] if isinstance(entries[r["key"]], str) else json.loads(r["value"])) for r in found] == list(entries.items())
    (tmp_path / "r.json").write_text('{"a": {"n": 1}, "b": {"n": 2}, "a": {"n": 3}}')
    assert [tuple(r) for r in readers.read_dictionary(spark, str(tmp_path / "r.json")).orderBy("pos").collect()] == [(0, "a", '{"n":3}'), (1, "b", '{"n":2}')]


def test_a_bad_item_spoils_no_other(spark, tmp_path, ranges_of):
    ranges_of(20)
    path = tmp_path / "a.json"
    path.write_text('[{"id": "1"}, {"id": nonsense}, {"id": "3"}, "odd", {"id": "5", "n": }, {"id": "6"}]')
    found = readers.read_json_array(spark, str(path), "id string", strict=False).orderBy("row_no").collect()
    assert [(r["id"], r["record"]) for r in found] == [("1", None), (None, '{"id": nonsense}'), ("3", None), (None, '"odd", {"id": "5", "n": }'), ("6", None)]
    with pytest.raises(Exception, match="not an object: .*nonsense"):
        readers.read_json_array(spark, str(path), "id string").collect()
    for empty in ("", "[]", " [ \n ] \n", "﻿[]"):
        path.write_text(empty)
        assert readers.read_json_array(spark, str(path), "id string").count() == 0
    path.write_text("{}")
    assert readers.read_dictionary(spark, str(path)).count() == 0
    path.write_text('{"a": oops, "b": {"c": 1}}')
    with pytest.raises(Exception, match="no JSON"):
        readers.read_dictionary(spark, str(path)).collect()


def test_one_file_is_read_by_many_tasks(spark, tmp_path, ranges_of):
    ranges_of(1 << 15)
    path = tmp_path / "large.json"
    path.write_text(json.dumps([{"id": str(i), "text": "word } " * 20} for i in range(3000)]))
    found = readers.read_json_array(spark, str(path), "id string, text string")
    assert json_files.pieces(spark, str(path)).select("block").distinct().count() > 10
    rows = found.select("row_no", "id").collect()
    assert len(rows) == 3000 and all(str(r["row_no"]) == r["id"] for r in rows)


def test_manifests_tell_files_of_one_name_apart(spark, tmp_path):
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for folder, content in (("a", b"1"), ("b", b"2"), ("a b+c", b"3")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.bin").write_bytes(content)
    good = {"a/x.bin": digest(b"1"), "raw/b/x.bin": digest(b"2"), "a b+c/x.bin": digest(b"3")}
    readers.verify_digests(spark, str(tmp_path), good)
    for bad, said in (({"a/x.bin": digest(b"2")}, "differs"), ({"c/x.bin": "0"}, "not there"), ({"x.bin": digest(b"1")}, "several")):
        with pytest.raises(ValueError, match=said):
            readers.verify_digests(spark, str(tmp_path), bad)
