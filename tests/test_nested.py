"""Nested documents, reinforcement items, and conversations under a chat template."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from taxonaut.functions import nested
from taxonaut.operators import census, conversations, export, rft


def variants(spark, documents):
    return spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "i int, t string").select("i", F.parse_json("t").alias("v"))


def test_absent_null_and_present_fields(spark):
    documents = [{"a": {"b c": 1}}, {"a": {"b c": None}}, {"a": {}}, {"a": None}, {"a": [1]}, {}, None, {"a": {"b c": {"x": 1}}}, {"a": {"b c": ""}}, "[]", {"a.b c": 2}]
    got = variants(spark, documents).select("i", nested.get(F.col("v"), "a.b c").alias("g"), nested.label(F.col("v"), "a.b c").alias("l")).orderBy("i").collect()
    assert [r["g"]["state"] for r in got] == ["present", "null"] + ["missing"] * 5 + ["present", "present", "missing", "missing"]
    assert [r["l"] for r in got][:3] == ["1", "", ""] and got[7]["l"] == '{"x":1}' and got[0]["g"]["value"] == "1"
    for key in ("", "it's"):
        with pytest.raises(ValueError):
            nested.get(F.col("v"), key)


def walk(x, path, out):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(x)]
    out[path][kind] += 1
    for key, value in x.items() if isinstance(x, dict) else (("", v) for v in x) if isinstance(x, list) else ():
        walk(value, f"{path}.{key}" if isinstance(x, dict) else f"{path}[]", out)


def test_census(spark):
    random.seed(7)

    def document(level):
        pick = random.random()
        if level == 5 or pick < 0.4:
            return random.choice([1, 2.5, "x<y>", True, None, [], {}])
        return [document(level + 1) for _ in range(random.randint(0, 3))] if pick < 0.6 else {k: document(level + 1) for k in random.sample(["a", "b<", "c d", "`e`"], 2)}

    documents = [document(0) for _ in range(150)]
    expected = collections.defaultdict(collections.Counter)
    for d in documents:
        walk(d, "$", expected)
    got = {r["path"]: (r["kinds"], r["n"], r["nulls"]) for r in census.census(variants(spark, [json.dumps(d) for d in documents] + [None]), "v").collect()}
    assert got == {p: (sorted(c), sum(c.values()), c["null"]) for p, c in expected.items()}
    assert census.census(variants(spark, [None]), "v").isEmpty()
    deep = "[" * 40 + "]" * 40
    with pytest.raises(ValueError, match="levels"):
        census.census(variants(spark, [deep]), "v")


def item(i, **changes):
    base = {"id": i, "metadata": {f: "" for f in export.METADATA_LABELS}, "classification": {f: None for f in rft.LEVELS}, "data_level": None}
    base["metadata"]["field_name"] = f" f{i} "
    base["classification"]["level_1"] = "top"
    return base | changes


BARE = {f: " " for f in rft.LEVELS}


def test_rft_items(spark, tmp_path):
    path = str(tmp_path / "rft")
    items = [item(1, data_level="L2"), item("two", label_status="labeled"), item(3), item(4, classification=BARE), item(5, classification=BARE, label_status="unlabeled"), item(6, label_status="odd")]
    frame = variants(spark, items).select(F.col("v").alias("item"), F.get(F.array(*[F.lit(s) for s in ("train", "val", "test", "train", "val", "test")]), F.col("i")).alias("split"))
    report = rft.export_rft(frame, path)
    assert report["splits"] == {"train": {"input_records": 2, "exported_records": 1, "skipped_unlabeled": 1}, "val": {"input_records": 2, "exported_records": 1, "skipped_unlabeled": 1}, "test": {"input_records": 2, "exported_records": 2, "skipped_unlabeled": 0}}
    lines = {r["value"]: r["split"] for r in spark.read.text(path).collect()}
    first = next(json.loads(line) for line, split in lines.items() if split == "train")
    assert list(first) == ["messages", "reference_answer", "reference_answer_json", "source_id"] and first["source_id"] == "1"
    assert first["messages"] == [{"role": "developer", "content": rft.DEVELOPER_PROMPT}, {"role": "user", "content": f"{export.USER_HEAD}\n{export.METADATA_LABELS['field_name']}：f1"}]
    assert json.loads(first["reference_answer_json"]) == first["reference_answer"] == {"classification": {"level_1": "top", "level_2": "", "level_3": "", "level_4": ""}, "data_level": "L2"}
    bad = [
        (item(7, label_status="unlabeled"), "7 is unlabeled but has a label"), (item(8, classification=BARE, label_status="labeled"), "8 is labeled but all levels"), (item(9, metadata=[1]), "invalid metadata"),
        (item(10, classification=None), "invalid classification"), (item(11, metadata={"value": 1}), "missing metadata fields: database_name"), (item(12, classification={"level_1": "x"}), "missing classification fields: level_2, level_3, level_4"), ({}, "<unknown>"),
    ]
    for wrong, said in bad:
        with pytest.raises(Exception, match=said):
            rft.export_rft(frame.union(variants(spark, [wrong]).select("v", F.lit("train"))), path, overwrite=True)
    with pytest.raises(ValueError, match="no labelled items in val"):
        rft.export_rft(frame.where("split <> 'val'"), path, overwrite=True)
    assert spark.read.text(path).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["rft"]


def test_message_tokens_of_every_shape(spark):
    class Tensor:
        def __init__(self, ids):
            self.ids = ids

        def numel(self):
            return len(self.ids)

    class Array:
        def __init__(self, ids):
            self.ids = ids

        def tolist(self):
            return self.ids

    class Tokenizer:
        """A template of one token a message besides words; the shape of what it returns depends on the first role."""

        def apply_chat_template(self, messages, tokenize, add_generation_prompt):
            assert tokenize and not add_generation_prompt
            ids = [0 for m in messages for _ in ["<s>", *(m["content"] or "").split()]]
            shape = messages[0]["role"] if messages else "list"
            return {"list": ids, "batch": [ids], "mapping": {"input_ids": ids}, "nested": collections.UserDict(input_ids=[ids]), "tensor": Tensor(ids), "array": Array([ids]), "none": None, "many": [ids, ids], "odd": {"x": ids}}[shape]

    said = lambda role: [(role, "a b c"), ("user", None), ("assistant", "d")]
    shapes = ["list", "batch", "mapping", "nested", "tensor", "array"]
    frame = lambda roles: spark.createDataFrame([(i, said(r)) for i, r in enumerate(roles)], "i int, messages array<struct<role:string,content:string>>")
    rows = frame(shapes).union(spark.createDataFrame([(9, [])], "i int, messages array<struct<role:string,content:string>>")).withColumn("tokens", F.lit("old"))
    got = {r["i"]: r["tokens"] for r in conversations.message_tokens(rows, "messages", Tokenizer).collect()}
    assert got == {**{i: 7 for i in range(len(shapes))}, 9: 0}
    for wrong, text in (("none", "no input_ids"), ("many", "several rows"), ("odd", "no input_ids")):
        with pytest.raises(Exception, match=text):
            conversations.message_tokens(frame([wrong]), "messages", Tokenizer).collect()
    with pytest.raises(Exception, match="without messages"):
        conversations.message_tokens(rows.withColumn("messages", F.when(F.col("i") > 0, F.col("messages"))), "messages", Tokenizer).collect()


def test_conversations_add_up_and_budgets(spark):
    turns = [("c", "user", "a b"), ("c", None, None), ("d", "user", "x" * 50), (None, "user", "y")]
    count = lambda text: text.count("<|") + len(text)
    got = {r["k"]: (r["turns"], r["chars"], r["tokens"]) for r in conversations.conversation_tokens(spark.createDataFrame(turns, "k string, r string, t string"), "k", "r", "t", count).collect()}
    one = lambda role, text: 2 + len(f"<|im_start|>{role}\n{text}<|im_end|>\n")
    assert got == {"c": (2, 3, one("user", "a b") + one("", "")), "d": (1, 50, one("user", "x" * 50)), None: (1, 1, one("user", "y"))}
    rows = spark.createDataFrame([("train", "b", 9), ("train", "a", 9), ("train", "c", 1), ("val", "d", 2)], "split string, id string, tokens long")
    assert {r["split"]: tuple(r)[1:] for r in conversations.budget(rows, "split", "id", "tokens", 8).collect()} == {"train": (3, 9, "a", 2), "val": (1, 2, "d", 0)}
    with pytest.raises(ValueError):
        conversations.budget(rows, "split", "id", "tokens", 0)
