"""Operators on small tables: status order, contracts, splits, scoring, exports."""

import json
import re

import pytest
from pyspark.sql import functions as F

from taxonaut.operators import choices, corpus, export, preprocess, profile, resolve, scoring, splits, standards

RAW = "n long, t string, f string, ty string, l1 string, l4 string, g string"
MAPPING = {"t": "table_name", "f": "field_name", "ty": "field_type", "l1": "level_1", "l4": "level_4", "g": "data_level"}


def test_preprocess(spark):
    rows = [(0, "T", "a", "int(4)", "x", "y（A1）", "1"), (1, " T ", "a　", "INT", "x", "y", "L1"), (2, "T", " ", "", "", "", ""), (3, "T", "b", "", "", "", "")]
    out = preprocess.preprocess(spark.createDataFrame(rows, RAW), MAPPING, "F.csv", "n").orderBy("key").collect()
    assert [(r["metadata"]["field_name"], r["label_status"], r["classification"]["level_4"]) for r in out] == [("a", "labeled", "y"), ("b", "unlabeled", "")]
    with pytest.raises(ValueError, match="field_name"):
        preprocess.preprocess(spark.createDataFrame(rows, RAW), MAPPING, "f", "n", missing_field="error")
    with pytest.raises(ValueError, match="conflicting"):
        preprocess.preprocess(spark.createDataFrame([rows[0], (9, "T", "a", "int", "z", "y", "1")], RAW), MAPPING, "f", "n")
    with pytest.raises(ValueError, match="not there"):
        preprocess.convert_schema(spark.createDataFrame(rows, RAW), {"zz": "level_1"})


def test_resolution_order(spark):
    config = resolve.DatasetConfig("d", path_fields=("level_1", "level_4"), placeholders=("——",))
    rows = [("1", "unlabeled", "a", "x"), ("2", "labeled", "a", " "), ("3", "labeled", "a", "——"), ("4", "labeled", "a", "x"), ("5", "labeled", "b", "x"), ("6", None, "a", "q")]
    registry = spark.createDataFrame([("d:a.x", "x")], "category_id string, name string")
    got = {r["id"]: r for r in resolve.canonical(spark.createDataFrame(rows, "id string, label_status string, level_1 string, level_4 string"), config, registry).collect()}
    assert [got[str(i)]["resolution_status"] for i in range(1, 7)] == ["unlabeled", "invalid_record", "placeholder", "resolved", "path_mismatch", "missing_leaf"]
    assert got["4"]["target"]["category_path"] == ["a", "x"] and got["5"]["target"] is None
    spaces = [(str(i), f"{s}Unlabeled{s}" if i % 2 else "labeled", "a", f"{s}——{s}" if i % 4 == 2 else s) for i, s in enumerate("\u3000\u00a0\t\n\u2003\x1f")]
    got = {r["id"]: r["resolution_status"] for r in resolve.resolve(spark.createDataFrame(spaces, "id string, label_status string, level_1 string, level_4 string"), config).collect()}
    assert [got[str(i)] for i in range(6)] == ["invalid_record", "unlabeled", "placeholder", "unlabeled", "invalid_record", "unlabeled"]
    with pytest.raises(ValueError):
        resolve.DatasetConfig("d", id_strategy="other")


def test_display_names(spark):
    rows = [("1", "x", ["a", "x"]), ("2", "x", ["b", "x"]), ("3", "y", ["b", "y"]), ("4", "z", ["p", "q", "z"]), ("5", "z", ["r", "q", "z"]), ("6", "w", []), ("7", "w", [])]
    got = {r["category_id"]: r["display_name"] for r in choices.display_names(spark.createDataFrame(rows, "category_id string, name string, path array<string>")).collect()}
    assert got == {"1": "a / x", "2": "b / x", "3": "y", "4": "p / q / z", "5": "r / q / z", "6": None, "7": None}


def test_bundle_has_every_position(spark):
    ids = list("ABCDEF")
    rows = spark.range(300).select(F.col("id").cast("string").alias("s"), choices.candidate_bundle(F.lit("C"), ids, F.col("id").cast("string")).alias("c")).collect()
    assert {r["c"].index("C") for r in rows} == set(range(5))
    assert all(sorted(r["c"]) == list("ABCDE") for r in rows)


@pytest.mark.parametrize("junk", ["", "[]", "null", '{"answer":1}', '{"answer":"1"} x', "{'answer':'1'}", '{"answer":"1","b":2}', '{"answer":["1"]}', "NaN", '{"answer":"1"', None])
def test_bad_output_never_raises(spark, junk):
    row = scoring.parse_stage2(spark.createDataFrame([(junk,)], "o string"), "o").first()
    assert not row["format_valid"] and not row["contract_valid"] and row["answer"] is None


def test_parsing(spark):
    df = spark.createDataFrame([('{"answer":"2"}', list("abcde")), ('{"answer":"7"}', list("abcde")), ('{"answer":"1","answer":"5"}', list("abcde"))], "o string, c array<string>")
    assert [(r["contract_valid"], r["decoded"]) for r in scoring.parse_stage2(df, "o", "c").collect()] == [(True, "b"), (False, None), (True, "e")]
    one = spark.createDataFrame([(json.dumps({"candidates": list(x)}),) for x in ("12345", "11234", "1234", "1234x")], "o string")
    assert [r["contract_valid"] for r in scoring.parse_stage1(one, "o", list("1234567")).collect()] == [True, False, False, False]


def test_p95_rank(spark):
    for n in (1, 2, 19, 20, 21, 100):
        rows = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") * 7 % 101).alias("v"))
        values = sorted(i * 7 % 101 for i in range(n))
        assert scoring.legacy_p95(rows, "g", "v").first()["p95"] == values[max(0, int(0.95 * n) - 1)]


def test_splits(spark):
    assert splits.allocate(10, (0.8, 0.1, 0.1)) == [8, 1, 1] and splits.allocate(1, (0.2, 0.4, 0.4)) == [1, 0, 0]
    rows = spark.range(103).select("id", (F.col("id") % 7).cast("string").alias("g"), (F.col("id") % 3).cast("string").alias("l"))
    parts = splits.split_random(rows, "id", ["l"])
    assert {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()} == dict(zip(splits.SPLITS, splits.allocate(103, (0.8, 0.1, 0.1))))
    assert parts.orderBy("id").collect() == splits.split_random(rows, "id", ["l"]).orderBy("id").collect()
    grouped = splits.split_groups(rows, "g", ["l"])
    assert grouped.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert splits.overlap(grouped, "g", "split").isEmpty() and grouped.count() == 103
    with pytest.raises(ValueError):
        splits.split_groups(rows.withColumn("g", F.lit("")), "g", ["l"])


def test_split_random_keeps_every_row(spark, monkeypatch):
    """Null and repeated keys stay once, sizes are exact, and no row passes through the driver."""
    rows = spark.range(200).select(F.when(F.col("id") % 10 > 0, F.floor(F.col("id") / 2)).alias("id"), (F.col("id") % 3).alias("l"), F.col("id").alias("x"))
    monkeypatch.setattr(type(rows), "toLocalIterator", None)
    parts = splits.split_random(rows, "id", ["l"]).collect()
    assert sorted(r["x"] for r in parts) == list(range(200))
    sizes = [sum(r["split"] == s for r in parts) for s in splits.SPLITS]
    assert sizes == splits.allocate(200, (0.8, 0.1, 0.1))
    for l in range(3):
        own = [r["split"] for r in parts if r["l"] == l]
        assert all(abs(own.count(s) - len(own) * r) < 2 for s, r in zip(splits.SPLITS, (0.8, 0.1, 0.1)))
    assert splits.split_random(rows.limit(0), "id", ["l"]).isEmpty()


def test_groups_are_dealt_by_what_splits_lack(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    size = np.sort(rng.integers(1, 60, 400))[::-1]
    ones = rng.binomial(size, 0.3)
    counts = np.column_stack([size, ones, size - ones])
    chosen = splits.deal_groups(counts, (0.8, 0.1, 0.1))
    for i, r in enumerate((0.8, 0.1, 0.1)):
        assert np.allclose(counts[chosen == i].sum(axis=0), counts.sum(axis=0) * r, rtol=0.05)
    assert sorted(splits.deal_groups(np.array([[9], [1], [1]]), (0.8, 0.1, 0.1)).tolist()) == [0, 1, 2]


def test_canonical_rows_are_required(spark):
    members = spark.createDataFrame([("a", "train"), ("b", "val")], "id string, split string")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, x int")
    assert splits.joined_canonical(members, rows, "id").count() == 2
    for m, c, said in ((members, rows.where("id <> 'b'"), "no canonical row"), (members.union(spark.createDataFrame([("\u3000", "test")], members.schema)), rows, "split rows without"), (members, rows.union(rows), "repeat")):
        with pytest.raises(ValueError, match=said):
            splits.joined_canonical(m, c, "id")
    labelled = members.withColumn("l", F.col("id"))
    assert [tuple(r) for r in splits.missing_labels(labelled, "split", ["l"]).collect()] == [("l", "val", "b", 1)]


def test_standards(spark):
    rows = [(1, "a", "b", "名", "3"), (2, "a", "b", "", "1"), (3, "a", "b", "——", "1"), (4, "a", "", "名", "3 4")]
    out = standards.build_entries(spark.createDataFrame(rows, "n int, x string, y string, z string, g string"), "s", ["x", "y", "z"], ["x", "z"], "n", "g").orderBy("n").collect()
    assert [(r["standard_entry_id"], r["category_id"], r["issue"]) for r in out] == [("s:a.b.名", "s:a.名", None), ("s:a.b.", "s:a.", "empty_leaf"), ("s:a.b.——", "s:a.——", "placeholder"), ("s:a..名", "s:a.名", "unknown_level")]
    catalog = standards.build_catalog(spark.createDataFrame([(1, "叶（A1）", "x"), (2, "", "上（B）"), (3, "无", "x")], "n int, leaf string, up string"), "g", "leaf", "up", "n").orderBy("n").collect()
    assert [(r["category_id"], r["name"], r["issue"]) for r in catalog] == [("A1", "叶", None), ("B", "上", None), (None, "无", "no_code")]


def test_corpus(spark):
    guide = spark.createDataFrame([(1, "x（A）", "t"), (2, "x", " t "), (3, "", "t"), (4, "x", None)], "n int, l string, c string")
    assert [(r["n"], r["first_row"]) for r in corpus.documents(guide, "d", "n", "l", "c").orderBy("n").collect()] == [(1, 1), (2, 1)]
    assert corpus.skipped(guide, "l", "c").count() == 2


def test_profiles_take_empty_tables(spark):
    empty = spark.createDataFrame([], "level_1 string, level_2 string, n int")
    assert profile.levels(empty, ["level_1"]).isEmpty() and profile.patterns(empty, ["level_1"]).isEmpty() and profile.top_paths(empty, ["level_1"], "n").isEmpty()
    assert resolve.coverage(spark.createDataFrame([], "resolution_status string")).first()["rate"] == 0.0


def test_export_and_checks(spark):
    ids = list("ABCDEF")
    corpus_rows = spark.createDataFrame([(c, f"name {c}", None) for c in ids], "category_id string, name string, description string")
    rows = spark.createDataFrame([("s1", "B", 'v"1'), ("s2", "F", None)], "source_id string, truth string, v string")
    staged = export.stage_rows(rows, ids, [f"name {c}" for c in ids], corpus_rows, {"v": F.col("v")})
    sft = export.sft_rows(staged)
    assert sft.count() == 4 and export.check_sft(sft, ids, staged).isEmpty()
    # Prompts and answers do not move: rows and samples meet by digests.
    optimized = export.check_sft(sft, ids, staged)._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1].split(":- ", 1)[1]
    assert re.match(r"Project \[source_id#\d+", optimized) and not re.search(r"[\[ ](messages|system|user|answer)#\d+[,\]]", optimized.split("\n")[0])
    assert set(export.check_sft(sft.withColumn("messages", F.transform("messages", lambda m: m.withField("content", F.concat(m["content"], F.lit("x"))))), ids, staged).first()["errors"]) == {"system prompt differs", "user prompt differs", "answer differs"}
    bad = sft.withColumn("ground_truth", F.lit("Z"))
    assert export.check_sft(bad, ids, staged).first()["errors"][0] == "ground truth is not in the registry"
    nulls = sft.withColumns({c: F.lit(None).cast(sft.schema[c].dataType) for c in ("stage", "messages", "ground_truth", "metadata")})
    assert {"unknown stage", "blank message", "no such sample"} <= set(export.check_sft(nulls, ids, staged).first()["errors"])
    two = staged.where("stage = 'stage2' and source_id = 's1'").first()
    bundle = json.loads(two["user"].split("\n")[1])
    assert [b["name"] for b in bundle] == [f"name {c}" for c in two["candidates"]] and two["candidates"][int(json.loads(two["answer"])["answer"]) - 1] == "B"
    assert json.loads(two["user"].split("\n")[-1]) == {"v": 'v"1'}
    assert set(export.rl_rows(staged, "x").columns) == {"data_source", "prompt", "ability", "reward_model", "extra_info"}
    with pytest.raises(Exception, match="not in the corpus"):
        choices.bundle_rows(rows.withColumn("candidates", F.array(F.lit("Q"))), corpus_rows, "source_id").collect()


def test_reinforcement_rows_and_pairs(spark):
    ids = list("ABCDEF")
    corpus_rows = spark.createDataFrame([(c, c, None) for c in ids], "category_id string, name string, description string")
    staged = export.stage_rows(spark.createDataFrame([("s1", "B"), ("s2", "F")], "source_id string, truth string"), ids, ids, corpus_rows, {"v": F.col("source_id")})
    rl = export.rl_rows(staged, "x")
    assert export.check_rl(rl, ids, "x", staged).isEmpty() and export.check_rl(rl, ids[:2], "y", staged).count() == 4
    sft = export.sft_rows(staged)
    assert export.unpaired(sft).isEmpty()
    assert [r["source_id"] for r in export.unpaired(sft.where("not (source_id = 's2' and stage = 'stage1')")).collect()] == ["s2"]


def test_completions(spark):
    rows = spark.createDataFrame([("stage2", "a", "sys", "u1"), ("stage2", "b", "sys", None)], "stage string, source_id string, s string, u string")
    made = scoring.generated(rows, "s", "u", lambda s, u: u.upper())
    assert [r["completion"] for r in made.orderBy("source_id").collect()] == ["U1", None]
    done = spark.createDataFrame([("stage2", "a", "old", 0), ("stage2", "a", "new", 1)], "stage string, source_id string, completion string, n int")
    assert scoring.join_completions(rows.where("source_id = 'a'"), done, "n").first()["completion"] == "new"
    with pytest.raises(Exception, match="no completion for stage2 of b"):
        scoring.join_completions(rows, done, "n").collect()


IDS = list("ABCDEFG")
CHOICES = {str(i + 1): c for i, c in enumerate(IDS)}


@pytest.mark.parametrize(
    "said, errors",
    [
        (None, [scoring.NOT_AN_OBJECT]),
        ("[]", [scoring.NOT_AN_OBJECT]),
        ('{"candidates":[],"b":1}', [scoring.OTHER_KEYS["candidates"]]),
        ('{"candidates":["1",2]}', [scoring.WRONG_TYPE["candidates"]]),
        ('{"candidates":[]}', [scoring.WRONG_COUNT.format(5)]),
        ('{"candidates":["1","1","x","y"]}', [scoring.WRONG_COUNT.format(5), scoring.REPEATED, "choice id 'x' is not in the prompt catalog", "choice id 'y' is not in the prompt catalog"]),
        ('{"candidates":["7","6","5","4","3"]}', []),
    ],
)
def test_stage1_errors(spark, said, errors):
    row = scoring.parse_stage1(spark.createDataFrame([(said,)], "o string"), "o", CHOICES).first()
    assert row["errors"] == errors and row["contract_valid"] == (not errors)
    assert row["decoded"] == (list("GFEDC") if not errors else None)


def test_evaluation_and_rewards(spark):
    rows = [("A", '{"answer":"A"}'), ("A", '{"answer":"B"}'), ("A", '{"answer":"G"}'), ("A", "x"), ("G", '{"answer":"B"}')]
    df = spark.createDataFrame([(t, a, IDS[:5]) for t, a in rows], "t string, o string, c array<string>")
    judged = scoring.rewarded(scoring.evaluate_stage2(df, "o", "t", "c", IDS, local=False), "stage2").collect()
    assert [(r["reward"], r["task_correct"]) for r in judged] == [(1.0, True), (0.5, False), (0.0, False), (0.0, False), (0.5, False)]
    assert [r["reason"] for r in judged[1:4]] == ["stage2 answer is valid but wrong", "stage2 answer is not one of the candidates", "stage2 output is not a valid JSON object with schema answer"]
    for truth, five in (("Z", IDS[:5]), ("A", IDS[:4]), ("A", ["A"] * 5), (None, IDS[:5]), ("A", None)):
        with pytest.raises(Exception, match="must belong"):
            scoring.evaluate_stage2(spark.createDataFrame([(truth, '{"answer":"1"}', five)], df.schema), "o", "t", "c", IDS).collect()
    with pytest.raises(Exception, match="ground truth"):
        scoring.evaluate_stage1(spark.createDataFrame([("Z", "x")], "t string, o string"), "o", "t", IDS).collect()
    with pytest.raises(ValueError):
        scoring.rewarded(df, "stage3")
    assert scoring.evaluate_stage1(df.limit(0), "o", "t", IDS).count() == 0


def test_rows_of_unknown_stages_raise(spark):
    row = [("s", "stage3", "A", IDS[:5], "{}")]
    with pytest.raises(Exception, match="stage must be"):
        scoring.evaluate_rows(spark.createDataFrame(row, "source_id string, stage string, truth string, candidates array<string>, completion string"), CHOICES).collect()


def test_two_steps_answer_from_predicted_candidates(spark):
    corpus_rows = [(c, f"name {c}", None) for c in IDS[:6]]
    known = spark.createDataFrame(corpus_rows, "category_id string, name string, description string")
    rows = spark.createDataFrame([("good", "C", "{}"), ("lost", "A", "{}"), ("absent", "G", "{}"), ("junk", "A", "{}")], "source_id string, truth string, metadata string").withColumn("metadata", F.to_json(F.struct(F.col("source_id").alias("s"))))

    def model(system, user):
        if system == choices.STAGE1_SYSTEM:
            picks = {"good": "65432", "lost": "65432", "absent": "76543"}
            return next((json.dumps({"candidates": list(p)}) for s, p in picks.items() if s in user), "no")
        assert '"id":"1","name":"name F","description":""' in user
        return '{"answer":"4"}'

    got = {r["source_id"]: r for r in scoring.two_step(rows, CHOICES, IDS, known, model).collect()}
    assert got["good"]["correct"] and got["good"]["final"] == "C" and got["good"]["predicted"] == list("FEDCB")
    assert got["lost"]["attempted"] and not got["lost"]["recalled"] and not got["lost"]["correct"]
    assert not got["absent"]["attempted"] and got["absent"]["recalled"] and got["absent"]["final"] is None and "corpus" in got["absent"]["failures"][0]
    assert got["junk"]["failures"] == [scoring.NOT_AN_OBJECT] and not got["junk"]["attempted"]
    none = scoring.two_step_metrics(scoring.two_step(rows.limit(0), CHOICES, IDS, known, model)).first()
    assert none["sources"] == 0 and none["e2e_accuracy"] == 0.0


def test_dictionaries(spark):
    rows = [(1, "k1", "车辆（A1-1）"), (2, "k2", "NaN"), (3, "k3", None), (4, "k4", " 无 码 "), (5, "k5", "别名[A1-1]"), (6, " ", "别名[A1-1]"), (7, "k7", "别名[A1-1]")]
    parsed = corpus.code_dictionary(spark.createDataFrame(rows, "n int, k string, c string"), "d", "n", "k", "c")
    assert [r["issue"] for r in parsed.orderBy("order").collect()] == [None, "malformed_skipped", "malformed_skipped", "no_code", None, None, None]
    built = {r["category_id"]: r for r in corpus.build_corpus(parsed).collect()}
    assert set(built) == {"A1-1", "d:无码"}
    assert (built["A1-1"]["name"], built["A1-1"]["description"], built["A1-1"]["descriptions"], built["A1-1"]["extra"]) == ("车辆", "k1", ["k5", "k7"], 3)
    assert corpus.build_report(parsed).first().asDict() == {"entries": 7, "categories": 2, "kinds": 1, "instances": 3, "malformed_skipped": 2, "no_code": 1, "unexpected_format": 0}
    paths = [(1, "k", "甲 - 乙-丙"), (2, "k", "甲--丙"), (3, "k", ""), (4, "k", "单"), (5, "k", "甲-")]
    got = {r["order"]: r for r in corpus.path_dictionary(spark.createDataFrame(paths, "n int, k string, c string"), "f", "n", "k", "c").collect()}
    assert (got[1]["category_id"], got[1]["path"], got[1]["name"]) == ("f:甲.乙.丙", ["甲", "乙", "丙"], "丙")
    assert [got[i]["issue"] for i in range(1, 6)] == [None, "unexpected_format", "malformed_skipped", "unexpected_format", "unexpected_format"]
    assert got[2]["category_id"] == "f:甲--丙" and got[3]["category_id"] is None
    leaves = spark.createDataFrame([(" b ",), ("a",), ("a",), (None,), ("　",)], "leaf string")
    assert sorted(r["category_id"] for r in corpus.universe(leaves, "u", "leaf").collect()) == ["u:a", "u:b"]
    assert corpus.build_report(parsed.limit(0)).first()["entries"] == 0


def test_training_targets(spark):
    schema = "resolution_status string, target struct<category_id:string,leaf_name:string>"
    registry = spark.createDataFrame([("i", "n")], "category_id string, name string")
    rows = [("resolved", (" i ", "n　")), ("placeholder", None), (None, None), ("missing_leaf", ("i", "other"))]
    assert sorted(str(r["truth"]) for r in resolve.training_target(spark.createDataFrame(rows, schema), registry).collect()) == ["None", "None", "None", "i"]
    for target, said in ((None, "without a target"), ((" ", "n"), "empty"), (("j", "n"), "not in the leaf registry"), (("i", "m"), "leaf_name"), (("i", None), "leaf_name")):
        with pytest.raises(Exception, match=said):
            resolve.training_target(spark.createDataFrame([("resolved", target)], schema), registry).collect()


def test_entry_paths(spark):
    words = profile.vocabulary(spark.createDataFrame([("甲 ", "乙", "叶"), ("", "丁", "")], "a string, b string, c string"), ["a", "b", "c"])
    assert words.count() == 4
    rows = [(1, "甲-乙-叶"), (2, "甲-别-叶"), (3, "丁-乙-叶"), (4, "叶"), (5, "甲-x"), (6, None), (7, "a-b")]
    got = {r["k"]: (r["path"], r["leaf"]) for r in profile.entry_paths(spark.createDataFrame(rows, "k int, c string"), "k", "c", words).collect()}
    assert got[1] == (["甲", "乙", "叶"], "叶") and got[2] == (["甲", "别", "叶"], "叶")
    assert got[3] == (None, "丁-乙-叶") and got[4] == (None, "叶") and got[5] == (None, "甲-x") and got[6] == (None, "") and got[7] == (None, "a-b")


def test_alignment_report(spark):
    samples = spark.createDataFrame([("a", "L1"), ("a", "L2"), ("b", "L1"), ("z", "L1"), (None, "L1")], "category_id string, data_level string")
    categories = spark.createDataFrame([("a", ["L1"]), ("b", [])], "category_id string, levels array<string>")
    row = standards.alignment_report(standards.align(samples, categories)).first()
    assert row.asDict() == {"samples": 5, "matched": 1, "mismatched": 1, "missing": 1, "unavailable": 1, "unresolved": 1, "match_rate": 0.25}
