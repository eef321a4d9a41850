"""Exports of whole datasets, their contracts as one scan, and publications that break off."""

import json

import pytest
from pyspark.sql import functions as F

from taxonaut.operators import choices, contract, datasets, export, ordered, splits
from taxonaut.plans import training
from taxonaut.sources import writers

CANONICAL = "id string, resolution_status string, target struct<leaf_level:string,leaf_name:string,category_id:string,category_path:array<string>>, note string, split string"
IDS = [f"C{i}" for i in range(7)]


@pytest.fixture(scope="module")
def catalogue(spark):
    registry = spark.createDataFrame([(c, f"leaf {c[1]}", ["top", f"leaf {c[1]}"], i) for i, c in enumerate(IDS)], "category_id string, name string, path array<string>, ord int")
    corpus = spark.createDataFrame([(c, f"leaf {c[1]}", None if c == "C3" else f"about {c} 类") for c in [*IDS, "C99"]], "category_id string, name string, description string")
    return datasets.Catalogue.of(registry, corpus, "ord")


def row(i, category=None, name=None, status=None):
    target = None if category is None else ("level_4", name or f"leaf {category[1:]}", category, [])
    return (i, status or ("resolved" if target else "missing_leaf"), target, f"note {i}", "own")


def frames(spark, canonical, members):
    return spark.createDataFrame(canonical, CANONICAL).repartition(3), spark.createDataFrame(members, "id string, split string").repartition(2)


GOOD = [row("a", "C0"), row("b", "C1"), row(" c ", "C2"), row("d", "C3"), row("e"), row("f"), row("g", "C4"), row(None), row(" "), row("")]
MEMBERS = [("a", "train"), ("b", "val"), ("c", "test"), ("d", "train"), ("e", "train"), ("f", "test")]


def test_export_counts_what_it_writes(spark, catalogue, tmp_path):
    path = str(tmp_path / "sft")
    canonical, members = frames(spark, GOOD, MEMBERS)
    report = datasets.export_dataset(canonical, members, catalogue, {"note": F.col("note")}, path, datasets.sft)
    assert report["splits"] == {
        "train": {"split_records": 3, "exported_rows": 4, "skipped_not_resolved": 1},
        "val": {"split_records": 1, "exported_rows": 2, "skipped_not_resolved": 0},
        "test": {"split_records": 2, "exported_rows": 2, "skipped_not_resolved": 1},
    }
    assert (report["canonical_resolved"], report["trainable_resolved"], report["resolved_outside_splits"], report["idless_non_resolved_records"], report["registry_size"]) == (5, 4, 1, 3, 7)
    assert json.loads((tmp_path / "sft" / datasets.REPORT).read_text()) == report
    written = spark.read.parquet(path)
    assert {(r["source_id"], r["split"]) for r in written.collect()} == {("a", "train"), ("b", "val"), ("c", "test"), ("d", "train")}
    first = written.where("source_id = 'd' and stage = 'stage2'").first()
    assert '"name":"leaf 3","description":""' in first["messages"][1]["content"] and '{"note":"note d"}' in first["messages"][1]["content"]
    assert [r["source_id"] for r in datasets.outside_splits(canonical, members, catalogue).collect()] == ["g"]
    with pytest.raises(FileExistsError):
        datasets.export_dataset(canonical, members, catalogue, {}, path, datasets.sft)
    # A member of two splits is exported in both and counted once.
    twice = datasets.export_dataset(*frames(spark, GOOD, [*MEMBERS, ("a", "test")]), catalogue, {"note": F.col("note")}, path, datasets.rl("d"), overwrite=True)
    assert twice["trainable_resolved"] == 4 and twice["splits"]["test"]["exported_rows"] == 4
    again = spark.read.parquet(path)
    assert again.count() == 10 and {r[0] for r in again.select("data_source").distinct().collect()} == {"d/stage1", "d/stage2"}


@pytest.mark.parametrize("canonical, members, said", [
    (GOOD, [*MEMBERS, ("zz", "train")], "without a canonical row: zz"),
    (GOOD, [*MEMBERS, (" ", "val")], "without an id: val"),
    (GOOD, [*MEMBERS, ("g", "dev")], "unknown split: dev"),
    (GOOD, [*MEMBERS, ("g", None)], "unknown split"),
    ([*GOOD, row("a", "C5")], MEMBERS, "repeat an id: a"),
    ([*GOOD, row("h", "C8")], MEMBERS, "not in the leaf registry: C8"),
    ([*GOOD, row("h", "C1", "other")], MEMBERS, "leaf_name"),
    ([*GOOD, row("h", status="resolved")], MEMBERS, "resolved without a target"),
    ([*GOOD, row(" ", "C1")], MEMBERS, "without an id, of category C1"),
    (GOOD, [m for m in MEMBERS if m[1] != "val"], "no resolved rows in val"),
])
def test_faults_raise_and_leave_no_file(spark, catalogue, tmp_path, canonical, members, said):
    path = tmp_path / "out"
    with pytest.raises(Exception, match=said):
        datasets.export_dataset(*frames(spark, canonical, members), catalogue, {"note": F.col("note")}, str(path), datasets.sft)
    assert list(tmp_path.iterdir()) == []


def test_a_corpus_must_cover_the_registry(spark, catalogue):
    with pytest.raises(ValueError, match="lacks categories of the registry: .'C6'"):
        choices.corpus_map(catalogue.corpus.where("category_id <> 'C6'"), catalogue.ids)
    with pytest.raises(ValueError, match="repeats"):
        choices.corpus_map(catalogue.corpus.union(catalogue.corpus.limit(1)))
    same = spark.createDataFrame([("A", "x", [], 0), ("B", "x", [], 1)], "category_id string, name string, path array<string>, ord int")
    with pytest.raises(ValueError, match="display name"):
        datasets.Catalogue.of(same, catalogue.corpus, "ord")


def test_bundles_without_a_join_equal_those_by_join(spark, catalogue):
    rows = spark.createDataFrame([(str(i), c) for i, c in enumerate(IDS * 3)], "source_id string, truth string").withColumn("candidates", choices.candidate_bundle(F.col("truth"), IDS, F.col("source_id")))
    by_join = choices.bundle_rows(rows, catalogue.corpus, "source_id")
    by_map = rows.select("source_id", choices.bundle(F.col("candidates"), choices.corpus_map(catalogue.corpus)).alias("bundle"))
    assert sorted(map(tuple, by_join.collect())) == sorted(map(tuple, by_map.collect()))
    with pytest.raises(Exception, match="not in the corpus: Q"):
        rows.select(choices.bundle(F.array(F.lit("Q")), choices.corpus_map(catalogue.corpus))).collect()
    # Two rows of one source are two samples, not four.
    staged = export.stage_rows(rows.limit(1).union(rows.limit(1)), IDS, list(catalogue.displays), catalogue.corpus, {"s": F.col("source_id")})
    assert staged.count() == 4


@pytest.fixture(scope="module")
def good_rows(spark, catalogue):
    rows = spark.createDataFrame([(str(i), IDS[i % 7], ("train", "val", "test")[i % 3]) for i in range(30)], "source_id string, truth string, split string")
    return export.stage_rows(rows, IDS, list(catalogue.displays), catalogue.corpus, {"n": F.col("source_id")}, ["split"])


def faults(df, declared, **how):
    return {(r["check"], r["split"]): (r["n"], r["samples"]) for r in contract.run(df, declared, **how).collect()}


def test_good_datasets_have_no_faults(spark, catalogue, good_rows):
    task = contract.Task(IDS, list(catalogue.displays), choices.corpus_map(catalogue.corpus), ["n"])
    assert faults(datasets.sft(good_rows), contract.sft_contract(task)) == {}
    assert faults(datasets.rl("d")(good_rows), contract.rl_contract(task, "d")) == {}
    assert {k for k in faults(datasets.sft(good_rows), contract.sft_contract(contract.Task(IDS, ["x"] * 7, task.described, ["m"])))} == {
        (name, s) for name in ("prompt is not that of registry and task", "metadata fields are not those of the task") for s in ("train", "val", "test")
    }


def test_answers_may_be_spaced_but_nothing_else(spark, catalogue, good_rows):
    task = contract.Task(IDS, list(catalogue.displays), choices.corpus_map(catalogue.corpus), ["n"])
    stage, answer = F.col("stage"), F.get(F.col("messages"), F.lit(2))["content"]
    rows = datasets.sft(good_rows)
    judge = lambda said: rows.select(task.answered(stage, said, F.col("ground_truth"), F.col("candidates")).alias("ok")).groupBy("ok").count().collect()
    assert [(r["ok"], r["count"]) for r in judge(F.replace(answer, F.lit(":"), F.lit(" : ")))] == [(True, 60)]
    for wrong in (F.concat(F.lit("x"), answer), F.replace(answer, F.lit("}"), F.lit(',"x":1}')), F.lit("[]"), F.lit(None).cast("string")):
        assert True not in {r["ok"] for r in judge(wrong)}


def test_contract_of_any_rows(spark):
    """Sums by kind, the smallest keys, keys in two splits, splits without rows and of no name, nulls everywhere."""
    rows = [(f"k{i:02}", "train", i) for i in range(20)] + [("k03", "val", 1), ("k04", "val", None), (None, "val", 50), (" ", "val", 50), ("k05", "dev", 1), ("k06", None, 1)]
    df = spark.createDataFrame(rows, "k string, part string, x int").withColumns({"_key": F.lit(1), "split": F.lit(2)})
    declared = contract.Contract([("large", F.col("x") > 15)], F.col("k"), {"_n": F.count("*"), "_x": F.max("x")}, [("odd", F.col("_x") % 2 == 1)])
    found = faults(df, declared, split="part", samples=2)
    assert found == {
        ("large", "train"): (4, ["k16", "k17"]), ("large", "val"): (3, ["", "k04"]), ("odd", "train"): (10, ["k01", "k03"]), ("odd", "val"): (2, ["k03", "k04"]),
        ("odd", "dev"): (1, ["k05"]), ("odd", ""): (1, ["k06"]), ("key in two splits", "train, val"): (2, ["k03", "k04"]),
        ("unknown split", "dev"): (1, ["k05"]), ("unknown split", ""): (1, ["k06"]), ("split has no rows", "test"): (1, []),
    }
    assert faults(df.limit(0), declared, split="part") == {("split has no rows", s): (1, []) for s in ("train", "val", "test")}


def state(spark, paths):
    return [spark.read.parquet(p).first()[0] if writers.exists(spark, p) else None for p in paths]


@pytest.mark.parametrize("fresh", [False, True])
def test_publications_that_break_leave_the_old_or_the_new_set(spark, tmp_path, monkeypatch, fresh):
    """Every rename and delete of a publication fails once; what is there after recovery is whole."""
    old, new = (spark.createDataFrame([(v,)], "v string").coalesce(1) for v in ("old", "new"))
    rename, delete = writers._rename, writers.delete
    seen = set()
    for step in range(20):
        folder = tmp_path / f"{fresh}{step}"
        folder.mkdir()
        paths = [f"{folder}/{n}" for n in "abc"]
        if not fresh:
            writers.publish(dict.fromkeys(paths, old))
        left = [step]

        def failing(action):
            def run(*args):
                left[0] -= 1
                if left[0] < 0:
                    raise OSError("broken off")
                return action(*args)

            return run

        monkeypatch.setattr(writers, "_rename", failing(rename))
        monkeypatch.setattr(writers, "delete", failing(delete))
        try:
            writers.publish(dict.fromkeys(paths, new), overwrite=True)
            ended = True
        except OSError:
            ended = False
        monkeypatch.setattr(writers, "_rename", rename)
        monkeypatch.setattr(writers, "delete", delete)
        writers.recover(spark, *paths)
        found = state(spark, paths)
        assert found in ([None] * 3 if fresh else ["old"] * 3, ["new"] * 3)
        seen.add(found[0])
        if ended:
            assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == ["a", "b", "c"]
            break
    assert ended and seen == {None if fresh else "old", "new"}


def test_a_failed_write_leaves_the_old_set(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.publish({path: spark.range(1)})
    with pytest.raises(Exception, match="no good"):
        writers.publish({path: spark.range(1).select(F.raise_error(F.lit("no good")).alias("x")), str(tmp_path / "more"): spark.range(1)}, overwrite=True)
    assert [p.name for p in tmp_path.iterdir()] == ["out"] and spark.read.parquet(path).count() == 1


@pytest.mark.parametrize("settings", [("3", "200")])
def test_random_splits_do_not_depend_on_partitions(spark, settings):
    rows = spark.range(2000).select("id", (F.col("id") % 5).alias("l"))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in settings:
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append({r["id"]: r["split"] for r in splits.split_random(rows, "id", ["l"]).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) == 2000


def test_small_groups_are_cut_in_spark(spark, monkeypatch):
    """With few large groups most are lined up; sizes and labels stay near their shares, groups whole, the hot group in train."""
    monkeypatch.setattr(splits, "LARGE", 50)
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 797).cast("string"))).alias("g"), (F.col("id") % 4).cast("string").alias("l"))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("2", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append({r["id"]: (r["g"], r["l"], r["split"]) for r in splits.split_groups(rows, "g", ["l"]).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) == 6000
    where = {}
    for g, _, split in found[0].values():
        assert where.setdefault(g, split) == split
    assert where["hot"] == "train"
    for share, split in zip((0.8, 0.1, 0.1), splits.SPLITS):
        own = [l for _, l, s in found[0].values() if s == split]
        assert abs(len(own) - 6000 * share) < 80 and all(abs(own.count(l) - 1500 * share) < 80 for l in "0123")
    for ratios in ((1.0, 0.0, 0.0), (0.5, 0.0, 0.5)):
        assert {s for s, r in zip(splits.SPLITS, ratios) if r} == {r["split"] for r in splits.split_groups(rows, "g", [], ratios).select("split").distinct().collect()}


def test_running_sums(spark):
    rows = [("hot" if i % 3 else None, i % 50, i, i % 7) for i in range(300)]
    found = {r["i"]: (r["before"], r["total"]) for r in ordered.running(spark.createDataFrame(rows, "k string, o int, i int, n long").repartition(4), ["k"], ["o", "i"], "n").collect()}
    for key in ("hot", None):
        own, sofar = sorted((o, i, n) for k, o, i, n in rows if k == key), 0
        for _, i, n in own:
            assert found[i] == (sofar, sum(x[2] for x in own))
            sofar += n


def test_split_datasets_report_and_publish(spark, tmp_path):
    path = str(tmp_path / "split")
    rows = spark.range(100).select("id", F.when(F.col("id") >= 5, (F.col("id") % 20).cast("string")).alias("g"), F.when(F.col("id") < 90, "common").when(F.col("id") == 99, "rare").alias("l"))
    report = splits.split_dataset(rows, path, ["l"], order="id")
    assert report["sizes"] == {"train": 80, "val": 10, "test": 10} and report["skipped_records"] == {"count": 0, "reasons": []} and report["input_size"] == 100
    assert sum(sum(d.values()) for d in report["distributions"]["l"].values()) == 100 and sum(report["distributions"]["l"][s].get("<EMPTY>", 0) for s in splits.SPLITS) == 9
    assert {w["type"] for w in report["warnings"]} <= {"labels_missing_from_train", "train_labels_missing_from_val", "train_labels_missing_from_test"} and any(w["labels"] == ["rare"] for w in report["warnings"])
    with pytest.raises(FileExistsError):
        splits.split_dataset(rows, path, ["l"], order="id")
    with pytest.raises(ValueError, match="rows without g"):
        splits.split_dataset(rows, path, ["l"], group="g", overwrite=True)
    assert spark.read.parquet(path).count() == 100
    report = splits.split_dataset(rows, path, ["l"], group="g", missing="skip", overwrite=True)
    assert (report["input_size"], report["included_size"], report["skipped_records"]["count"]) == (100, 95, 5) and json.loads((tmp_path / "split" / splits.REPORT).read_text()) == report
    assert splits.overlap(spark.read.parquet(path), "g", "split").isEmpty() and [p.name for p in tmp_path.iterdir()] == ["split"]
    for wrong in ({"order": "id", "group": "g"}, {}, {"order": "id", "missing": "drop"}, {"order": "id", "ratios": (0.0, 0.5, 0.5)}):
        with pytest.raises(ValueError):
            splits.split_dataset(rows, str(tmp_path / "x"), ["l"], **wrong)


def test_small_files_are_worked_on_by_all_cores(spark):
    sf = "/root/testdata/sf0.001"
    assert training._items(spark, sf).rdd.getNumPartitions() >= 16 and training._orders(spark, sf).rdd.getNumPartitions() >= 16


def test_prompts_are_written_a_split_at_a_time(spark, catalogue, tmp_path):
    """A write of prompts by split sorts them; of one split, it does not."""
    seen = []

    def rows(stages):
        seen.append(sorted(r[0] for r in stages.select("split").distinct().collect()))
        return datasets.sft(stages)

    datasets.export_dataset(*frames(spark, GOOD, MEMBERS), catalogue, {"note": F.col("note")}, str(tmp_path / "out"), rows)
    assert seen == [["train"], ["val"], ["test"]]
