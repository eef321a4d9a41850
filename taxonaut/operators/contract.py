"""Contracts of whole datasets: declared checks, compiled to one scan.

A contract holds checks of a row, checks of the rows of a key within a split, and the rule that splits share no
key. run() works all row checks out in the scan that reads the dataset, and adds them up beside the aggregates that the key checks
need in one aggregation by (key, split), combined on the map side; a second one by key brings the splits of a key together. From there on
only faults move. Every kind of fault comes with its count and the smallest few keys that have it, picked by a bounded top-k.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from taxonaut.functions.text import strip
from taxonaut.operators import choices
from taxonaut.operators.splits import SPLITS

#: Faults of a kind that are shown.
SAMPLES = 5
# Marks of a chat template that was written out.
TEMPLATE_MARKS = ("<|im_start|>", "<|im_end|>")


@dataclass(frozen=True)
class Contract:
    """What holds for a dataset.

    rows: (name, column that is true or null where a row breaks it); key: what rows are grouped by, blank or null
    keys take no part in checks of keys and splits; aggregates: name to aggregate over the rows of a key in a split;
    keys: (name, condition over the aggregates that is true where the key breaks it).
    """

    rows: Sequence[tuple[str, Column]]
    key: Column
    aggregates: dict[str, Column] = field(default_factory=dict)
    keys: Sequence[tuple[str, Column]] = ()
    splits: Sequence[str] = SPLITS


def run(rows: DataFrame, contract: Contract, split: str = "split", samples: int = SAMPLES) -> DataFrame:
    """(check, split, n, samples): each fault found, how often (rows, or keys), and its smallest keys ('' for rows without one).

    Keys that several splits share are told by the check "key in two splits", with split "a, b". A split of the contract without rows
    gives "split has no rows", one that it does not name "unknown split" for each row. A dataset that keeps its contract gives no rows.
    """
    checks = [("unknown split", ~F.col(split).isin(*contract.splits)), *contract.rows]
    broken = [F.coalesce(bad, F.lit(True)) for _, bad in checks]
    # Only keys, splits, verdicts and what aggregates read leave the scan.
    judged = rows.withColumns({"_key": F.coalesce(strip(contract.key.cast("string")), F.lit("")), "_split": F.coalesce(F.col(split), F.lit("")), **{f"_b{i}": bad.cast("long") for i, bad in enumerate(broken)}})
    by_split = judged.groupBy("_key", "_split").agg(F.count("*").alias("_rows"), *[F.sum(f"_b{i}").alias(f"_b{i}") for i in range(len(checks))], *[a.alias(name) for name, a in contract.aggregates.items()])
    named = F.col("_key") != ""
    fault = lambda name, n: F.struct(F.lit(name).alias("check"), n.cast("long").alias("n"))
    found = [fault(name, F.col(f"_b{i}")) for i, (name, _) in enumerate(checks)]
    found += [fault(name, (named & F.coalesce(bad, F.lit(True))).cast("long")) for name, bad in contract.keys]
    found = by_split.select("_key", "_split", "_rows", F.filter(F.array(*found), lambda f: f["n"] > 0).alias("_faults"))
    by_key = found.groupBy("_key").agg(F.collect_list(F.struct("_split", "_rows", "_faults")).alias("_parts"))
    said = lambda name, where, n: F.struct(name.alias("check"), where.alias("split"), n.alias("n"))
    own = F.flatten(F.transform("_parts", lambda p: F.concat(F.transform(p["_faults"], lambda f: said(f["check"], p["_split"], f["n"])), F.array(said(F.lit(""), p["_split"], p["_rows"])))))
    there = F.transform("_parts", lambda p: p["_split"])
    pairs = [(a, b) for i, a in enumerate(contract.splits) for b in contract.splits[i + 1 :]]
    shared = F.array(*[F.when(named & F.array_contains(there, a) & F.array_contains(there, b), said(F.lit("key in two splits"), F.lit(f"{a}, {b}"), F.lit(1).cast("long"))) for a, b in pairs])
    each = by_key.select("_key", F.explode(F.concat(own, F.filter(shared, lambda f: f.isNotNull()))).alias("f")).select("_key", "f.*")
    # The unnamed kind counts the rows of a split.
    totals = each.groupBy("check", "split").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("check", "split").orderBy("_key"))
    shown = each.where("check <> ''").withColumn("_place", place).where(F.col("_place") <= samples).groupBy("check", "split").agg(F.array_sort(F.collect_list("_key")).alias("samples"))
    expected = rows.sparkSession.createDataFrame([(s,) for s in contract.splits], "split string")
    empty = expected.join(totals.where("check = ''").select("split"), "split", "left_anti").select(F.lit("split has no rows").alias("check"), "split", F.lit(1).cast("long").alias("n"), F.array().cast("array<string>").alias("samples"))
    return totals.where("check <> ''").join(shown, ["check", "split"]).select("check", "split", "n", "samples").union(empty)


def _content(messages: str, i: int) -> Column:
    return F.get(F.col(messages), F.lit(i))["content"]


@dataclass(frozen=True)
class Task:
    """What prompts and answers are built from: category ids and display names in registry order, corpus_map() of the corpus, metadata fields."""

    ids: Sequence[str]
    displays: Sequence[str]
    described: Column
    fields: Sequence[str]

    def known(self, x: Column) -> Column:
        return x.isin(*self.ids)

    def user_prompt(self, stage: Column, candidates: Column, metadata: Column) -> Column:
        catalogue = choices.stage1_catalogue([(str(i), n) for i, n in enumerate(self.displays, 1)])
        return F.when(stage == "stage1", choices.stage1_prompt(catalogue, metadata)).when(self.bundled(candidates), choices.stage2_prompt(choices.bundle(candidates, self.described), metadata))

    def bundled(self, candidates: Column) -> Column:
        """Five different categories of the registry."""
        return (F.size(candidates) == choices.BUNDLE) & (F.size(F.array_distinct(candidates)) == choices.BUNDLE) & F.forall(candidates, self.known)

    def answered(self, stage: Column, answer: Column, truth: Column, candidates: Column) -> Column:
        """True where the answer is the one JSON object that the stage asks for."""
        choice_of = F.create_map(*[F.lit(x) for i, c in enumerate(self.ids, 1) for x in (c, str(i))])
        only = lambda key: F.json_object_keys(answer) == F.array(F.lit(key))
        one = only("candidates") & (F.from_json(answer, "candidates array<string>")["candidates"] == F.transform(candidates, lambda c: choice_of[c]))
        two = only("answer") & (F.from_json(answer, "answer string")["answer"] == F.array_position(candidates, truth).cast("string"))
        return F.when(stage == "stage1", one).otherwise(two)

    def sample(self, stage: Column, source: Column, truth: Column, metadata: Column) -> list[tuple[str, Column]]:
        keys = F.array_sort(F.json_object_keys(metadata))
        return [
            ("unknown stage", ~stage.isin("stage1", "stage2")),
            ("blank source id", strip(source) == ""),
            ("ground truth is not in the registry", ~self.known(truth)),
            ("metadata fields are not those of the task", keys != F.array(*[F.lit(f) for f in sorted(self.fields)])),
        ]

    def bundle(self, source: Column, truth: Column, candidates: Column) -> list[tuple[str, Column]]:
        fresh = choices.candidate_bundle(truth, list(self.ids), source)
        return [
            ("five different candidates of the registry are needed", ~self.bundled(candidates)),
            ("candidates are not in the reproducible order", F.when(self.known(truth), candidates != fresh).otherwise(F.lit(False))),
        ]


def _messages(column: str, roles: Sequence[str]) -> list[tuple[str, Column]]:
    held = F.col(column)
    marked = lambda m: F.coalesce(F.contains(m["content"], F.lit(TEMPLATE_MARKS[0])) | F.contains(m["content"], F.lit(TEMPLATE_MARKS[1])), F.lit(False))
    return [
        (f"messages are not {', '.join(roles)}", F.transform(held, lambda m: m["role"]) != F.array(*[F.lit(r) for r in roles])),
        ("message without text", F.exists(held, lambda m: m["content"].isNull())),
        ("chat template written into a message", F.exists(held, marked)),
    ]


def _pairs(stage: Column, truth: Column, *shared: Column) -> tuple[dict[str, Column], list[tuple[str, Column]]]:
    """Aggregates and checks of a key: one row a stage, which agree in what they share."""
    aggregates = {"_one": F.count_if(stage == "stage1"), "_two": F.count_if(stage == "stage2")}
    agree = []
    for i, x in enumerate((truth, *shared)):
        aggregates |= {f"_least{i}": F.min(x), f"_most{i}": F.max(x)}
        agree.append(F.col(f"_least{i}").eqNullSafe(F.col(f"_most{i}")))
    single = (F.col("_one") == 1) & (F.col("_two") == 1)
    differ = ~agree[0]
    for a in agree[1:]:
        differ = differ | ~a
    return aggregates, [("one row a stage is needed", ~single), ("stages differ", single & differ)]


def sft_contract(task: Task) -> Contract:
    """Of rows as datasets.sft() makes them: prompts, answers and candidates are built anew from each row's own fields; metadata is JSON text."""
    stage, source, truth, candidates, metadata = (F.col(c) for c in ("stage", "source_id", "ground_truth", "candidates", "metadata"))
    system = F.when(stage == "stage1", choices.STAGE1_SYSTEM).otherwise(choices.STAGE2_SYSTEM)
    user = task.user_prompt(stage, candidates, metadata)
    rows = [
        *_messages("messages", ("system", "user", "assistant")),
        *task.sample(stage, source, truth, metadata),
        *task.bundle(source, truth, candidates),
        ("prompt is not that of registry and task", (_content("messages", 0) != system) | (_content("messages", 1) != user)),
        ("answer is not that of the stage", ~task.answered(stage, _content("messages", 2), truth, candidates)),
    ]
    aggregates, keys = _pairs(stage, truth, F.to_json("candidates"))
    return Contract(rows, source, aggregates, keys)


def rl_contract(task: Task, dataset: str, ability: str = "classification") -> Contract:
    """Of rows as datasets.rl(dataset) makes them; only the second stage carries candidates."""
    info, truth = F.col("extra_info"), F.col("reward_model")["ground_truth"]
    stage, source, candidates, metadata = (info[c] for c in ("stage", "source_id", "candidates", "metadata"))
    first = stage == "stage1"
    system = F.when(first, choices.STAGE1_SYSTEM).otherwise(choices.STAGE2_SYSTEM)
    user = task.user_prompt(stage, candidates, metadata)
    rows = [
        ("data source is not dataset and stage", F.col("data_source") != F.concat_ws("/", F.lit(dataset), stage)),
        ("unknown dataset", info["dataset"] != dataset),
        ("unknown ability", F.col("ability") != ability),
        ("unknown reward style", F.col("reward_model")["style"] != "rule"),
        *_messages("prompt", ("system", "user")),
        *task.sample(stage, source, truth, metadata),
        ("stage1 shows candidates", first & candidates.isNotNull()),
        *[(name, F.when(first, F.lit(False)).otherwise(bad)) for name, bad in task.bundle(source, truth, candidates)],
        ("prompt is not that of registry and task", (_content("prompt", 0) != system) | (_content("prompt", 1) != user)),
    ]
    aggregates, keys = _pairs(stage, truth)
    return Contract(rows, source, aggregates, keys)
