"""Model outputs: strict parsing, evaluation, rewards, metrics.

Bad model output never raises; bad program input does.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from taxonaut.operators import choices as prompts

# Rewards.
FULL, INVALID, STAGE1_MISS, STAGE2_WRONG = 1.0, 0.0, 0.3, 0.5
LOCAL_IDS = ("1", "2", "3", "4", "5")


# What is said of an output that breaks the contract.
NOT_AN_OBJECT = "prediction must be a JSON object"
OTHER_KEYS = {"candidates": "stage1 prediction must contain only candidates", "answer": "stage2 prediction must contain only answer"}
WRONG_TYPE = {"candidates": "stage1 candidates must be an array of strings", "answer": "stage2 answer must be a string"}
WRONG_COUNT = "stage1 prediction must contain exactly {} candidates"
REPEATED = "stage1 candidates must be unique"
NOT_IN_REGISTRY = "stage1 candidates must belong to the leaf registry"
NOT_A_CANDIDATE = "stage2 answer must be one of the candidates"
# Reasons of rewards.
REASONS = {
    "stage1": ("stage1 output is not a valid JSON object with schema candidates", "stage1 output violates candidate constraints: ", "stage1 candidates contain the ground truth", "stage1 output is valid but misses the ground truth"),
    "stage2": ("stage2 output is not a valid JSON object with schema answer", "stage2 answer is not one of the candidates", "stage2 answer is correct", "stage2 answer is valid but wrong"),
}


def _strict(key: str, check: Callable[[object], bool]) -> Callable[[pd.Series], pd.DataFrame]:
    """(value, error) of outputs: the value of `key` as JSON text, or what keeps an output from being one JSON object with that key alone and a value that passes."""

    def one(text):
        try:
            value = json.loads(text)
        except (ValueError, TypeError, RecursionError):
            return None, NOT_AN_OBJECT
        if not isinstance(value, dict):
            return None, NOT_AN_OBJECT
        if set(value) != {key}:
            return None, OTHER_KEYS[key]
        return (json.dumps(value[key]), None) if check(value[key]) else (None, WRONG_TYPE[key])

    def many(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["value", "error"], dtype=object)

    return many


# Spark's JSON functions accept trailing text and single quotes and refuse repeated keys: hence Python, in Arrow batches.
_READ = StructType([StructField("value", StringType()), StructField("error", StringType())])
_stage1 = F.pandas_udf(_strict("candidates", lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)), _READ)
_stage2 = F.pandas_udf(_strict("answer", lambda v: isinstance(v, str)), _READ)


def _said(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda e: e.isNotNull())


def parse_stage1(outputs: DataFrame, text: str, known: list[str] | dict[str, str], count: int = 5) -> DataFrame:
    """Adds predicted (array), format_valid, contract_valid, decoded and errors: `count` different ids, all known.

    `known` is a registry of bounded size: a list of category ids, or choice ids with the category of each. decoded holds
    category ids where the contract holds, else null; errors are in the order of the checks and name unknown choices one by one.
    """
    if count < 1:
        raise ValueError("count must be positive")
    ids = F.array(*[F.lit(x) for x in known])
    out = outputs.withColumn("_read", _stage1(F.col(text))).withColumn("predicted", F.from_json("_read.value", "array<string>"))
    unknown = F.filter("predicted", lambda c: ~F.array_contains(ids, c))
    if isinstance(known, dict):
        categories = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        decoded = F.transform("predicted", lambda c: categories[c])
        strange = F.transform(unknown, lambda c: F.concat(F.lit("choice id '"), c, F.lit("' is not in the prompt catalog")))
    else:
        decoded = F.col("predicted")
        strange = F.when(F.size(unknown) > 0, F.array(F.lit(NOT_IN_REGISTRY))).otherwise(F.array().cast("array<string>"))
    wrong = _said(F.when(F.size("predicted") != count, WRONG_COUNT.format(count)), F.when(F.size(F.array_distinct("predicted")) != F.size("predicted"), REPEATED))
    out = out.withColumn("errors", F.when(F.col("_read.error").isNotNull(), F.array("_read.error")).otherwise(F.concat(wrong, strange)))
    out = out.withColumns({"format_valid": F.col("_read.error").isNull(), "contract_valid": F.size("errors") == 0})
    return out.withColumn("decoded", F.when(F.col("contract_valid"), decoded)).drop("_read")


def parse_stage2(outputs: DataFrame, text: str, candidates: str | None = None, local: bool = True) -> DataFrame:
    """Adds answer, format_valid, contract_valid, errors and decoded.

    A local id "1" to "5" decodes to that candidate; with local=False the answer is itself one of the `candidates`.
    """
    if not local and candidates is None:
        raise ValueError("answers by category id need candidates")
    wrapped = F.concat(F.lit('{"a":'), F.col("_read.value"), F.lit("}"))
    out = outputs.withColumn("_read", _stage2(F.col(text))).withColumn("answer", F.get_json_object(wrapped, "$.a"))
    if local:
        good, said = F.col("answer").isin(*LOCAL_IDS), F.concat(F.lit("stage2 answer '"), F.col("answer"), F.lit("' must be one of 1..5"))
        decoded = F.get(F.col(candidates), F.col("answer").try_cast("int") - 1) if candidates else F.lit(None).cast("string")
    else:
        good, said, decoded = F.array_contains(F.col(candidates), F.col("answer")), F.lit(NOT_A_CANDIDATE), F.col("answer")
    good = F.coalesce(good, F.lit(False))
    out = out.withColumn("errors", _said(F.coalesce(F.col("_read.error"), F.when(~good, said))))
    out = out.withColumns({"format_valid": F.col("_read.error").isNull(), "contract_valid": good}).drop("_read")
    return out.withColumn("decoded", F.when(F.col("contract_valid"), decoded))


def _checked(fine: Column, said: str, result: Column) -> Column:
    """`result` where the program's input is fine; otherwise the query fails."""
    return F.when(F.coalesce(fine, F.lit(False)), result).otherwise(F.raise_error(F.lit(said)))


def evaluate_stage1(rows: DataFrame, text: str, truth: str, known: list[str] | dict[str, str], count: int = 5) -> DataFrame:
    """parse_stage1() with recalled: the contract holds and the truth is among the decoded. A truth outside the registry raises."""
    ids = list(known.values()) if isinstance(known, dict) else known
    out = parse_stage1(rows, text, known, count)
    recalled = F.col("contract_valid") & F.coalesce(F.array_contains("decoded", F.col(truth)), F.lit(False))
    return out.withColumn("recalled", _checked(F.col(truth).isin(*ids), "the ground truth must belong to the leaf registry", recalled))


def evaluate_stage2(rows: DataFrame, text: str, truth: str, candidates: str, ids: list[str], local: bool = True) -> DataFrame:
    """parse_stage2() with correct. A truth outside the registry `ids`, or candidates other than five different ids of it, raise."""
    out = parse_stage2(rows, text, candidates, local)
    registry, five = F.array(*[F.lit(x) for x in ids]), F.col(candidates)
    fine = F.array_contains(registry, F.col(truth)) & (F.size(five) == 5) & (F.size(F.array_distinct(five)) == 5) & F.forall(five, lambda c: F.array_contains(registry, c))
    correct = F.col("contract_valid") & F.coalesce(F.col("decoded") == F.col(truth), F.lit(False))
    return out.withColumn("correct", _checked(fine, "the truth and five different candidates must belong to the leaf registry", correct))


def rewarded(evaluated: DataFrame, stage: str, partial: float | None = None) -> DataFrame:
    """Adds reward, reason and task_correct to what evaluate_stage1() or evaluate_stage2() gives, by category id or by choice.

    `partial` is the reward of a valid output that misses (default 0.3 and 0.5); what is not valid gets 0.
    """
    if stage not in REASONS:
        raise ValueError("stage must be stage1 or stage2")
    unreadable, broken, full, part = REASONS[stage]
    achieved = F.col("recalled" if stage == "stage1" else "correct")
    weight = _weight((STAGE1_MISS if stage == "stage1" else STAGE2_WRONG) if partial is None else partial)
    broken = F.concat(F.lit(broken), F.array_join("errors", "; ")) if stage == "stage1" else F.lit(broken)
    reason = F.when(~F.col("format_valid"), unreadable).when(~F.col("contract_valid"), broken).when(achieved, full).otherwise(part)
    reward = F.when(~F.col("contract_valid"), INVALID).when(achieved, FULL).otherwise(weight)
    return evaluated.withColumns({"reward": reward, "reason": reason, "task_correct": achieved})


def evaluate_rows(rows: DataFrame, choices: dict[str, str], text: str = "completion") -> DataFrame:
    """Completions of both stages (source_id, stage, truth, candidates and `text`) as records of one form, by choice ids.

    Returns source_id, stage, format_valid, contract_valid, task_correct, truth_in_candidates (null in stage 1), predicted
    (category ids; of stage 2 the one answered) and errors. Rows of another stage raise.
    """
    kept = rows.withColumn("stage", _checked(F.col("stage").isin("stage1", "stage2"), "stage must be stage1 or stage2", F.col("stage")))
    shared = ["source_id", "stage", "format_valid", "contract_valid"]
    one = evaluate_stage1(kept.where(F.col("stage") != "stage2"), text, "truth", choices)
    two = evaluate_stage2(kept.where(F.col("stage") == "stage2"), text, "truth", "candidates", list(choices.values()))
    first = one.select(*shared, F.col("recalled").alias("task_correct"), F.lit(None).cast("boolean").alias("truth_in_candidates"), F.col("decoded").alias("predicted"), "errors")
    second = two.select(*shared, F.col("correct").alias("task_correct"), F.array_contains("candidates", F.col("truth")).alias("truth_in_candidates"), F.when(F.col("decoded").isNotNull(), F.array("decoded")).alias("predicted"), "errors")
    return first.unionByName(second)


def reward_stage1(format_valid: Column, contract_valid: Column, recalled: Column, miss: float = STAGE1_MISS) -> Column:
    return F.when(~format_valid | ~contract_valid, INVALID).when(recalled, FULL).otherwise(_weight(miss))


def reward_stage2(format_valid: Column, contract_valid: Column, correct: Column, wrong: float = STAGE2_WRONG) -> Column:
    return F.when(~format_valid | ~contract_valid, INVALID).when(correct, FULL).otherwise(_weight(wrong))


def _weight(x: float) -> float:
    if isinstance(x, bool) or not 0.0 <= x <= 1.0:
        raise ValueError("reward weights lie within [0, 1]")
    return float(x)


def _share(flag: Column) -> Column:
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def baseline_metrics(stage1: DataFrame, stage2: DataFrame) -> DataFrame:
    """One row of metrics of both stages and of their conjunction a source.

    stage1: source_id, format_valid, contract_valid, recalled; stage2: source_id, format_valid,
    contract_valid, correct, truth_in_candidates.
    """
    first = stage1.agg(F.count("*").alias("n_stage1"), _share(F.col("format_valid")).alias("stage1_format"), _share(F.col("contract_valid")).alias("stage1_contract"), _share(F.col("recalled")).alias("recall_at_5"))
    inside = F.count_if("truth_in_candidates")
    second = stage2.agg(
        F.count("*").alias("n_stage2"), _share(F.col("format_valid")).alias("stage2_format"), _share(F.col("contract_valid")).alias("stage2_contract"), _share(F.col("correct")).alias("accuracy"),
        F.coalesce(F.try_divide(F.count_if(F.col("correct") & F.col("truth_in_candidates")).cast("double"), inside.cast("double")), F.lit(0.0)).alias("accuracy_given_truth"),
    )
    pairs = stage1.select("source_id", F.col("recalled").alias("r"), F.lit(False).alias("c")).unionByName(stage2.select("source_id", F.lit(False).alias("r"), F.col("correct").alias("c")))
    both = pairs.groupBy("source_id").agg((F.max("r") & F.max("c")).alias("ok")).agg(F.count("*").alias("pairs"), F.count_if("ok").alias("e2e_correct"))
    return first.crossJoin(second).crossJoin(both)  # three single rows


def true_e2e(rows: DataFrame) -> DataFrame:
    """rows: contract_valid1, predicted, truth, local (int or null: the second answer's position, 1 to 5).

    Adds final (the predicted candidate that was answered) and e2e_correct: the truth must have been retrieved and chosen.
    """
    final = F.when(F.col("contract_valid1") & F.col("local").between(1, 5), F.get("predicted", F.col("local") - 1))
    return rows.withColumn("final", final).withColumn("e2e_correct", F.coalesce(F.col("final") == F.col("truth"), F.lit(False)))


def legacy_p95(values: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: rows, the largest value, sorted[max(0, int(0.95 n) - 1)] and the mean.

    Works on counts of different values, so no group is sorted or collected.
    """
    from pyspark.sql import Window

    counts = values.groupBy(group, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(group).agg(F.sum("n").alias("rows"), F.max(value).alias("max"), F.sum(F.col(value) * F.col("n")).alias("_sum"))
    running = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(group).orderBy(value)))
    rank = F.greatest(F.lit(1), F.floor(F.col("rows").cast("double") * 0.95).cast("long"))
    p95 = running.join(total.select(group, "rows"), group).where(F.col("upto") >= rank).groupBy(group).agg(F.min(value).alias("p95"))
    return total.join(p95, group).select(group, "rows", "max", "p95", (F.col("_sum").cast("double") / F.col("rows")).alias("mean"))


def token_budget(rows: DataFrame, key: str, tokens: str, limit: int) -> DataFrame:
    """One row: the most tokens, the first key that has them, and how many rows are over the limit."""
    return rows.agg(F.max(tokens).alias("max_tokens"), F.min_by(key, F.struct(-F.col(tokens), F.col(key))).alias("longest"), F.count_if(F.col(tokens) > limit).alias("over_limit"))


def token_counts(rows: DataFrame, text: str, count: Callable[[str], int], into: str = "tokens") -> DataFrame:
    """Adds token counts by an injected tokenizer, in Arrow batches; null text counts as empty."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(count)

    return rows.withColumn(into, F.pandas_udf(run, "long")(F.col(text)))


def stage_pairs(rows: DataFrame, source: str, stage: str, first: str, second: str) -> DataFrame:
    """Per source: rows of each stage, and whether there is exactly one of each."""
    out = rows.groupBy(source).agg(F.count_if(F.col(stage) == first).alias("n_first"), F.count_if(F.col(stage) == second).alias("n_second"))
    return out.withColumn("paired", (F.col("n_first") == 1) & (F.col("n_second") == 1))


def join_completions(rows: DataFrame, completions: DataFrame, order: str) -> DataFrame:
    """rows (stage, source_id, ...) with their completion; of several for a row the last by `order` counts, a row without one raises."""
    last = completions.groupBy("stage", "source_id").agg(F.max_by("completion", order).alias("completion"), F.lit(True).alias("_there"))
    joined = rows.join(last, ["stage", "source_id"], "left")
    said = F.concat(F.lit("no completion for "), F.col("stage"), F.lit(" of "), F.col("source_id"))
    return joined.withColumn("completion", F.when(F.col("_there").isNull(), F.raise_error(said)).otherwise(F.col("completion"))).drop("_there")


def generated(rows: DataFrame, system: str, user: str, model: Callable[[str, str], str], into: str = "completion") -> DataFrame:
    """Adds what an injected model answers to (system, user) prompts, in Arrow batches; a null prompt gets null."""

    def run(systems: pd.Series, users: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or u is None else model(s, u) for s, u in zip(systems, users)], dtype=object)

    return rows.withColumn(into, F.pandas_udf(run, StringType())(F.col(system), F.col(user)))


def two_step(rows: DataFrame, choice_of: dict[str, str], names: list[str], corpus: DataFrame, model: Callable[[str, str], str]) -> DataFrame:
    """True end to end: the second stage chooses among the five that the first one *predicted*.

    rows: source_id (unique), truth, metadata (JSON); choice_of: choice ids with their categories, in catalogue order, beside
    names; corpus: category_id, name, description. Returns source_id, truth, the flags of both stages, predicted, attempted
    (the first output was valid and the corpus has all five), final (null unless answered well), correct and failures. Rows
    are carried through the join with the corpus, so that each prompt is answered once a run.
    """
    catalogue = prompts.stage1_catalogue(list(zip(choice_of, names, strict=True)))
    asked = rows.select("source_id", "truth", "metadata").withColumns({"_system": F.lit(prompts.STAGE1_SYSTEM), "_user": prompts.stage1_prompt(catalogue, F.col("metadata"))})
    first = evaluate_stage1(generated(asked, "_system", "_user", model), "completion", "truth", choice_of)
    renamed = {"format_valid": "stage1_format", "contract_valid": "stage1_contract", "recalled": "recalled", "decoded": "predicted", "errors": "failures1"}
    carried = ["truth", "metadata", *renamed.values()]
    each = first.select("source_id", "truth", "metadata", *[F.col(c).alias(n) for c, n in renamed.items() if c != "decoded"], F.col("decoded").alias("predicted"), F.posexplode_outer("decoded").alias("pos", "category_id"))
    known = corpus.select("category_id", "name", F.coalesce("description", F.lit("")).alias("description"))
    item = F.struct("pos", F.struct((F.col("pos") + 1).cast("string").alias("id"), "name", "description").alias("item"))
    bundle = F.when(F.count("name") == 5, F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]))).alias("_bundle")
    met = each.join(known, "category_id", "left").groupBy("source_id").agg(*[F.first(c).alias(c) for c in carried], bundle)
    asked = met.withColumns({"_system": F.lit(prompts.STAGE2_SYSTEM), "_user": prompts.stage2_prompt(F.col("_bundle"), F.col("metadata"))})
    second = parse_stage2(generated(asked, "_system", "_user", model), "completion", "predicted")
    attempted = F.col("_bundle").isNotNull()
    flag = lambda c: attempted & F.col(c)
    unbuilt = F.when(F.col("stage1_contract"), F.array(F.lit("stage2 build: a predicted category is not in the corpus"))).otherwise(F.col("failures1"))
    return second.select(
        "source_id", "truth", "stage1_format", "stage1_contract", "recalled", "predicted", attempted.alias("attempted"), flag("format_valid").alias("stage2_format"), flag("contract_valid").alias("stage2_contract"),
        F.when(attempted, F.col("decoded")).alias("final"), F.coalesce(attempted & (F.col("decoded") == F.col("truth")), F.lit(False)).alias("correct"), F.when(attempted, F.col("errors")).otherwise(unbuilt).alias("failures"),
    )


def two_step_metrics(outcomes: DataFrame) -> DataFrame:
    """One row of metrics of two_step(); shares of nothing are 0."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n, tried, recalled, right = F.count("*"), F.count_if("attempted"), F.count_if("recalled"), F.count_if("correct")
    return outcomes.agg(
        n.alias("sources"), share(F.count_if("stage1_format"), n).alias("stage1_format"), share(F.count_if("stage1_contract"), n).alias("stage1_contract"), share(recalled, n).alias("recall_at_5"), recalled.alias("recalled"), tried.alias("attempted"),
        share(F.count_if(F.col("attempted") & ~F.col("stage2_format")), tried).alias("stage2_format_failures"), share(F.count_if(F.col("attempted") & ~F.col("stage2_contract")), tried).alias("stage2_contract_failures"),
        share(right, recalled).alias("conditional_accuracy"), share(right, n).alias("e2e_accuracy"), right.alias("e2e_correct"),
    )
