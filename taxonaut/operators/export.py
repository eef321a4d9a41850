"""Training rows: two-stage fine-tuning and reinforcement rows, their checks, and message exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from taxonaut.functions import text
from taxonaut.operators import choices

# Chinese labels of the message export.
METADATA_LABELS = {
    "database_name": "数据库名称",
    "database_description": "数据库描述",
    "table_name": "表名称",
    "table_description": "表描述",
    "field_name": "字段名称",
    "field_description": "字段描述",
    "field_type": "字段类型",
    "value": "字段样例值",
}
USER_HEAD = "请对以下数据库字段进行数据分类分级："


def require_empty(df: DataFrame, what: str) -> None:
    """Contract check: a query that must return no row."""
    if bad := df.limit(5).collect():
        raise ValueError(f"{what}: {[tuple(r) for r in bad]}")


def stage_rows(rows: DataFrame, registry: list[str], names: list[str], corpus: DataFrame, metadata: dict[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Two rows (stage1, stage2) for each resolved row (source_id, truth): system, user, answer, truth, candidates, metadata (JSON), and the columns to `keep`.

    Catalogue and corpus are literals, so no row moves; candidates are worked out once and fan out to both stages. registry
    and names are in registry order, of bounded size. A repeated source_id gives its rows again.
    """
    catalogue = choices.stage1_catalogue([(str(i), n) for i, n in enumerate(names, 1)])
    based = rows.withColumns({"candidates": choices.candidate_bundle(F.col("truth"), registry, F.col("source_id")), "metadata": choices.metadata_json(metadata)})
    bundle = choices.bundle(F.col("candidates"), choices.corpus_map(corpus))
    choice_of = F.create_map(*[F.lit(x) for i, c in enumerate(registry, 1) for x in (c, str(i))])
    picked = F.transform("candidates", lambda c: choice_of[c])
    one = F.struct(F.lit("stage1").alias("stage"), F.lit(choices.STAGE1_SYSTEM).alias("system"), choices.stage1_prompt(catalogue, F.col("metadata")).alias("user"), choices.stage1_answer(picked).alias("answer"))
    two = F.struct(F.lit("stage2").alias("stage"), F.lit(choices.STAGE2_SYSTEM).alias("system"), choices.stage2_prompt(bundle, F.col("metadata")).alias("user"), choices.stage2_answer(F.col("truth"), F.col("candidates")).alias("answer"))
    return based.select("source_id", "truth", "candidates", "metadata", *keep, F.explode(F.array(one, two)).alias("s")).select("source_id", "s.*", "truth", "candidates", "metadata", *keep)


def sft_rows(stages: DataFrame, *keep: str) -> DataFrame:
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return stages.select(F.array(message("system", "system"), message("user", "user"), message("assistant", "answer")).alias("messages"), "stage", "source_id", F.col("truth").alias("ground_truth"), "candidates", "metadata", *keep)


def rl_rows(stages: DataFrame, source: str | Column, *keep: str, ability: str = "classification") -> DataFrame:
    """Reinforcement rows; `source` is the data source of all, or a column such as dataset_source()."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return stages.select(
        (source if isinstance(source, Column) else F.lit(source)).alias("data_source"),
        F.array(message("system", "system"), message("user", "user")).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("truth").alias("ground_truth")).alias("reward_model"),
        F.struct("stage", "source_id", "metadata", F.when(F.col("stage") == "stage2", F.col("candidates")).alias("candidates")).alias("extra_info"), *keep,
    )


def dataset_source(dataset: str) -> Column:
    """dataset/stage, by which reward functions tell the rows of a dataset apart."""
    return F.concat_ws("/", F.lit(dataset), "stage")


def _errors(checks: list[tuple[Column, str]]) -> Column:
    """What is said of the checks that fail, in order; a check that a null leaves open fails."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(F.coalesce(bad, F.lit(True)), F.array(F.lit(said))).otherwise(none) for bad, said in checks])


def _sample_checks(registry: list[str], stage: Column, source: Column, truth: Column, candidates: Column) -> list[tuple[Column, str]]:
    fresh = choices.candidate_bundle(truth, registry, source)
    return [
        (~stage.isin("stage1", "stage2"), "unknown stage"),
        (text.strip(source) == "", "blank source id"),
        (~truth.isin(*registry), "ground truth is not in the registry"),
        ((F.size(candidates) != 5) | (F.size(F.array_distinct(candidates)) != 5), "five different candidates are needed"),
        (~F.array_contains(candidates, truth), "candidates lack the ground truth"),
        (fresh != candidates, "candidate order is not the reproducible one"),
    ]


#: What rows and the samples built anew must agree in; what is said where they do not.
_AGREE = {"truth": "ground truth is not the sample's", "system": "system prompt differs", "user": "user prompt differs", "answer": "answer differs", "metadata": "metadata differ"}


def _digest(name: str, x: Column) -> Column:
    return x if name == "truth" else F.unhex(F.sha2(x, 256))


def _against(rows: DataFrame, source: Column, stage: Column, checks: list[tuple[Column, str]], texts: dict[str, Column], expected: DataFrame) -> DataFrame:
    """source_id, stage and errors of faulty rows: `checks` of a row, then its `texts` (by _AGREE) against what stage_rows() gives for its sample and stage.

    Texts meet as SHA-256 digests, and checks are worked out before, so neither prompts nor answers move.
    """
    own = rows.select(source.alias("source_id"), stage.alias("stage"), _errors(checks).alias("_own"), F.struct(*[_digest(name, x).alias(name) for name, x in texts.items()]).alias("_r"))
    again = expected.select(F.col("source_id").alias("_source"), F.col("stage").alias("_stage"), F.struct(*[_digest(name, F.col(name)).alias(name) for name in texts]).alias("_e"))
    met = own.join(again, (F.col("source_id") == F.col("_source")) & (F.col("stage") == F.col("_stage")), "left")
    differ = [(~F.col(f"_r.{name}").eqNullSafe(F.col(f"_e.{name}")), said) for name, said in _AGREE.items() if name in texts]
    return met.select("source_id", "stage", F.concat("_own", _errors([(F.col("_e").isNull(), "no such sample"), *differ])).alias("errors")).where(F.size("errors") > 0)


def _blank(messages: str) -> Column:
    """A message has no more than white space (told at its first other character, as a rule)."""
    return F.exists(messages, lambda m: ~m["content"].rlike(text.NOT_SPACE))


def check_sft(rows: DataFrame, registry: list[str], expected: DataFrame) -> DataFrame:
    """source_id, stage and errors (in check order) of rows that break the contract; empty for a good export.

    `expected` (stage_rows() of the samples) holds the prompts and answers built anew: messages must equal them, so
    stage 1 answers the candidates and stage 2 the truth. Null fields are errors.
    """
    content = lambda i: F.get(F.col("messages"), F.lit(i))["content"]
    checks = [
        (F.col("messages.role") != F.array(*[F.lit(r) for r in ("system", "user", "assistant")]), "roles must be system, user, assistant"),
        (_blank("messages"), "blank message"),
        *_sample_checks(registry, F.col("stage"), F.col("source_id"), F.col("ground_truth"), F.col("candidates")),
    ]
    texts = {"truth": F.col("ground_truth"), "system": content(0), "user": content(1), "answer": content(2), "metadata": F.col("metadata")}
    return _against(rows, F.col("source_id"), F.col("stage"), checks, texts, expected)


def check_rl(rows: DataFrame, registry: list[str], source: str, expected: DataFrame, ability: str = "classification") -> DataFrame:
    """source_id, stage and errors (in check order) of reinforcement rows that break the contract; empty for a good export. `expected` as for check_sft()."""
    info, truth = F.col("extra_info"), F.col("reward_model")["ground_truth"]
    content = lambda i: F.get(F.col("prompt"), F.lit(i))["content"]
    # Only the second stage shows its candidates.
    first = info["stage"] == "stage1"
    sample = [(F.when(first, False).otherwise(bad) if "candidate" in said else bad, said) for bad, said in _sample_checks(registry, info["stage"], info["source_id"], truth, info["candidates"])]
    sample.append((first & info["candidates"].isNotNull(), "stage1 shows candidates"))
    checks = [
        (F.col("data_source") != source, "unknown data source"),
        (F.col("ability") != ability, "unknown ability"),
        (F.col("reward_model")["style"] != "rule", "unknown reward style"),
        (F.col("prompt.role") != F.array(F.lit("system"), F.lit("user")), "roles must be system, user"),
        (_blank("prompt"), "blank message"),
        *sample,
    ]
    texts = {"truth": truth, "system": content(0), "user": content(1), "metadata": info["metadata"]}
    return _against(rows, info["source_id"], info["stage"], checks, texts, expected)


def unpaired(rows: DataFrame) -> DataFrame:
    """Sources of (source_id, stage, ground_truth, candidates) rows without exactly one row a stage, or whose stages differ in truth or candidates."""
    found = rows.groupBy("source_id").agg(F.count_if(F.col("stage") == "stage1").alias("n1"), F.count_if(F.col("stage") == "stage2").alias("n2"), F.count_distinct("ground_truth").alias("truths"), F.count_distinct("candidates").alias("bundles"))
    return found.where("n1 <> 1 or n2 <> 1 or truths > 1 or bundles > 1")


def message_errors(turns: DataFrame, conversation: str, turn: str, role: str, content: str) -> DataFrame:
    """Per conversation: turns, blank contents, repeated roles in a row, and whether it opens with system or user."""
    w = Window.partitionBy(conversation).orderBy(turn)
    marked = turns.select(conversation, turn, role, content, F.lag(role).over(w).alias("_before"))
    return marked.groupBy(conversation).agg(
        F.count("*").alias("turns"), F.count_if(text.clean(F.col(content)) == "").alias("blank"), F.count_if(F.col(role) == F.col("_before")).alias("repeated"), F.min_by(role, turn).isin("system", "user").alias("opens_well")
    )


def reference_answer(classification: list[Column], level: Column) -> Column:
    names = [f"level_{i}" for i in range(1, 5)]
    return F.to_json(F.struct(F.struct(*[F.coalesce(c, F.lit("")).alias(n) for n, c in zip(names, classification)]).alias("classification"), F.coalesce(level, F.lit("")).alias("data_level")))


def rft_messages(records: DataFrame) -> DataFrame:
    """Adds user_content to rows that have the metadata columns."""
    return records.withColumn("user_content", text.labelled_lines(USER_HEAD, {c: label for c, label in METADATA_LABELS.items() if c in records.columns}))
