"""Reinforcement fine-tuning: labelled items as JSON lines of messages and a reference answer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from taxonaut.functions import nested
from taxonaut.functions.text import strip
from taxonaut.operators import export
from taxonaut.operators.splits import SPLITS
from taxonaut.sources import writers

# The instruction and the fields of exchanged items.
DEVELOPER_PROMPT = (
    "你是数据库字段数据分类分级智能体。\n"
    "根据用户提供的字段元数据，预测四级数据分类和数据等级。\n"
    "只能输出一个合法、紧凑的 JSON 对象，不得输出解释、Markdown 或其他文字。\n"
    "输出结构必须严格为：\n"
    '{"classification":{"level_1":"","level_2":"","level_3":"","level_4":""},"data_level":""}\n'
    "如果训练数据中某个分类层级为空，输出中对应层级也保持空字符串。"
)
LEVELS = ("level_1", "level_2", "level_3", "level_4")
REPORT = "_export_report.json"


def _lacking(item: Column, of: str, fields: Sequence[str]) -> Column:
    """Names of the fields that an object lacks; a null one is there."""
    return F.filter(F.array(*[F.when(nested.get(item, f"{of}.{f}")["state"] == nested.MISSING, F.lit(f)) for f in fields]), lambda f: f.isNotNull())


def checked(items: DataFrame, item: str = "item") -> DataFrame:
    """items (VARIANT) with labelled and their texts; items that break the contract raise in the job that reads them.

    metadata and classification must be objects that have every field, null or not. An item is labelled if a level is not
    blank; a label_status of labeled or unlabeled that says otherwise raises, any other status does not matter.
    """
    v = F.col(item)
    name = F.coalesce(nested.get(v, "id")["value"], F.lit("<unknown>"))
    inferred = F.lit(False)
    for level in LEVELS:
        inferred = inferred | (strip(nested.label(v, f"classification.{level}")) != "")
    fault = F.lit(None).cast("string")
    for of, fields in (("classification", LEVELS), ("metadata", tuple(export.METADATA_LABELS))):
        lacks = _lacking(v, of, fields)
        fault = F.when(nested.kind(F.try_variant_get(v, f"$.{of}", "variant")).eqNullSafe(F.lit("object")), F.when(F.size(lacks) > 0, F.concat(F.lit(f"is missing {of} fields: "), F.array_join(lacks, ", "))).otherwise(fault)).otherwise(F.lit(f"has invalid {of}"))
    status = nested.label(v, "label_status")
    fault = F.coalesce(fault, F.when((status == "unlabeled") & inferred, "is unlabeled but has a label").when((status == "labeled") & ~inferred, "is labeled but all levels are blank"))
    said = F.concat(F.lit("item "), name, F.lit(" "), fault)
    texts = {f: nested.label(v, f"metadata.{f}") for f in export.METADATA_LABELS} | {f: nested.label(v, f"classification.{f}") for f in LEVELS}
    texts |= {"data_level": nested.label(v, "data_level"), "source_id": nested.label(v, "id")}
    return items.withColumns({"labelled": F.when(fault.isNull(), inferred).otherwise(F.raise_error(said)), **texts})


def rft_rows(labelled: DataFrame, *keep: str) -> DataFrame:
    """messages (developer, user), reference_answer, its compact JSON and source_id of checked() rows. Blank metadata give no line; nulls count as blank."""
    answer = F.struct(F.struct(*LEVELS).alias("classification"), F.col("data_level"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = export.rft_messages(labelled)
    return user.select(F.array(message("developer", F.lit(DEVELOPER_PROMPT)), message("user", F.col("user_content"))).alias("messages"), answer.alias("reference_answer"), F.to_json(answer).alias("reference_answer_json"), "source_id", *keep)


def export_rft(items: DataFrame, path: str, item: str = "item", overwrite: bool = False) -> dict:
    """Write the labelled items of (item, split) as JSON lines by split under `path` and return the report: input, exported and skipped records a split.

    Counts come from the job that writes. A split without a labelled item, or a faulty item, raises and leaves what stood at `path`.
    """
    spark = items.sparkSession
    writers.recover(spark, path)
    if not overwrite:
        writers.refuse_existing(spark, path)
    counts = Observation("rft")
    split, labelled = F.col("split"), F.col("labelled")
    seen = checked(items, item).observe(counts, *[F.count_if((split == s) & (labelled == there)).alias(f"{s}_{there}") for s in SPLITS for there in (True, False)])
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        rows = rft_rows(seen.where(labelled & split.isin(*SPLITS)), "split")
        rows.select(F.to_json(F.struct(*[c for c in rows.columns if c != "split"])).alias("value"), "split").write.partitionBy("split").text(staging)
        n = counts.get
        if empty := [s for s in SPLITS if not n[f"{s}_True"]]:
            raise ValueError(f"no labelled items in {', '.join(empty)}")
        report = {"splits": {s: {"input_records": n[f"{s}_True"] + n[f"{s}_False"], "exported_records": n[f"{s}_True"], "skipped_unlabeled": n[f"{s}_False"]} for s in SPLITS}}
        writers.write_text(spark, f"{staging}/{REPORT}", json.dumps(report, ensure_ascii=False, indent=2))
    except BaseException:
        writers.delete(spark, staging)
        raise
    writers.publish_staged(spark, {path: staging}, overwrite)
    return report
