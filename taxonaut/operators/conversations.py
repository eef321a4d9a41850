"""Token counts of conversations under a chat template, and budgets by split.

A tokenizer is injected. With its own template it gets the whole message array of a row. Templates that render message by message between
special tokens need no whole conversation: turns are rendered and counted one by one, and added up on the map side, so a
conversation of any length will do.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from taxonaut.operators.scoring import token_counts


def length_of(tokenized: Any) -> int:
    """Tokens in what a tokenizer returns: a list of ids, a batch of one such list, a tensor, or a mapping with input_ids."""
    if isinstance(tokenized, Mapping):
        tokenized = tokenized.get("input_ids")
    if tokenized is None:
        raise ValueError("the tokenizer returned no input_ids")
    if hasattr(tokenized, "numel"):
        return int(tokenized.numel())
    if hasattr(tokenized, "tolist"):
        tokenized = tokenized.tolist()
    if len(tokenized) and isinstance(tokenized[0], (list, tuple)):
        if len(tokenized) != 1:
            raise ValueError("the tokenizer returned a batch of several rows")
        tokenized = tokenized[0]
    return len(tokenized)


def message_tokens(rows: DataFrame, messages: str, tokenizer: Callable[[], Any], into: str = "tokens") -> DataFrame:
    """Adds the length of each row's messages (array of role and content) under the tokenizer's own chat template.

    `tokenizer` makes the tokenizer once a task; its apply_chat_template() gets the messages in order. Rows stream in Arrow
    batches. Null messages raise, as does a null message among them.
    """
    columns = [c for c in rows.columns if c != into]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != into]

    def run(batches):
        made = tokenizer()
        for batch in batches:
            lengths = []
            for said in batch.column(messages).to_pylist():
                if said is None or any(m is None for m in said):
                    raise ValueError("a row without messages")
                lengths.append(length_of(made.apply_chat_template(said, tokenize=True, add_generation_prompt=False)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.int64())], names=[*batch.schema.names, into])

    return rows.select(*columns).mapInArrow(run, ", ".join([*fields, f"`{into}` long"]))


def rendered(role: Column, content: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """One message of a template that puts each between special tokens; null texts count as empty."""
    return F.concat(F.lit(start), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")), F.lit(f"{end}\n"))


def conversation_tokens(turns: DataFrame, conversation: str, role: str, content: str, count: Callable[[str], int], render: Callable[[Column, Column], Column] = rendered) -> DataFrame:
    """(conversation, turns, chars, tokens): messages, characters of their contents, and tokens of the rendered messages.

    Exact for templates whose special tokens end and begin each message. A null conversation is one of its own.
    """
    counted = token_counts(turns.select(conversation, F.length(F.coalesce(F.col(content), F.lit(""))).cast("long").alias("_chars"), render(F.col(role), F.col(content)).alias("_text")), "_text", count)
    return counted.groupBy(conversation).agg(F.count("*").alias("turns"), F.sum("_chars").alias("chars"), F.sum("tokens").alias("tokens"))


def budget(rows: DataFrame, split: str, key: str, tokens: str, limit: int) -> DataFrame:
    """(split, rows, max_tokens, longest, over_limit): per split the most tokens, the smallest key that has them, and how many rows are over the limit."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    return rows.groupBy(split).agg(F.count("*").alias("rows"), F.max(tokens).alias("max_tokens"), F.min_by(key, F.struct(-F.col(tokens), F.col(key))).alias("longest"), F.count_if(F.col(tokens) > limit).alias("over_limit"))
