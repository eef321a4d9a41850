"""Language identification by prediction by partial matching.

One variable-order byte context tree per language, up to three bytes of context, with
escape probabilities (method C, no exclusions across orders). Counts are frozen after fitting, so
the code length of a byte depends on its three predecessors alone. Only observed (context, byte) pairs
are kept, in hash tables that whole texts look up array-wise: a pair that was not seen pays its
context's escape and goes on with a byte less. The language with the shortest code wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from taxonaut.llm.common import tidy

ORDER = 3
#: Documented bound of the fit: about so many documents a language, drawn by hash, whole.
FIT_DOCS = 400
LETTER = re.compile(r"[^\W\d_]")
EMPTY = np.uint64((1 << 64) - 1)


class Table:
    """Values by 32-bit code, with open addressing over arrays."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(codes)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, EMPTY), np.zeros(1 << self.bits, np.float32)
        codes, values, at = codes.astype(np.uint64), values.astype(np.float32), self._slot(codes)
        while len(codes):
            free = self.keys[at] == EMPTY
            first = np.unique(at[free], return_index=True)[1]
            put = np.nonzero(free)[0][first]
            self.keys[at[put]], self.values[at[put]] = codes[put], values[put]
            left = np.ones(len(codes), bool)
            left[put] = False
            codes, values, at = codes[left], values[left], (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - min(32, self.bits))).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); the value of a code that is not there is zero."""
        codes = codes.astype(np.uint64)
        at = self._slot(codes)
        there = self.keys[at]
        found = there == codes
        out = np.where(found, self.values[at], np.float32(0))
        more = np.nonzero(~found & (there != EMPTY))[0]
        while len(more):
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            there = self.keys[at[more]]
            hit = there == codes[more]
            out[more[hit]], found[more[hit]] = self.values[at[more[hit]]], True
            more = more[~hit & (there != EMPTY)]
        return out, found


class Tree:
    """Context tree of a language: code lengths of one and no byte of context dense, of two and three for observed pairs."""

    def __init__(self, texts: list[bytes]):
        data = np.concatenate([np.frombuffer(bytes(ORDER) + t, np.uint8) for t in texts] or [np.zeros(0, np.uint8)]).astype(np.uint64)
        own = np.concatenate([np.repeat([False, True], [ORDER, len(t)]) for t in texts] or [np.zeros(0, bool)])
        code = _codes(data)[own]
        counts = np.bincount((code & np.uint64(255)).astype(np.int64), minlength=256)
        total, kinds = counts.sum(), (counts > 0).sum()
        lower = (counts + kinds / 256) / (total + kinds) if total else np.full(256, 1 / 256)
        counts = np.bincount((code & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16).reshape(256, 256)
        total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        dense = np.where(total > 0, (counts + kinds * lower) / np.maximum(1, total + kinds), lower).ravel()
        self.dense = -np.log2(dense).astype(np.float32)
        self.pairs, self.escapes = [], []
        pair, shorter = np.arange(1 << 16).astype(np.uint64), dense
        for order in (2, 3):
            seen, counts = np.unique(code & np.uint64((1 << 8 * (order + 1)) - 1), return_counts=True)
            context, at, kinds = np.unique(seen >> np.uint64(8), return_inverse=True, return_counts=True)
            total = np.bincount(at, weights=counts, minlength=len(context))
            lower = shorter[np.searchsorted(pair, seen & np.uint64((1 << 8 * order) - 1))] if len(seen) else np.zeros(0)
            p = (counts + kinds[at] * lower) / (total + kinds)[at] if len(seen) else lower
            self.pairs.append(Table(seen, -np.log2(p)))
            self.escapes.append(Table(context, -np.log2(kinds / np.maximum(1, total + kinds))))
            pair, shorter = seen, p

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code length of each byte, given as the byte below its three predecessors."""
        out, found = self.pairs[1].find(code)
        miss = np.nonzero(~found)[0]
        if len(miss):
            shorter = code[miss] & np.uint64(0xFFFFFF)
            out[miss] = self.escapes[1].find(code[miss] >> np.uint64(8))[0]
            length, found = self.pairs[0].find(shorter)
            out[miss] += length
            miss, shorter = miss[~found], shorter[~found]
            out[miss] += self.escapes[0].find(shorter >> np.uint64(8))[0] + self.dense[(shorter & np.uint64(0xFFFF)).astype(np.int64)]
        return out


def _codes(data: np.ndarray) -> np.ndarray:
    """Each byte with the three before it above it, as a 32-bit number; zeros before the start."""
    code = data.astype(np.uint64)
    for back in range(1, ORDER + 1):
        code[back:] |= data[:-back].astype(np.uint64) << np.uint64(8 * back)
    return code


@dataclass
class ContextTrees:
    languages: list[str]
    trees: list[Tree]

    def many(self, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
        """Bits of many texts: (texts, languages)."""
        out = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join([bytes(ORDER) + t for t in texts]), np.uint8)
        ends = np.cumsum(sizes + ORDER)
        own = np.ones(len(data), bool)
        for back in range(ORDER):
            own[ends - sizes - 1 - back] = False
        text = np.repeat(np.arange(len(texts)), sizes + ORDER)
        for k in range(0, len(data), block):
            before = min(k, ORDER)
            code = _codes(data[k - before : k + block])[before:][own[k : k + block]]
            of = text[k : k + block][own[k : k + block]]
            for lang, tree in enumerate(self.trees):
                out[:, lang] += np.bincount(of, weights=tree.bits(code), minlength=len(texts))
        return out


def grow(samples: dict[str, list[bytes]]) -> ContextTrees:
    """Context trees of the languages in `samples`, sorted by name."""
    languages = sorted(samples)
    return ContextTrees(languages, [Tree(samples[x]) for x in languages])


def fit(docs: DataFrame, may_learn: Column, docs_a_language: int = FIT_DOCS) -> ContextTrees:
    """Fit on a bounded sample of the rows of (doc_id, text, lang) that may be learnt from and have text and lang.

    The sample is drawn by a hash of doc_id: about `docs_a_language` documents of each
    language, fewer where there are fewer. No labelled rows: no languages, and all predictions are `und`.
    """
    labelled = docs.where(may_learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    samples: dict[str, list[bytes]] = {}
    share = {r["lang"]: min(1.0, docs_a_language / r["count"]) for r in labelled.groupBy("lang").count().collect()}
    if share:
        of = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])
        for r in labelled.where(draw < of[F.col("lang")]).select("lang", "text").orderBy("lang", "doc_id", "text").collect():
            samples.setdefault(r["lang"], []).append(r["text"].encode("utf-8"))
    return grow(samples)


def predict(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """`docs` with lang_pred and score, from the text alone; repeated rows each get theirs.

    `und` with score 0 if the text is null or has no letter (or nothing was learnt). The score is the
    winner's posterior, every language alike beforehand, at the text's mean code length a letter run of 32 bytes;
    of languages with equal codes the first by name wins. Columns of the names lang_pred and score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    names = docs.columns

    def run(batches):
        trees = shared.value
        for whole in batches:
            for k in range(0, max(1, whole.num_rows), 200):
                batch = whole.slice(k, 200)
                texts = batch.column("text").to_pylist()
                lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if trees.languages else []
                if rows:
                    data = [texts[i].encode("utf-8", "surrogatepass") for i in rows]
                    bits = trees.many(data)
                    excess = (bits - bits.min(axis=1, keepdims=True)) / np.maximum(1.0, np.array([len(x) for x in data]) / 32)[:, None]
                    lang[rows] = np.array(trees.languages, object)[bits.argmin(axis=1)]
                    score[rows] = 1.0 / np.exp2(-excess).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
