"""Substring deduplication over word suffixes, partitioned by variable-length prefixes.

A document's suffixes start at its words. Two suffixes meet below a deep internal node of the
suffix tree if they share their first `window` words. To split the suffixes into
memory-sized groups, each is filed under a prefix of its own length: it reaches from the
suffix's start to the end of its anchor, the smallest-hashed run of `GRAM` words among its first
`window`. Equal windows have equal anchors, so every subtree lies in one group; suffixes of
one document with the same anchor lie side by side and travel as one record, with the 64-bit hash of
each suffix's window. A group is read in sorted order: neighbours that agree in prefix (64 bits of the
anchor, and where it lies) and window hang below one node at depth `window`, and runs of such starts are the
maximal repeats. Of a node's leaves all but the first, in document order, are removed.

Each mapper first reads its own block of documents in this way, so that a passage in a third of
all documents sends one record a block, not one a document.

A first pass counts the suffixes of each anchor, by slots of its hash. Anchors in slots over HOT_SUFFIXES (a phrase
in very many documents, with different words around it) are extended to the whole window: their suffixes are filed
one by one under the window's hash, so that equal windows still meet, but the anchor's suffixes spread over all tasks.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from taxonaut.llm.common import cut, hash_words, mix64, split_by_filter, tidy, words_of

WINDOW = 20
GRAM = 6
#: Words a mapper holds at a time; a longer document is held whole.
BLOCK_WORDS = 300_000
LAST = (1 << 63) - 1
#: Suffixes of a slot of anchors beyond which their prefixes are extended. Slots never miss a frequent anchor; a rare one beside it is extended too.
HOT_SUFFIXES = 300_000
SLOTS = 1 << 18

RECORDS = "g long, ord long, at long, leaves binary"


def _rolled(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """64-bit hash of every run of n entries."""
    factors = mix64(np.arange(n, dtype=np.uint64), seed) | np.uint64(1)
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out += h[j : len(h) - n + 1 + j] * factors[j]
    return mix64(out, seed)


def _extreme(x: np.ndarray, n: int, of) -> np.ndarray:
    """Running minimum or maximum over n entries."""
    out, done = x, 1
    while done < n:
        step = min(done, n - done)
        out = of(out[: len(out) - step], out[step:])
        done += step
    return out


def suffixes(h: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes with `window` words inside their document: start, anchor position, anchor hash, hash of the window.

    h: word hashes of documents laid end to end, sizes: words in each.
    """
    if len(h) < window:
        none = np.zeros(0, np.uint64)
        return none.astype(np.int64), none.astype(np.int64), none, none
    grams = _rolled(h, gram, 1)
    whole = _rolled(h, window, 2)
    ends = np.repeat(np.cumsum(sizes), sizes)
    start = np.nonzero(np.arange(len(whole)) + window <= ends[: len(whole)])[0]
    least = _extreme(grams, window - gram + 1, np.minimum)[start]
    anchor = np.full(len(start), -1, np.int64)
    for j in range(window - gram, -1, -1):  # leftmost of equals wins
        hit = grams[start + j] == least
        anchor[hit] = start[hit] + j
    return start, anchor, least, whole[start]


def _slot(g: np.ndarray) -> np.ndarray:
    return (mix64(g, 3) % np.uint64(SLOTS)).astype(np.int64)


def _count(window: int, gram: int):
    """Suffixes of each slot of anchors in a task: slot, n."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                h, sizes = hash_words(batch.column(0).slice(k, 200).to_pylist())
                if len(h) < window:
                    continue
                ends = np.repeat(np.cumsum(sizes), sizes)[: len(h) - window + 1]
                least = _extreme(_rolled(h, gram, 1), window - gram + 1, np.minimum)
                np.add.at(total, _slot(least[np.arange(len(least)) + window <= ends]), 1)
        slots = np.nonzero(total)[0]
        for k in range(0, len(slots), 50_000):
            part = slots[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "n"])

    return run


def hot_slots(docs: DataFrame, window: int, gram: int, bound: int) -> np.ndarray:
    """Slots with more than `bound` suffixes; as many as the suffixes of the corpus over `bound` at most reach the driver."""
    counts = docs.select("text").where(F.col("text").isNotNull()).mapInArrow(tidy(_count(window, gram)), "slot long, n long")
    return np.array(sorted(r["slot"] for r in counts.groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > bound).collect()), np.int64)


def _ranges(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of a document: document, first start, end start."""
    if not len(doc):
        return doc, start, start
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], start[last] + 1


def _later(keys: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """Rows that share all `keys` with a row of smaller `places`."""
    order = np.lexsort([*places[::-1], *keys[::-1]])
    new = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    new[1:] = ~same
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    differs = np.zeros(len(order), bool)
    for p in places:
        q = p[order]
        differs |= q != q[first]
    out = np.zeros(len(order), bool)
    out[order] = differs
    return out


def _file_block(block: list[tuple[int, int, np.ndarray]], window: int, gram: int, hot: np.ndarray):
    """Record batch of a block of (order, text crc, word hashes): its own repeats, and the records of the rest."""
    block.sort(key=lambda x: x[:2])
    sizes = np.array([len(x[2]) for x in block], np.int64)
    words = np.concatenate([x[2] for x in block])
    start, anchor, g, whole = suffixes(words, sizes, window, gram)
    second = _rolled(words, window, 7)[start] if len(hot) and len(start) else g  # a hot suffix is told by two hashes of its window
    doc = np.repeat(np.arange(len(block)), sizes)[start] if len(start) else start
    begin = np.cumsum(sizes) - sizes
    place = (np.array([x[1] for x in block], np.int64) << 32)[doc] + (start - begin[doc])
    order_of = np.array([x[0] for x in block], np.int64)[doc]
    later = _later([whole], [order_of, place])
    # Repeats inside the block, as records without leaves: `at` is the first start, g the number of starts.
    d, a, b = _ranges(doc[later], place[later])
    own = (b - a, np.array([x[0] for x in block], np.int64)[d] if len(d) else d, a, [b""] * len(d))
    # The rest: a record for each run of starts with one anchor, or for each start of a hot one.
    keep = ~later
    start, anchor, g, whole, place, order_of = (x[keep] for x in (start, anchor, g, whole, place, order_of))
    if not len(start):
        return _batch([own])
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    if len(hot):
        alone = np.isin(_slot(g), hot)
        g = np.where(alone, second[keep], g)
        new |= alone
    first = np.nonzero(new)[0]
    data = whole.astype("<u8").tobytes()
    lead = (anchor - start)[first].astype(np.uint8).tobytes()
    cuts = np.concatenate([first, [len(start)]]) * 8
    leaves = [lead[k : k + 1] + data[cuts[k] : cuts[k + 1]] for k in range(len(first))]
    return _batch([own, (g[first].view(np.int64), order_of[first], place[first], leaves)])


def _batch(parts) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate([np.asarray(p[k], np.int64) for p in parts]), pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([x for p in parts for x in p[3]], pa.binary())], names=["g", "ord", "at", "leaves"])


def _file(window: int, gram: int, hot: np.ndarray = np.zeros(0, np.int64)):
    def run(batches):
        block, words = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = part.column(1).to_pylist()
                hashes, sizes = hash_words(texts)
                for order, text, own in zip(part.column(0).to_pylist(), texts, np.split(hashes, np.cumsum(sizes)[:-1])):
                    if len(own) < window:
                        continue
                    block.append((order, zlib.crc32(text.encode("utf-8", "surrogatepass")), own))
                    words += len(own)
                    if words >= BLOCK_WORDS:
                        yield _file_block(block, window, gram, hot)
                        block, words = [], 0
        if block:
            yield _file_block(block, window, gram, hot)

    return run


def _read_groups(batches):
    """Sorted records -> ranges of starts to remove: ord, at (text crc and first start), n.

    The only state between batches is the first leaf of each node of the last group.
    """
    state = None  # columns g, lead, check, ord, at of first leaves
    for batch in batches:
        g, order, at = (batch.column(k).to_numpy() for k in range(3))
        leaves = batch.column(3)
        sizes = np.diff(np.frombuffer(leaves.buffers()[1], np.int32)[leaves.offset : leaves.offset + len(leaves) + 1])
        own = sizes == 0
        out = [(order[own], at[own], g[own])]
        if not own.all():
            buffer = np.frombuffer(leaves.buffers()[2], np.uint8)
            offsets = np.frombuffer(leaves.buffers()[1], np.int32)[leaves.offset : leaves.offset + len(leaves) + 1].astype(np.int64)
            # Groups of one record, away from the batch's ends, hold no repeat.
            single = np.ones(len(g), bool)
            single[1:] &= g[1:] != g[:-1]
            single[:-1] &= g[:-1] != g[1:]
            single[-1] = False
            if state is not None:
                single[g == state[0][0]] = False
            rows = np.nonzero(~own & ~single)[0]
            m = (sizes[rows] - 1) // 8
            row = np.repeat(rows, m)
            k = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            place = offsets[row] + 1 + 8 * k
            check = np.zeros(len(place), np.int64)
            for b in range(8):
                check |= buffer[place + b].astype(np.int64) << (8 * b)
            columns = [g[row], buffer[offsets[row]].astype(np.int64) - k, check, order[row], at[row] + k]
            carried = 0
            if state is not None:
                carried = len(state[0])
                columns = [np.concatenate([s, c]) for s, c in zip(state, columns)]
            later = _later(columns[:3], columns[3:])
            d, a, b = _ranges_of(columns[3][carried:][later[carried:]], columns[4][carried:][later[carried:]])
            out.append((d, a, b - a))
            last = (columns[0] == g[~own][-1]) & ~later
            state = [c[last] for c in columns]
            order_ = np.lexsort(state[::-1])
            fresh = np.concatenate([[True], np.any([s[order_][1:] != s[order_][:-1] for s in state], axis=0)]) if len(order_) else np.zeros(0, bool)
            state = [s[order_][fresh] for s in state] if len(order_) else None
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]), pa.int64()) for k in range(3)], names=["ord", "at", "n"])


def _ranges_of(order: np.ndarray, at: np.ndarray):
    sort = np.lexsort([at, order])
    return _ranges(order[sort], at[sort])


def _order() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bound: int | None = None) -> DataFrame:
    """Ranges of window starts whose words also start earlier: (ord, crc, ranges array<struct<a, n>>) a document.

    ord is doc_id, null ids last; crc tells rows that share a doc_id apart by their text.
    """
    spark = docs.sparkSession
    hot = hot_slots(docs, window, gram, HOT_SUFFIXES if bound is None else bound)
    filed = docs.select(_order().alias("ord"), F.col("text")).where(F.col("text").isNotNull()).mapInArrow(tidy(_file(window, gram, hot)), RECORDS)
    n = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    group = F.when(F.length("leaves") > 0, F.col("g")).otherwise(F.xxhash64("ord", "at"))
    found = filed.repartition(n, group).sortWithinPartitions("g", "ord", "at").mapInArrow(tidy(_read_groups), "ord long, at long, n long")
    return (
        found.select("ord", F.shiftrightunsigned("at", 32).alias("crc"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("a"), "n")
        .groupBy("ord", "crc").agg(F.collect_list(F.struct("a", "n")).alias("ranges"))
    )


def _kept(text: str | None, ranges, window: int) -> tuple[int, list[bytes]]:
    words = words_of(text)
    if ranges is None or not len(ranges):
        return len(words), words
    step = np.zeros(len(words) + 1, np.int64)
    for x in ranges:
        step[x["a"]] += 1
        step[min(len(words), x["a"] + x["n"] - 1 + window)] -= 1
    covered = np.cumsum(step[:-1]) > 0
    return len(words), [w for w, c in zip(words, covered.tolist()) if not c]


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`docs` with n_words, n_removed and kept (the words left, joined by one space).

    A word goes if a window of `window` words of its document covers it whose words also start
    earlier: in a smaller doc_id, or earlier in the same document. Windows are judged on the
    input. Null ids come after all others; rows that share a doc_id are in the order of a
    checksum of their texts, and equal rows are one place, so none is earlier. Null, empty
    and short texts lose nothing. Other columns stay, but for any named like the three new ones.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    ranged = cut(repeats(docs, window, gram).toDF("__ord", "__crc", "__ranges"))
    keyed = docs.withColumns({"__o": _order(), "__c": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    # Only documents with ranges, and a few others, meet them in a shuffle.
    here, away = split_by_filter(keyed, ["__o", "__c"], ranged, ["__ord", "__crc"])
    met = here.join(ranged, (F.col("__o") == F.col("__ord")) & (F.col("__c") == F.col("__crc")), "left")
    joined = met.drop("__o", "__c", "__ord", "__crc").unionByName(away.drop("__o", "__c"), allowMissingColumns=True)
    fields = [f for f in joined.schema if f.name != "__ranges"]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(k, 500)
                rows = [_kept(t, r, window) for t, r in zip(part.column("text").to_pylist(), part.column("__ranges").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(x) for x in names), pa.array([n for n, _ in rows], pa.int64()), pa.array([n - len(w) for n, w in rows], pa.int64()), pa.array([b" ".join(w).decode("utf-8", "replace") for _, w in rows], pa.string())],
                    names=[*names, "n_words", "n_removed", "kept"],
                )

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([*fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    return joined.mapInArrow(tidy(run), schema)


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """deduplicate(), with the kept text as the SHA-256 of its UTF-8."""
    return deduplicate(docs.select("doc_id", "text"), window, gram).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def sha256_of(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()
