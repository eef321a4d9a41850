"""LM scoring with a hierarchical Pitman-Yor model.

Customers are the training tokens. A token is seated in the restaurant of its context, the previous word; each
table opened there sends a customer to the parent restaurant, so restaurants share parents:

    previous word -> its two last characters -> its last character -> root

The root's new tables draw from a uniform base over the V training words and one class of unknown words, each
1 / (V + 1), in seating and in scoring alike. Seating is sampled by
Gibbs sweeps over tables of every (restaurant, word); probabilities are averaged over samples.

Everything about a word (its counts in all restaurants, its tables) is kept in one shard by the word's
hash. Restaurants of words are as many as there are words, so their totals are dealt by the hash of the context
and sent only to shards that hold the context; those of the classes of characters are a bounded
number (slots of a hash), so their totals are arrays summed between jobs:

1. blocks of documents become requests: for each shard the block's distinct (word, context) pairs
   with their training counts, pre-aggregated, and the block's documents as indices of those pairs. Both are
   stored as they come; requests are then dealt to their shards part by part, documents stay where they are;
2. shards sum the counts and learn each context's customers and distinct words in the whole corpus;
3. shards sample seatings and send restaurant totals;
4. with the tables of their samples and the summed totals shards answer each block's pairs
   with averaged log probabilities; blocks add them up by document.

Sweeps see a context's tables as one for each distinct word in other shards and as they are in their own, and the
totals of the classes from their own shard, scaled to the corpus; a shard holds a random part of the
vocabulary. The final probabilities use the exact totals of each sample.
"""

from __future__ import annotations

import array
import functools
import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from taxonaut.llm.common import cut, cut_in_place, forget, shared_folder, stored, words_of

LAST_SLOTS = 64
PAIR_SLOTS = 64
#: Discounts and strengths of root, last-character, two-character and word restaurants.
DISCOUNT = (0.75, 0.8, 0.85, 0.85)
STRENGTH = (10.0, 10.0, 10.0, 10.0)
SWEEPS = 3
SAMPLES = 3
#: Shards of the vocabulary at least, and the text of a shard in a larger corpus, so that a shard's part of all pairs stays bounded.
SHARDS = 64
SHARD_TEXT = 16 << 20
#: Parts in which shards are dealt, one after the other, so that only a part of all requests lies on disk twice; fewer where there is less text.
PARTS = 4
PART_TEXT = 64 << 20
BLOCK_TOKENS = 2_500_000
#: Pairs a shard takes in before it sums them.
HELD_PAIRS = 2_000_000
MARKS = b".,;:!?*$%&#|\"'()"
END = b"\n"  # no word holds a line feed

#: Words that a worker remembers between blocks.
KNOWN_WORDS = 500_000


class Vocabulary(dict):
    """Numbers of words, in the order in which they were met, with the hash of each and the class of the context that it makes for the word that follows."""

    def __init__(self):
        super().__init__()
        self.hashes, self.classes = array.array("Q"), array.array("H")

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = number = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        stem = word.rstrip(MARKS) or word
        tail = stem.decode("utf-8", "replace")[-2:]
        last = zlib.crc32(tail[-1:].encode("utf-8", "replace")) % LAST_SLOTS
        self.classes.append(last * PAIR_SLOTS + zlib.crc32(tail[:1].encode("utf-8", "replace")) % PAIR_SLOTS)
        return number

    def forget(self) -> None:
        """Start anew once there are too many words; numbers given before hold no longer."""
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.hashes, self.classes = array.array("Q"), array.array("H")


RESTAURANTS = LAST_SLOTS * PAIR_SLOTS
_vocabulary = Vocabulary()
_START = zlib.crc32(b"start") % RESTAURANTS
#: A context's number: 40 bits of its word's hash above its two-character restaurant.
CLASS_BITS = 12
ID_BITS = 52
assert RESTAURANTS == 1 << CLASS_BITS


def _context_ids(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - ID_BITS + CLASS_BITS) << np.uint64(CLASS_BITS)) | classes.astype(np.uint64)


def _planes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of contexts as class, low and high part of the hash, which pack better apart."""
    return (ids & np.uint64(RESTAURANTS - 1)).astype("u2"), (ids >> np.uint64(CLASS_BITS) & np.uint64(0xFFFFFFFF)).astype("u4"), (ids >> np.uint64(CLASS_BITS + 32)).astype("u1")


PLANES = ("u2", "u4", "u1")


def _ids(rest: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(CLASS_BITS + 32)) | (low.astype(np.uint64) << np.uint64(CLASS_BITS)) | rest.astype(np.uint64)


def _range_of(ids: np.ndarray, shards: int) -> np.ndarray:
    """Which of `shards` ranges of contexts, in order."""
    return (ids >> np.uint64(ID_BITS - 16)).astype(np.int64) * shards >> 16


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, np.int64, len(types))
    out, at = [], 8 * len(types)
    for n, t in zip(sizes, types):
        out.append(np.frombuffer(raw, t, int(n), at))
        at += int(n) * np.dtype(t).itemsize
    return out


def _encode_block(block, words: Vocabulary, shards: int, block_id: int):
    """(shard, kind, block id, data) rows of a block [(doc_id, learn, numbers of words)]: requests, and of kind 1 the documents."""
    size = np.array([len(x[2]) for x in block], np.int64)
    number = np.concatenate([x[2] for x in block])
    # Words and contexts are told apart once for each different word.
    seen = np.nonzero(np.bincount(number, minlength=len(words)))[0]
    hashes = np.array(words.hashes, np.uint64)[seen]
    own_contexts = _context_ids(hashes, np.array(words.classes, np.int64)[seen])
    contexts, context_of = np.unique(np.append(own_contexts, np.uint64(_START)), return_inverse=True)
    unique, word_of = np.unique(hashes, return_inverse=True)
    place = np.zeros(len(words), np.int32)
    place[seen] = np.arange(len(seen))
    number = place[number]
    context = np.zeros(len(number), np.int32)
    context[1:] = context_of.astype(np.int32)[number[:-1]]
    context[np.cumsum(size) - size] = context_of[-1]
    # Arrays as long as the block go as soon as they are used.
    pair_of = word_of[number]
    del number
    pair_of *= len(contexts)
    pair_of += context
    del context
    order = np.argsort(pair_of).astype(np.uint32)
    pair_of = pair_of[order]
    new = np.ones(len(order), bool)
    new[1:] = pair_of[1:] != pair_of[:-1]
    pair = pair_of[new]
    del pair_of
    count = np.add.reduceat(np.repeat(np.array([x[1] for x in block], bool), size)[order], np.nonzero(new)[0], dtype=np.uint32)
    index = np.empty(len(order), np.uint32)
    index[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    del order, new
    first = np.searchsorted(pair // len(contexts), np.arange(len(unique) + 1))
    # Shards are ranges of the hash, so words, and with them pairs, stay in order.
    shard = (unique >> np.uint64(48)).astype(np.int64) * shards >> 16
    for s in range(shards):
        a, b = np.searchsorted(shard, [s, s + 1])
        if a == b:
            continue
        pairs = slice(first[a], first[b])
        pairs_of = np.diff(first[a : b + 1])
        own = unique[a:b]
        step = np.concatenate([own[:1], np.diff(own)])
        yield s, 0, block_id, _pack(step, pairs_of.astype(np.uint32), *_planes(contexts[pair[pairs] % len(contexts)]), count[pairs])
    ids = np.array([x[0] if x[0] is not None else 0 for x in block], np.int64)
    null = np.array([x[0] is None for x in block], np.uint8)
    flags = np.array([x[1] for x in block], np.uint8)
    yield block_id % shards, 1, block_id, _pack(ids, null, flags, size, index)


def _encode(shards: int):
    def run(batches):
        from pyspark import TaskContext

        block, tokens = [], 0
        # A task that runs again gives its blocks the same numbers.
        numbers = itertools.count(TaskContext.get().partitionId() << 32)

        def out():
            rows = list(_encode_block(block, _vocabulary, shards, next(numbers)))
            _vocabulary.forget()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], names=["shard", "kind", "block", "data"])

        for batch in batches:
            for doc_id, text, learn in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = words_of(text.as_py(), lower=True)
                words.append(END)
                block.append((doc_id, bool(learn), np.fromiter(map(_vocabulary.__getitem__, words), np.int32, len(words))))
                tokens += len(words)
                if tokens >= BLOCK_TOKENS:
                    yield out()
                    block, tokens = [], 0
        if block:
            yield out()

    return run


class Shard:
    """Counts of a shard's words: (word, restaurant) rows, and the same rolled up to parents and root."""

    def __init__(self, requests: list[bytes]):
        hashes, rests, counts = [], [], []
        for data in requests:
            step, pairs_of, rest, count = _unpack(data, "u8", "u2", "u2", "u4")
            with np.errstate(over="ignore"):
                words = np.cumsum(step, dtype=np.uint64)
            keep = count > 0
            hashes.append(np.repeat(words, pairs_of)[keep])
            rests.append(rest[keep])
            counts.append(count[keep])
        h, r, c = np.concatenate(hashes), np.concatenate(rests).astype(np.int64), np.concatenate(counts).astype(np.int64)
        self.words, w = np.unique(h, return_inverse=True)
        at = self._parents(w.astype(np.int64) * RESTAURANTS + r)
        self.c2 = np.bincount(at, weights=c, minlength=len(self.key)).astype(np.int64)
        self.count = np.bincount(self.up0[self.up1], weights=self.c2, minlength=len(self.words)).astype(np.int64)

    def _parents(self, key2: np.ndarray) -> np.ndarray:
        """Rows of the character restaurants over all `key2`; returns each key's row."""
        self.key, at = np.unique(key2, return_inverse=True)
        self.rest2 = self.key % RESTAURANTS
        key1, self.up1 = np.unique(self.key // PAIR_SLOTS, return_inverse=True)
        self.rest1 = key1 % LAST_SLOTS
        self.up0 = key1 // LAST_SLOTS  # word number
        return at

    def seatings(self, seed: int, scale: float):
        """Samples of tables (t2, t1, t0) of each row; customers of a parent are its children's tables."""
        rng = np.random.default_rng(seed)
        t2 = np.minimum(self.c2, 1)
        c1 = np.bincount(self.up1, weights=t2, minlength=len(self.rest1)).astype(np.int64)
        t1 = np.minimum(c1, 1)
        c0 = np.bincount(self.up0, weights=t1, minlength=len(self.words)).astype(np.int64)
        t0 = np.minimum(c0, 1)
        for sweep in range(SWEEPS + SAMPLES):
            n0, k0 = max(1.0, c0.sum() * scale), t0.sum() * scale
            p0 = (c0 - DISCOUNT[0] * t0 + (STRENGTH[0] + DISCOUNT[0] * k0) / (1.0 + len(self.words) * scale)) / (STRENGTH[0] + n0)
            p1, _ = self._predict(1, c1, t1, p0[self.up0], self.rest1, LAST_SLOTS, scale)
            t2 = _seat(rng, self.c2, DISCOUNT[2], self._opens(2, t2, p1[self.up1], self.rest2, RESTAURANTS, scale))
            c1 = np.bincount(self.up1, weights=t2, minlength=len(self.rest1)).astype(np.int64)
            t1 = _seat(rng, c1, DISCOUNT[1], self._opens(1, t1, p0[self.up0], self.rest1, LAST_SLOTS, scale))
            c0 = np.bincount(self.up0, weights=t1, minlength=len(self.words)).astype(np.int64)
            t0 = _seat(rng, c0, DISCOUNT[0], np.full(len(c0), (STRENGTH[0] + DISCOUNT[0] * t0.sum() * scale) / (1.0 + len(self.words) * scale)))
            if sweep >= SWEEPS:
                yield t2, c1, t1, c0, t0

    @staticmethod
    def _opens(level, tables, parent, rest, slots, scale):
        """Weight of a new table beside that of the dish's customers: (strength + discount * tables) * parent probability."""
        total = np.bincount(rest, weights=tables, minlength=slots)[rest] * scale
        return (STRENGTH[level] + DISCOUNT[level] * total) * parent

    @staticmethod
    def _predict(level, customers, tables, parent, rest, slots, scale):
        n = np.bincount(rest, weights=customers, minlength=slots) * scale
        k = np.bincount(rest, weights=tables, minlength=slots) * scale
        share = (STRENGTH[level] + DISCOUNT[level] * k) / (STRENGTH[level] + n)
        return (customers - DISCOUNT[level] * tables) / (STRENGTH[level] + n[rest]) + share[rest] * parent, share


class WordShard(Shard):
    """Counts of a shard's words in restaurants of whole words: (word, context) rows above those of Shard.

    `contexts` are all that the shard's blocks ask for, `key3` and `c3` the pairs with training counts.
    """

    def __init__(self, requests: list[bytes]):
        h = i = np.zeros(0, np.uint64)
        c, self.contexts = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        held, size = [], 0
        for k, data in enumerate(requests):
            words, pairs_of, ids, count = self.request(data)
            keep = count > 0
            held.append((np.repeat(words, pairs_of)[keep], ids[keep], count[keep].astype(np.int64), np.unique(ids)))
            size += len(ids)
            if size > HELD_PAIRS or k == len(requests) - 1:
                h, i, c = (np.concatenate([old, *(x[n] for x in held)]) for n, old in enumerate((h, i, c)))
                order = np.lexsort((i, h))
                h, i, c = h[order], i[order], c[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (i[1:] != i[:-1])
                first = np.nonzero(new)[0]
                h, i, c = h[first], i[first], np.add.reduceat(c, first) if len(first) else c
                self.contexts = np.unique(np.concatenate([self.contexts, *(x[3] for x in held)]))
                held, size = [], 0
        self.words, w = np.unique(h, return_inverse=True)
        self.context3 = np.searchsorted(self.contexts, i)
        self.key3, self.c3 = w.astype(np.int64) * max(1, len(self.contexts)) + self.context3, c
        self.up2 = self._parents(w.astype(np.int64) * RESTAURANTS + (i & np.uint64(RESTAURANTS - 1)).astype(np.int64))
        self.count = np.bincount(w, weights=c, minlength=len(self.words)).astype(np.int64)

    @staticmethod
    def request(data: bytes):
        """Words, pairs of each, their contexts and training counts."""
        step, pairs_of, rest, low, high, count = _unpack(data, "u8", "u4", *PLANES, "u4")
        with np.errstate(over="ignore"):
            return np.cumsum(step, dtype=np.uint64), pairs_of, _ids(rest, low, high), count

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context3, weights=values, minlength=len(self.contexts)).astype(np.int64)

    def samples(self, data: bytes) -> list[tuple[np.ndarray, ...]]:
        """Samples as word_seatings() gave them, from their tables: customers of a parent are its children's tables."""
        tables = [t.astype(np.int64) for t in _unpack(data, *["u4"] * (4 * SAMPLES))]
        count = lambda up, t, n: np.bincount(up, weights=t, minlength=n).astype(np.int64)
        return [(t3, count(self.up2, t3, len(self.key)), t2, count(self.up1, t2, len(self.rest1)), t1, count(self.up0, t1, len(self.words)), t0) for t3, t2, t1, t0 in zip(*(tables[i::4] for i in range(4)))]

    def word_seatings(self, seed: int, scale: float, kinds: np.ndarray):
        """Samples of tables (t3, c2, t2, c1, t1, c0, t0); kinds: distinct words of each context in the whole corpus."""
        rng = np.random.default_rng(seed)
        elsewhere = kinds - self.by_context(np.minimum(self.c3, 1))
        t3 = np.minimum(self.c3, 1)
        t1 = t2 = t0 = None
        for sweep in range(SWEEPS + SAMPLES):
            c2 = np.bincount(self.up2, weights=t3, minlength=len(self.key)).astype(np.int64)
            t2 = np.minimum(c2, 1) if t2 is None else _seat(rng, c2, DISCOUNT[2], self._opens(2, t2, p1[self.up1], self.rest2, RESTAURANTS, scale))
            c1 = np.bincount(self.up1, weights=t2, minlength=len(self.rest1)).astype(np.int64)
            t1 = np.minimum(c1, 1) if t1 is None else _seat(rng, c1, DISCOUNT[1], self._opens(1, t1, p0[self.up0], self.rest1, LAST_SLOTS, scale))
            c0 = np.bincount(self.up0, weights=t1, minlength=len(self.words)).astype(np.int64)
            t0 = np.minimum(c0, 1) if t0 is None else _seat(rng, c0, DISCOUNT[0], np.full(len(c0), (STRENGTH[0] + DISCOUNT[0] * t0.sum() * scale) / (1.0 + len(self.words) * scale)))
            if sweep > SWEEPS:
                yield t3, c2, t2, c1, t1, c0, t0
            n0, k0 = max(1.0, c0.sum() * scale), t0.sum() * scale
            p0 = (c0 - DISCOUNT[0] * t0 + (STRENGTH[0] + DISCOUNT[0] * k0) / (1.0 + len(self.words) * scale)) / (STRENGTH[0] + n0)
            p1, _ = self._predict(1, c1, t1, p0[self.up0], self.rest1, LAST_SLOTS, scale)
            p2, _ = self._predict(2, c2, t2, p1[self.up1], self.rest2, RESTAURANTS, scale)
            tables = (elsewhere + self.by_context(t3))[self.context3]
            t3 = _seat(rng, self.c3, DISCOUNT[3], (STRENGTH[3] + DISCOUNT[3] * tables) * p2[self.up2])
        c2 = np.bincount(self.up2, weights=t3, minlength=len(self.key)).astype(np.int64)
        t2 = _seat(rng, c2, DISCOUNT[2], self._opens(2, t2, p1[self.up1], self.rest2, RESTAURANTS, scale))
        c1 = np.bincount(self.up1, weights=t2, minlength=len(self.rest1)).astype(np.int64)
        t1 = _seat(rng, c1, DISCOUNT[1], self._opens(1, t1, p0[self.up0], self.rest1, LAST_SLOTS, scale))
        c0 = np.bincount(self.up0, weights=t1, minlength=len(self.words)).astype(np.int64)
        t0 = _seat(rng, c0, DISCOUNT[0], np.full(len(c0), (STRENGTH[0] + DISCOUNT[0] * t0.sum() * scale) / (1.0 + len(self.words) * scale)))
        yield t3, c2, t2, c1, t1, c0, t0


#: Candidates for a new table that are drawn at once for one dish.
CANDIDATES = 1 << 16


def _seat(rng, customers: np.ndarray, discount: float, opens: np.ndarray, exact: int = 16) -> np.ndarray:
    """Tables that `customers` of one dish take when each opens one with weight `opens`, or joins with n - discount * tables.

    The first `exact` customers are seated one by one. After them customers are seated in runs that double the number of
    those seated: the chance of the first of a run bounds all others of the run, so candidates for a new table are drawn by
    their geometric gaps at this chance, and each is kept by the ratio of its own. Both are the same process; the second
    costs as much as there are tables.
    """
    tables = np.minimum(customers, 1)
    live = np.nonzero(customers > 1)[0]
    n = 1
    while len(live) and n < exact:
        t, w = tables[live].astype(float), opens[live]
        tables[live] += rng.random(len(live)) < w / (w + n - discount * t)
        n += 1
        live = live[customers[live] > n]
    seated = np.full(len(live), float(n))
    while len(live):
        t, w, end = tables[live].astype(float), opens[live], np.minimum(2 * seated, customers[live])
        total = w + seated - discount * t
        expected = (end - seated) * w / total
        tries = np.minimum(expected + 4 * np.sqrt(expected) + 2, CANDIDATES).astype(np.int64)
        of, first = np.repeat(np.arange(len(live)), tries), np.cumsum(tries) - tries
        with np.errstate(divide="ignore"):
            gaps = np.ceil(np.log1p(-rng.random(len(of))) / np.log1p(-np.minimum(w / total, 1.0))[of])
        run = np.cumsum(np.clip(gaps, 1, (end - seated + 1)[of]))
        at = seated[of] + run - np.append(0.0, run)[first][of]
        # A run whose candidates do not reach its end stops at the last of them.
        stop = np.minimum(end, at[first + tries - 1])
        inside = at <= end[of]
        of, weight = of[inside], (w - discount * t)[of[inside]] + at[inside] - 1
        limit, drawn = total[of], rng.random(len(of))
        begin = np.searchsorted(of, np.arange(len(live)))
        kept, opened = None, drawn * weight < limit
        # Tables opened before a candidate raise its chance: adding them up again and again ends at what one by one gives.
        while kept is None or (kept != opened).any():
            kept = opened
            upto = np.append(0, np.cumsum(kept))
            opened = drawn * (weight - discount * (upto[:-1] - upto[begin][of])) < limit
        tables[live] += np.bincount(of, weights=kept, minlength=len(live)).astype(tables.dtype)
        more = stop < customers[live]
        live, seated = live[more], stop[more]
    return tables


def _rows(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """(kind, block, data) in order."""
    kinds, blocks = (table.column(c).to_pylist() for c in ("kind", "block"))
    data = table.column("data")
    return [(kinds[k], blocks[k], data[k].as_py()) for k in sorted(range(len(blocks)), key=lambda k: (kinds[k], blocks[k]))]


MESSAGE = "shard int, kind int, block long, data binary"


def _part_of(shards: int, parts: int) -> Column:
    """The part of a request's shard; -1 for documents."""
    return F.when(F.col("kind") == 1, F.lit(-1)).otherwise(F.floor(F.col("shard") * F.lit(parts) / F.lit(shards)).cast("int"))


def _delete(spark, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _dealt_parts(encoded: DataFrame, shards: int, count: int) -> tuple[list[DataFrame], DataFrame]:
    """Requests of each part, dealt by shard, and the blocks' documents."""
    spark = encoded.sparkSession
    path = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    # The data are packed already.
    encoded.withColumn("part", _part_of(shards, count)).write.option("compression", "uncompressed").partitionBy("part").parquet(path)
    read = spark.read.schema(f"{MESSAGE}, part int").parquet(path)
    parts = []
    for part in range(count):
        parts.append(cut_in_place(read.where(F.col("part") == part).drop("part").repartition(shards, "shard")))
        _delete(spark, f"{path}/part={part}")
        forget(spark)
    return parts, read.where("part = -1").drop("part")


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _table(rows) -> pa.Table:
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "block": pa.array([r[2] for r in rows], pa.int64()), "data": pa.array([r[3] for r in rows], pa.binary())})


def _dealt(own: WordShard, shard: int, shards: int, *values: np.ndarray):
    """Messages to the ranges of contexts: the shard's contexts and its values of each."""
    of = _range_of(own.contexts, shards)
    for s in np.unique(of).tolist():
        a, b = np.searchsorted(of, [s, s + 1])
        yield s, 0, shard, _pack(*_planes(own.contexts[a:b]), *(v[a:b].astype("u4") for v in values))


def _summed(messages: DataFrame, count: int, kind: int) -> DataFrame:
    """Totals over all shards of what _dealt() sent, back to each shard, in the order of its contexts."""

    def total(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        parts = [_unpack(data, *PLANES, *["u4"] * count) for _, _, data in rows]
        ids = [_ids(*x[:3]) for x in parts]
        all_ids, at = np.unique(np.concatenate(ids), return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate([x[3 + k] for x in parts]), minlength=len(all_ids)).astype("u8") for k in range(count)]
        here = table.column("shard")[0].as_py()
        ends = np.cumsum([len(x) for x in ids])
        return _table([(shard, kind, here, _pack(*(v[at[end - len(own) : end]] for v in sums))) for (_, shard, _), own, end in zip(rows, ids, ends.tolist())])

    return messages.groupBy("shard").applyInArrow(total, MESSAGE)


def _answers(rows, kind: int, count: int) -> list[np.ndarray]:
    """The totals that _summed() sent back, over all contexts of the shard."""
    parts = [_unpack(data, *["u8"] * count) for k, _, data in rows if k == kind]
    return [np.concatenate([np.zeros(0, np.int64), *(p[n].astype(np.int64) for p in parts)]) for n in range(count)]


def score(docs: DataFrame, held_out: Column, shards: int | None = None) -> DataFrame:
    """Score whole documents (doc_id, text) under the model learnt from rows where `held_out` is false.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (add-half
    unigrams) and score, log10. Null and empty texts are an end alone. Rows that share a doc_id are scored
    each. With nothing to learn from, every token has probability one of a single unknown class.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, count = shards or max(SHARDS, -(-size // SHARD_TEXT)), max(1, min(PARTS, size // PART_TEXT))
    flagged = docs.select(F.col("doc_id").cast("long"), F.col("text"), (~held_out).alias("learn"))
    parts, documents = _dealt_parts(flagged.mapInArrow(_encode(shards), MESSAGE), shards, count)

    def learnt(table: pa.Table) -> pa.Table:
        own, shard = WordShard([d for _, _, d in _rows(table)]), table.column("shard")[0].as_py()
        return _table(list(_dealt(own, shard, shards, own.by_context(own.c3), own.by_context(np.ones(len(own.c3))))))

    # Customers and distinct words of every context, for the shards that hold it.
    known = cut(_summed(_union([p.groupBy("shard").applyInArrow(learnt, MESSAGE) for p in parts]), 2, 2))

    def beside(messages: DataFrame, part: int) -> DataFrame:
        """Messages to the shards of a part, under column names of their own."""
        own = messages.where(_part_of(shards, count) == part)
        return own.select(*[F.col(c).alias(c) for c in own.columns])

    forget(spark)

    def totals(left: pa.Table, right: pa.Table) -> pa.Table:
        """Messages on contexts; restaurant totals of characters, of kind 1: level, sample, slot, customers, tables; level -1: tokens and words."""
        if not left.num_rows:
            return _table([])
        shard = left.column("shard")[0].as_py()
        own = WordShard([d for _, _, d in _rows(left)])
        kinds = _answers(_rows(right), 2, 2)[1]
        out, k3, drawn = [(-1, 0, 0, int(own.count.sum()), len(own.words))], [np.zeros(len(own.contexts), np.int64)] * SAMPLES, []
        if len(own.words):
            for m, (t3, c2, t2, c1, t1, c0, t0) in enumerate(own.word_seatings(shard, float(shards), kinds)):
                k3[m] = own.by_context(t3)
                drawn += [t.astype("u4") for t in (t3, t2, t1, t0)]
                for level, rest, slots, c, t in ((2, own.rest2, RESTAURANTS, c2, t2), (1, own.rest1, LAST_SLOTS, c1, t1)):
                    nn, kk = (np.bincount(rest, weights=x, minlength=slots) for x in (c, t))
                    out += [(level, m, int(s), int(nn[s]), int(kk[s])) for s in np.nonzero(nn)[0]]
                out.append((0, m, 0, int(c0.sum()), int(t0.sum())))
        return _table([*_dealt(own, shard, shards, *k3), (shard, 1, shard, np.array(out, "<i8").tobytes()), (shard, 4, shard, _pack(*drawn))])

    def apart(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = np.frombuffer(data.as_py(), "<i8").reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(5)], names=["level", "sample", "slot", "n", "k"])

    n = {0: np.zeros((SAMPLES, 1)), 1: np.zeros((SAMPLES, LAST_SLOTS)), 2: np.zeros((SAMPLES, RESTAURANTS))}
    k = {level: np.zeros_like(x) for level, x in n.items()}
    tokens = words = 0
    sent = cut(_union([p.groupBy("shard").cogroup(beside(known, k).groupBy("shard")).applyInArrow(totals, MESSAGE) for k, p in enumerate(parts)]))
    forget(spark)
    summed = sent.where("kind = 1").select("data").mapInArrow(apart, "level long, sample long, slot long, n long, k long").groupBy("level", "sample", "slot").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    for r in summed.collect():  # samples * restaurants of characters rows
        if r["level"] < 0:
            tokens, words = r["n"], r["k"]
        else:
            n[r["level"]][r["sample"], r["slot"]], k[r["level"]][r["sample"], r["slot"]] = r["n"], r["k"]
    shared = spark.sparkContext.broadcast((n, k, tokens, words))
    told = cut(_union([known, _summed(sent.where("kind = 0"), SAMPLES, 3), sent.where("kind = 4")]))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's pairs: log10 of the averaged probability, and the training counts of its words."""
        if not left.num_rows:
            return _table([])
        n, k, _, words = shared.value
        share = [(STRENGTH[v] + DISCOUNT[v] * k[v]) / (STRENGTH[v] + n[v]) for v in range(3)]
        shard, rows = left.column("shard")[0].as_py(), _rows(left)
        own = WordShard([d for _, _, d in rows])
        replies = _rows(right)
        n3 = _answers(replies, 2, 2)[0]
        k3 = _answers(replies, 3, SAMPLES)
        samples = own.samples(next(data for kind, _, data in replies if kind == 4)) if len(own.words) else []
        # Probabilities of a word at the root and in parents, for words of the shard and (last row) unknown ones.
        new = [share[0][m, 0] / (words + 1) for m in range(SAMPLES)]
        root = [np.append((x[5] - DISCOUNT[0] * x[6]) / (STRENGTH[0] + n[0][m, 0]) + new[m], new[m]) for m, x in enumerate(samples)]
        key1 = own.up0 * LAST_SLOTS + own.rest1
        counts, out = np.append(own.count, 0), []
        for _, block, data in rows:
            hashes, pairs_of, ids, _ = own.request(data)
            at = _find(own.words, hashes)
            w = np.repeat(np.where(at < 0, len(own.words), at), pairs_of)
            context = np.searchsorted(own.contexts, ids)
            rest = (ids & np.uint64(RESTAURANTS - 1)).astype(np.int64)
            last = rest // PAIR_SLOTS
            i3, i2, i1 = _find(own.key3, w * len(own.contexts) + context), _find(own.key, w * RESTAURANTS + rest), _find(key1, w * LAST_SLOTS + last)
            p = np.zeros(len(rest))
            below = STRENGTH[3] + n3[context]
            for m, (t3, c2, t2, c1, t1, _, _) in enumerate(samples):
                p1 = _rest(c1 - DISCOUNT[1] * t1, i1) / (STRENGTH[1] + n[1][m, last]) + share[1][m, last] * root[m][w]
                p2 = _rest(c2 - DISCOUNT[2] * t2, i2) / (STRENGTH[2] + n[2][m, rest]) + share[2][m, rest] * p1
                p += (_rest(own.c3 - DISCOUNT[3] * t3, i3) + (STRENGTH[3] + DISCOUNT[3] * k3[m][context]) * p2) / below
            # A shard without training words still backs off by the whole corpus's totals.
            unknown = np.mean([(STRENGTH[3] + DISCOUNT[3] * k3[m][context]) / below * share[2][m, rest] * share[1][m, last] * new[m] for m in range(SAMPLES)], axis=0)
            logs = np.log10(p / SAMPLES if samples else unknown)
            out.append((block % shards, 2, block, _pack(logs.astype(np.float32), counts[at].astype(np.uint32), pairs_of, np.array([shard], np.int64))))
        return _table(out)

    del known, sent, summed
    answers = []
    for part in range(count):
        # Requests go as soon as they are answered.
        requests = parts.pop(0)
        answers.append(stored(requests.groupBy("shard").cogroup(beside(told, part).groupBy("shard")).applyInArrow(answer, MESSAGE)))
        del requests
        forget(spark)
    blocks = _union([*answers, documents]).select("kind", "block", "data")

    def add_up(table: pa.Table) -> pa.Table:
        _, _, tokens, words = shared.value
        parts = []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data")):
            if kind == 1:
                ids, null, learn, size, index = _unpack(data.as_py(), "i8", "u1", "u1", "i8", "u4")
            else:
                parts.append(_unpack(data.as_py(), "f4", "u4", "u4", "i8"))
        parts.sort(key=lambda x: x[3][0])
        logs, counts = [x[0] for x in parts], [np.repeat(x[1], x[2]) for x in parts]
        logs, counts = np.concatenate(logs).astype(np.float64), np.concatenate(counts)
        base = np.log10((counts + 0.5) / (tokens + 0.5 * (words + 1)))
        ends = np.cumsum(size)

        def by_document(x):
            total = np.concatenate([[0.0], np.cumsum(x[index])])
            return total[ends] - total[ends - size]

        columns = [pa.array(ids, mask=null.astype(bool)), pa.array(learn == 0), pa.array(size), pa.array(by_document(counts > 0).round().astype(np.int64)), pa.array(np.full(len(ids), tokens, np.int64)), pa.array(by_document(base)), pa.array(by_document(logs))]
        return pa.table(dict(zip(("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), columns)))

    return blocks.groupBy("block").applyInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key, -1 where it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _rest(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([values, [0.0]])[at]
