"""N-gram Jaccard join by prefixes under several global orders.

A document is the set of its distinct word shingles. Whatever global order the shingles are in, two sets
as similar as the threshold share one of each other's first n - ceil(t n) + 1 shingles.
Two orders are used at once: shingles that are frequent come last in both (their counts
are gathered from all documents, a bounded table of the heaviest is kept), the others are ordered by
independent hashes. A pair is a candidate only if it meets in a prefix of *every* order and
its sizes fit; a parity sketch then bounds the symmetric difference, and what is left is
verified on whole sets.

Equal sets are one vertex (the set's fingerprint), so copies never meet. Small groups of a
shared shingle give their pairs. Sets in large groups meet in blocks of bounded size:

1. each set once, under the first of its large groups: a block gives a spanning forest of the closest pairs its
   sketches allow, which is verified; groups of near copies collapse into few components here;
2. where a group has several blocks, two sets of each component meet again, until a block has seen all;
3. groups that still hold several components: the sets outside the largest component meet all others, block by
   block, first for a forest, and after that has been verified for every pair that the sketches leave.

Only pairs of different components are ever given, so nothing is lost and no group gives all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from taxonaut.llm.common import batches_of, components, cut, cut_in_place, forget, hash_words, mix64, stored, tidy
from taxonaut.llm.substrings import _rolled

ORDERS = 2
BOTH = (1 << ORDERS) - 1
#: Sets a group may hold to give all its pairs.
SMALL = 40
#: A shingle counts as heavy in a block of documents from so many of them on; the heaviest so many are kept (4 MB).
HEAVY_IN_BLOCK = 2
HEAVY = 1 << 18
BLOCK_WORDS = 1_000_000  # shingles whose counts are taken at once, 8 bytes each
#: Cells of a parity sketch: two a shingle and more, a power of two between these.
LEAST_CELLS, MOST_CELLS = 512, 1 << 15
#: Sets of a block of a large group, and of a tile of it that is compared at once.
BLOCK_ROWS = 4096
TILE = 256
#: Rows of an Arrow batch.
BATCH = 1000
#: Bits of the filter that tells which sets a verification needs, eight a set up to this; its false positives only cost work.
MOST_FILTER_BITS = 1 << 25


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted 64-bit shingles of each text; one for the whole sequence if it has fewer than k words, none without words."""
    h, sizes = hash_words(texts, lower=True)
    rolled = _rolled(h, k, 3)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= k:
            x = np.sort(rolled[at : at + n - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif n:
            out.append(mix64(_rolled(h[at : at + n], n, 40 + n), 4))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _laid(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets end to end, their sizes, their starts."""
    sizes = np.array([len(x) for x in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes, np.cumsum(sizes) - sizes


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Signed 64-bit identity of each set."""
    tokens, sizes, starts = _laid(sets)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(tokens, 5), dtype=np.uint64)])
        return mix64(total[starts + sizes] - total[starts] + sizes.astype(np.uint64), 6).view(np.int64)


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Parity of the number of shingles in each cell; twice as many cells as the set is large, at least."""
    tokens, sizes, starts = _laid(sets)
    mixed = mix64(tokens, 7)
    out = []
    for n, at in zip(sizes.tolist(), starts.tolist()):
        cells = min(MOST_CELLS, max(LEAST_CELLS, 2 << max(0, n - 1).bit_length()))
        odd = np.bincount((mixed[at : at + n] & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def least_difference(x: bytes, y: bytes) -> int:
    """Lower bound of the size of the symmetric difference of two sketched sets; the larger sketch is folded to the smaller."""
    if len(x) < len(y):
        x, y = y, x
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _sliced(batches, rows: int = 200):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _describe(k: int):
    """Rows of documents (doc_id, f, n, sketch), and of heavy shingles of a block (f: shingle, n: documents, no sketch)."""

    def heavy(sets):
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        keep = counts >= HEAVY_IN_BLOCK
        return [(None, int(t), int(c), None) for t, c in zip(tokens[keep].view(np.int64), counts[keep])]

    def run(batches):
        kept, size = [], 0
        for part in _sliced(batches):
            rows = []
            sets = shingle_sets(part.column(1).to_pylist(), k)
            for doc_id, tokens, f, sketch in zip(part.column(0).to_pylist(), sets, fingerprints(sets).tolist(), sketches(sets)):
                rows.append((doc_id, f if len(tokens) else None, len(tokens), sketch))
                if len(tokens):
                    kept.append(tokens)
                    size += len(tokens)
            if size >= BLOCK_WORDS:
                rows += heavy(kept)
                kept, size = [], 0
            yield _batch(rows, "doc_id f n sketch", pa.int64(), pa.int64(), pa.int64(), pa.binary())
        if kept:
            yield _batch(heavy(kept), "doc_id f n sketch", pa.int64(), pa.int64(), pa.int64(), pa.binary())

    return run


def _batch(rows, names: str, *types) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names.split())


def _prefixes(k: int, num: int, den: int, heavy):
    """Rows (key, f, n) of both orders' prefixes; the lowest bit of key is the order."""

    def run(batches):
        tokens_of, count_of = heavy.value
        likely = np.zeros(1 << 20, bool)  # spares most look-ups among the heavy shingles
        likely[(tokens_of & np.uint64(len(likely) - 1)).astype(np.int64)] = True
        seen: set[int] = set()
        for part in _sliced(batches):
            keys, fs, ns, ps = [], [], [], []
            sets = shingle_sets(part.column(0).to_pylist(), k)
            every, sizes, starts = _laid(sets)
            weights = np.zeros(len(every), np.int64)
            some = np.nonzero(likely[(every & np.uint64(len(likely) - 1)).astype(np.int64)])[0]
            if len(some):
                at = np.minimum(np.searchsorted(tokens_of, every[some]), len(tokens_of) - 1)
                weights[some] = np.where(tokens_of[at] == every[some], count_of[at], 0)
            mixes = [mix64(every, 11 + order) for order in range(ORDERS)]
            for tokens, f, start in zip(sets, fingerprints(sets).tolist(), starts.tolist()):
                n = len(tokens)
                if not n or f in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(f)
                p = n + (-num * n) // den + 1  # n - ceil(num n / den) + 1
                weight = weights[start : start + n]
                weighted = weight.any()
                for order in range(ORDERS):
                    mixed = mixes[order][start : start + n]
                    first = np.lexsort((mixed, weight))[:p] if weighted else (np.argpartition(mixed, p - 1)[:p] if p < n else np.arange(n))
                    keys.append((tokens[first] << np.uint64(1)) | np.uint64(order))
                    fs.append(f)
                    ns.append(n)
                    ps.append(len(first))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(fs, np.int64), ps)), pa.array(np.repeat(np.array(ns, np.int64), ps))],
                    names=["key", "f", "n"],
                )

    return run


def _meet(num: int, den: int, most: int):
    """Sorted (key, f, n) -> rows (key, a, b, n): pairs (a, b) of small groups, key their order; sets (a, no b) of large groups.

    Between batches only the rows of the last group are held, and of a large one its last.
    """

    def fits(x, y):
        return den * np.minimum(x, y) >= num * np.maximum(x, y)

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        large = False  # the held row is of a large group and is out already
        for batch in batches:
            key, f, n = (np.concatenate([h, batch.column(c).to_numpy()]) for c, h in enumerate(held))
            fresh_from = len(held[0]) if large else 0
            if len(key) > 1:
                fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (f[1:] != f[:-1])])
                key, f, n = key[fresh], f[fresh], n[fresh]
            start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([start, [len(key)]]))
            out = []
            if len(start):
                last, last_large = start[-1], size[-1] > most or (large and len(start) == 1)
                is_large = size > most
                if large:
                    is_large[0] = True
                if not last_large:
                    is_large[-1] = False
                within = np.arange(len(key)) - np.repeat(start, size)
                done = np.ones(len(start), bool)
                done[-1] = False
                # Pairs at distance d inside small, finished groups.
                small = np.repeat(done & ~is_large & (size > 1), size)
                for d in range(1, most):
                    i = np.nonzero(small & (within >= d))[0]
                    if not len(i):
                        break
                    i = i[fits(n[i], n[i - d])]
                    out.append((key[i] & 1, f[i - d], f[i], None))
                # Large groups: every row out.
                row = np.nonzero(np.repeat(is_large, size))[0]
                row = row[row >= fresh_from]
                if len(row):
                    out.append((key[row], f[row], None, n[row]))
                large = bool(is_large[-1])
                keep = slice(len(key) - 1, None) if large else slice(last, None)
                held = [key[keep], f[keep], n[keep]]
            yield _rows(out)
        key, f, n = held
        if not large:
            out = []
            for d in range(1, len(key)):
                ok = fits(n[d:], n[:-d])
                out.append((key[d:][ok] & 1, f[:-d][ok], f[d:][ok], None))
            yield _rows(out)

    return run


class _Block:
    """Sets of a block pair, by size, compared tile by tile on their sketches."""

    def __init__(self, rows, num: int, den: int, tile: int = TILE):
        rows.sort(key=lambda r: (r[5], r[4]))
        _, self.hi, self.lo = rows[0][:3]
        self.num, self.den, self.tile = num, den, tile
        self.mine, self.f, self.n, component = (np.array([r[c] for r in rows], np.int64) for c in range(3, 7))
        self.label = np.unique(component, return_inverse=True)[1]
        self.sketches = [r[7] for r in rows]
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def _tile(self, at: int, width: int) -> np.ndarray:
        key = (at, width)
        if key not in self.folded:
            if len(self.folded) > 64:
                self.folded.clear()
            self.folded[key] = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0) for x in self.sketches[at : at + self.tile]]).view(np.uint64)
        return self.folded[key]

    def near(self):
        """(i, j, odd) of the pairs of different labels whose sizes fit and whose sketches allow the threshold."""
        num, den, tile, n, line = self.num, self.den, self.tile, self.n, np.arange(len(self.n))
        for p in range(0, len(n), tile):
            for q in range(p, len(n), tile):
                a, b = slice(p, p + tile), slice(q, q + tile)
                if den * n[a][-1] < num * n[b][0]:
                    break  # sorted by size: no later tile fits
                if self.label[a].min() == self.label[b].max() == self.label[a].max() == self.label[b].min():
                    continue
                ok = (den * np.minimum(n[a][:, None], n[b][None]) >= num * np.maximum(n[a][:, None], n[b][None])) & (self.label[a][:, None] != self.label[b][None])
                if self.hi != self.lo:
                    ok &= self.mine[a][:, None] != self.mine[b][None]
                if p == q:
                    ok &= line[a][:, None] < line[b][None]
                i, j = np.nonzero(ok)
                if not len(i):
                    continue
                width = min(len(x) for x in (*self.sketches[a], *self.sketches[b]))
                x, y = self._tile(p, width), self._tile(q, width)
                odd = np.zeros(ok.shape, np.int64)
                for word in range(x.shape[1]):
                    odd += np.bitwise_count(x[:, word][:, None] ^ y[:, word][None])
                odd = odd[i, j]
                i, j = i + p, j + q
                near = odd * (den + num) <= (den - num) * (n[i] + n[j])
                yield i[near], j[near], odd[near]

    def forest(self) -> list[tuple[int, int]]:
        """Pairs that connect what the near pairs connect: each component's closest, round by round."""
        out, size, none = [], len(self.n), 1 << 62
        while True:
            best = np.full(size, none)
            for i, j, odd in self.near():
                place = (odd * size + i) * size + j
                np.minimum.at(best, self.label[i], place)
                np.minimum.at(best, self.label[j], place)
            chosen = np.unique(best[best < none])
            if not len(chosen):
                return out
            i, j = chosen // size % size, chosen % size
            out += zip(self.f[i].tolist(), self.f[j].tolist())
            while (self.label[i] != self.label[j]).any():
                low = np.arange(size)
                np.minimum.at(low, np.maximum(self.label[i], self.label[j]), np.minimum(self.label[i], self.label[j]))
                self.label = low[self.label]

    def pairs(self) -> list[tuple[int, int]]:
        return [x for i, j, _ in self.near() for x in zip(self.f[i].tolist(), self.f[j].tolist())]


def _blocks(num: int, den: int, every: bool, tile: int):
    """Sorted rows (key, hi, lo, mine, f, n, component, sketch) -> (key, a, b) of block hi against block lo: every near pair, or a forest.

    A block pair has at most twice BLOCK_ROWS rows, about; only those are held.
    """

    def meet(rows):
        block = _Block(rows, num, den, tile)
        return [(rows[0][0], a, b) for a, b in (block.pairs() if every else block.forest())]

    def run(batches):
        held = []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if held and held[0][:3] != row[:3]:
                    out += meet(held) if len(held) > 1 else []
                    held = []
                held.append(row)
            yield _batch(out, "key a b", pa.int64(), pa.int64(), pa.int64())
        if len(held) > 1:
            yield _batch(meet(held), "key a b", pa.int64(), pa.int64(), pa.int64())

    return run


def _rows(out) -> pa.RecordBatch:
    """Columns key, a, b, n of parts; None is a column of nulls."""
    sizes = [len(x[1]) for x in out]
    columns = [pa.concat_arrays([pa.nulls(size, pa.int64()) if x[c] is None else pa.array(x[c], pa.int64()) for x, size in zip(out, sizes)] or [pa.nulls(0, pa.int64())]) for c in range(4)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "a", "b", "n"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})


def _order() -> Column:
    """The order that a key's prefix is of, as a bit."""
    return F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, 2).otherwise(1)


class _Join:
    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.docs, self.k, self.num, self.den = docs, k, num, den
        self.spark = docs.sparkSession
        described = cut(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tidy(_describe(k)), "doc_id long, f long, n long, sketch binary"))
        self.rows = described.where("sketch is not null").select("doc_id", "f", "n")
        self.sets = cut(described.where("sketch is not null and f is not null").groupBy("f").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
        self.bits = min(MOST_FILTER_BITS, 1 << (8 * max(1024, self.sets.count()) - 1).bit_length())
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        heavy = described.where("sketch is null").groupBy("f").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "f").limit(HEAVY).toArrow()
        tokens = heavy.column("f").to_numpy().view(np.uint64)
        order = np.argsort(tokens)
        self.heavy = self.spark.sparkContext.broadcast((tokens[order], heavy.column("n").to_numpy()[order]))

    def edges(self) -> DataFrame:
        """Verified links (a, b) between fingerprints that leave every pair at or above the threshold connected."""
        postings = self.docs.select("text").where(F.col("text").isNotNull()).mapInArrow(tidy(_prefixes(self.k, self.num, self.den, self.heavy)), "key long, f long, n long")
        met = stored(postings.repartition(self.parts, "key").sortWithinPartitions("key", "f").mapInArrow(tidy(_meet(self.num, self.den, SMALL)), "key long, a long, b long, n long"))
        small = stored(_ordered(met.where("b is not null")).groupBy("a", "b").agg(F.bit_or(_order()).alias("orders")))
        pairs = self.close(small.where(F.col("orders") == BOTH).select("a", "b"))
        large = met.where("b is null").select("key", F.col("a").alias("f"), "n")
        # 1. Each set under the first of its large groups.
        once = large.groupBy("f").agg(F.min_by(F.struct("key", "n"), "key").alias("at")).select("at.key", "f", "at.n").withColumn("component", F.col("f"))
        linked = self.verified(pairs.union(self.met(self.dealt(once, inside=True), every=False).select("a", "b")))
        if large.isEmpty():
            return linked
        mixed = cut(self.mixed(large, linked))
        # 2. Sets that stand for their components, while a group needs several blocks.
        while (mixed.groupBy("key").count().agg(F.max("count")).first()[0] or 0) > BLOCK_ROWS:
            ends = mixed.groupBy("key", "component").agg(*[of(F.struct("f", "n"), F.xxhash64("f", "key")).alias(name) for name, of in (("x", F.min_by), ("y", F.max_by))])
            few = ends.select("key", "component", F.explode(F.array_distinct(F.array("x", "y"))).alias("set")).select("key", "set.f", "set.n", "component")
            more = self.verified(self.met(self.dealt(few, inside=True), every=False))
            if more.isEmpty():
                break
            linked = linked.union(more)
            mixed = cut(self.mixed(large, linked))
        # 3. What is outside the largest component of a group meets the rest of it: for a forest, then for every pair.
        linked = linked.union(self.verified(self.met(self.dealt(mixed), every=False)))
        far = stored(self.met(self.dealt(self.mixed(large, linked)), every=True))
        if far.isEmpty():
            return linked
        # A pair may meet in a large group under one order and in a small one under the other.
        half = far.where(F.col("orders") != BOTH).join(small.where(F.col("orders") != BOTH).select("a", "b", F.col("orders").alias("other")), ["a", "b"])
        both = far.where(F.col("orders") == BOTH).select("a", "b").union(half.where(F.col("orders").bitwiseOR(F.col("other")) == BOTH).select("a", "b"))
        return linked.union(self.verified(both))

    def mixed(self, large: DataFrame, linked: DataFrame) -> DataFrame:
        """Sets (key, f, n, component) of the large groups that hold more than one component."""
        label = components(linked.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("id", "f")
        labelled = large.join(label, "f", "left").withColumn("component", F.coalesce("component", "f"))
        mixed = labelled.groupBy("key").agg((F.min("component") < F.max("component")).alias("mixed")).where("mixed").drop("mixed")
        return labelled.join(mixed, "key").select("key", "f", "n", "component")

    def dealt(self, rows: DataFrame, inside: bool = False) -> DataFrame:
        """Rows for block pairs of each group: `inside` blocks only, or every block with those outside the group's largest component."""
        block = lambda n: F.pmod(F.xxhash64("f"), n)
        if inside:
            counted = rows.join(rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")), "key").withColumn("mine", block("blocks")).withColumn("other", F.col("mine"))
        else:
            sizes = rows.groupBy("key", "component").count()
            counts = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.max("count").alias("within"), F.sum("count").alias("all"))
            counts = counts.select("key", "largest", F.ceil(F.col("within") / BLOCK_ROWS).alias("within"), F.ceil((F.col("all") - F.col("within")) / BLOCK_ROWS).alias("outside"))
            counted = rows.join(counts, "key")
            counted = counted.withColumn("mine", F.when(F.col("component") == F.col("largest"), block("within")).otherwise(F.col("within") + block("outside")))
            first = F.when(F.col("component") == F.col("largest"), F.col("within")).otherwise(F.lit(0).cast("long"))
            counted = counted.withColumn("other", F.explode(F.sequence(first, F.col("within") + F.col("outside") - 1)))
        return counted.join(self.sets.select("f", "sketch"), "f").select("key", F.greatest("mine", "other").alias("hi"), F.least("mine", "other").alias("lo"), "mine", "f", "n", "component", "sketch")

    def met(self, dealt: DataFrame, every: bool) -> DataFrame:
        """Pairs (a, b, orders) of different components that blocks of large groups give."""
        found = dealt.repartition(self.parts, "key", "hi", "lo").sortWithinPartitions("key", "hi", "lo").mapInArrow(tidy(_blocks(self.num, self.den, every, TILE)), "key long, a long, b long")
        return _ordered(found).groupBy("a", "b").agg(F.bit_or(_order()).alias("orders"))

    def whole(self, wanted: DataFrame) -> DataFrame:
        """(f, tokens) of the sets that `wanted` (f) names, and of some others."""
        k, size = self.k, self.bits
        bits = np.zeros(size // 64, np.int64)
        at = wanted.select(F.pmod("f", F.lit(size)).cast("int").alias("bit"))
        for r in at.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits")).collect():  # at most MOST_FILTER_BITS / 64 rows
            bits[r["at"]] = r["bits"]
        needed = self.spark.sparkContext.broadcast(bits)

        def run(batches):
            seen: set[int] = set()
            for part in _sliced(batches):
                rows = []
                sets = shingle_sets(part.column(0).to_pylist(), k)
                for tokens, f in zip(sets, fingerprints(sets).tolist()):
                    if not len(tokens):
                        continue
                    bit = f % size
                    if f not in seen and (int(needed.value[bit >> 6]) >> (bit & 63)) & 1:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(f)
                        rows.append((f, tokens.tobytes()))
                yield _batch(rows, "f tokens", pa.int64(), pa.binary())

        sets = self.docs.select("text").where(F.col("text").isNotNull()).mapInArrow(tidy(run), "f long, tokens binary")
        return cut_in_place(sets.groupBy("f").agg(F.first("tokens").alias("tokens")))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs of fingerprints, those whose sets reach the threshold; only sets in pairs are fetched, once."""
        num, den = self.num, self.den
        pairs = cut(pairs.select("a", "b").distinct())
        tokens = self.whole(pairs.select(F.explode(F.array("a", "b")).alias("f")))

        def run(batches):
            for batch in batches:
                a, b, ta, tb = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "ta", "tb"))
                keep = []
                for p, q in zip(ta, tb):
                    x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[at] == x).sum())
                    keep.append(den * both >= num * (len(x) + len(y) - both))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

        met = pairs.join(tokens.toDF("a", "ta"), "a").join(tokens.toDF("b", "tb"), "b")
        linked = cut(met.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long"))
        del pairs, tokens, met
        forget(self.spark)
        return linked

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs that their sketches allow."""
        num, den = self.num, self.den
        sized = pairs.join(self.sets.toDF("a", "na", "sa"), "a").join(self.sets.toDF("b", "nb", "sb"), "b")

        def run(batches):
            for batch in batches:
                a, b, na, sa, nb, sb = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "na", "sa", "nb", "sb"))
                # |A xor B| <= (1 - t) / (1 + t) (|A| + |B|) at the threshold.
                odd = np.array([least_difference(x, y) for x, y in zip(sa.to_pylist(), sb.to_pylist())], np.int64)
                keep = pa.array(odd * (den + num) <= (den - num) * (na.to_numpy() + nb.to_numpy()))
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

        return sized.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: sets whose Jaccard similarity is num/den or more are linked.

    component_id is the smallest doc_id reachable, itself included. Null, empty and wordless
    texts have empty sets, linked with nothing; texts of fewer than k words have one shingle, all their
    words. Equal sets are linked. Rows with a null doc_id are described but link nothing and have
    no component; rows that share a doc_id are one vertex with the links of each.
    """
    with batches_of(docs.sparkSession, BATCH):
        join = _Join(docs, k, num, den)
        edges = cut(join.edges())
    named = join.rows.where("f is not null and doc_id is not null")
    doc_of = named.groupBy("f").agg(F.min("doc_id").alias("doc"))
    between = edges.join(doc_of.toDF("a", "src"), "a").join(doc_of.toDF("b", "dst"), "b").select("src", "dst")
    copies = named.join(doc_of, "f").where("doc_id <> doc").select(F.col("doc_id").alias("src"), F.col("doc").alias("dst"))
    found = components(between.union(copies))
    return join.rows.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
