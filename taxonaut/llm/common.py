"""What the operators share: lineage cuts, word splitting and connected components."""

from __future__ import annotations

import contextlib
import functools
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value of the contracts: words are runs of bytes outside \x20 and \x09-\x0D.
WORD_GAPS = " \t\n\v\f\r"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, from spark.checkpoint.dir.

    Where the session has none, only a local master gets a temporary one; a cluster has to name one.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and drop the lineage.

    Lost executors re-read the files instead of re-running the plan.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def cut_in_place(df: DataFrame) -> DataFrame:
    """cut(), whose result is still known to be dealt by its key (adaptive plans forget that), so that it is not dealt again."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.select("*"))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def tidy(run):
    """A function over batches that gives back what its worker no longer needs when it ends: Spark reuses workers, and allocators keep pages."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what runs inside: rows with whole sets of shingles are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: smaller than cut() where there are many, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a filter of keys, eight a key up to this (4 MB); its false positives only cost work.
MOST_FILTER_BITS = 1 << 25


def split_by_filter(rows: DataFrame, on: list[str], keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """`rows` that may have a partner in `keys` (few: a bit of their hash is set), and those that surely have none.

    The filter is broadcast as words of 64 bits; its size is bounded, and with too many keys for it more rows are taken for partners.
    """
    size = min(MOST_FILTER_BITS, 1 << (8 * max(1024, keys.count()) - 1).bit_length())

    def bit(names):
        return F.pmod(F.xxhash64(*names), F.lit(size))

    one = F.expr("shiftleft(1L, cast(__bit & 63 as int))")
    words = keys.select(bit(key).alias("__bit")).groupBy(F.shiftright("__bit", 6).alias("__at")).agg(F.bit_or(one).alias("__word"))
    flagged = rows.withColumn("__bit", bit(on)).join(F.broadcast(words), F.shiftright("__bit", 6) == F.col("__at"), "left")
    there = F.coalesce(F.col("__word").bitwiseAND(one) != 0, F.lit(False))
    return tuple(flagged.where(x).drop("__bit", "__at", "__word") for x in (there, ~there))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """UTF-8 words of a text; bytes.split() and bytes.lower() know exactly the ASCII gaps and letters."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, for hash orders that are independent of one another."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_GAP = np.zeros(256, bool)
_GAP[list(WORD_GAPS.encode())] = True
#: ASCII capitals as small letters.
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32
#: A random 64-bit value for each byte at each of the first places of a word; those of later places are worked out.
PLACES = 64
_PLACED = mix64(np.arange(PLACES * 256, dtype=np.uint64), 101)


def hash_words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the number of words in each text.

    A word's hash adds up mixed values of its bytes with their places, and is mixed with its length: no family of words
    collides by construction, as polynomials modulo 2**64 do on words of Thue and Morse, and N different words
    hold an equal pair with a chance of N**2 / 2**65. Null texts have no words.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]) + b" ", np.uint8)
    gap = _GAP[data]
    edge = np.nonzero(gap[1:] != gap[:-1])[0] + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    length = end - start
    first = np.cumsum(length) - length  # of each word among the bytes of words
    code = data[~gap].astype(np.int64)
    if lower:
        code = _FOLD[code]
    place = np.arange(len(code)) - np.repeat(first, length)
    code += place << 8
    if len(code) and int(length.max()) > PLACES:
        later = place >= PLACES
        value = _PLACED[np.where(later, 0, code)]
        value[later] = mix64(code[later].astype(np.uint64), 101)
    else:
        value = _PLACED[code]
    with np.errstate(over="ignore"):
        hashes = mix64(np.add.reduceat(value, first) + length.astype(np.uint64), 103) if len(first) else np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    upto = np.searchsorted(start, ends)
    return hashes, np.diff(np.concatenate([[0], upto]))


def held_out(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus = 1; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == 1, F.lit(False))


def forget(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files (and with cleanCheckpoints the checkpoints) of frames that nothing refers to any more.

    It does so when the driver's garbage is collected, which a loop of small jobs on a large cluster may never bring about.
    """
    gc.collect()  # frames in reference cycles hold their plans in the JVM
    spark.sparkContext._jvm.System.gc()


#: Edges that a task of components() takes.
EDGES_A_TASK = 200_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (src long, dst long): (id, component), component the smallest id.

    Alternates large-star and small-star steps; every step is one or two aggregations
    with map-side combination, its result is cut, and the loop ends when a step changes
    nothing. Isolated vertices do not appear. Only two numbers a round reach the driver.
    """
    edges = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    seen, count = None, edges.count()
    for _ in range(rounds):
        # Few edges need few tasks, and so few files, whatever the number of shuffle partitions.
        edges = edges.coalesce(max(1, -(-count // EDGES_A_TASK)))
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        small_low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(small_low, "src")
        edges = cut(small.select("src", F.col("low").alias("dst")).union(small.where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))).where("src <> dst").distinct().coalesce(max(1, -(-2 * count // EDGES_A_TASK))))
        forget(edges.sparkSession)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen, count = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(edges.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
