"""Best-fit packing of documents into fixed-length sequences.

Pattern packing by non-negative least squares: patterns of up to three piece lengths that
fill a sequence are enumerated, their repeat counts are fitted to the length histogram,
rounded, and what the histogram keeps is packed best-fit. Only the histogram (at most
`capacity` lengths times `buckets` salts) reaches the driver; pieces are numbered within
(length, salt) by a window and look their place up in a broadcast table of bounded size.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from taxonaut.llm.common import cut, tidy

CAPACITY = 1024
END_ID = 2
BUCKETS = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


class ChunkIds(dict):
    """Ids (little-endian uint32 bytes) of a word after a space, or of a line feed and the word after it."""

    def __init__(self, ranks, pattern: str, limit: int = 200_000):
        super().__init__()
        import tiktoken

        self.limit, self.encoding = limit, tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = ids = self.encode(chunk if chunk[0] == "\n" else " " + chunk)
        return ids

    def encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()


class ByteLevelEncoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file.

    Pieces of such a vocabulary never cross a gap before a word, so texts with single
    gaps are cut at them and each distinct chunk is encoded once, by the tiktoken form of the
    same ranks. Texts with other white space, the text of an added token, or characters beyond Latin (whose
    classes may differ between Unicode versions), go to the tokenizers library whole.
    """

    #: White space but single spaces and line feeds, as UTF-8; below LAST_BYTE all characters are Latin.
    ODD = tuple(x.encode() for x in ("  ", " \n", "\n ", "\n\n", *"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0"))
    LAST_BYTE = 0xC8

    def __init__(self, json_file: str):
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(json_file)
        with open(json_file, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"] for x in spec.get("added_tokens", ())}
        #: The library gives the text of an added token, alone in the text or not, its own id.
        self.odd = (*self.ODD, *(x.encode() for x in sorted(added)))
        self.of_char = _byte_of_char()
        if not set(self.of_char) >= set(ByteLevel.alphabet()):
            raise ValueError("the vocabulary's byte alphabet is unknown")
        ranks = {bytes(self.of_char[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        import public_tokenizers

        self.chunks = ChunkIds(ranks, public_tokenizers.PATTERN)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        raw = text.encode("utf-8", "surrogatepass")
        if text[0].isspace() or text[-1].isspace() or np.frombuffer(raw, np.uint8).max() > self.LAST_BYTE or any(x in raw for x in self.odd):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *rest = text.replace("\n", " \n").split(" ")
        return self.chunks.encode(head) + b"".join(map(self.chunks.__getitem__, rest))


def _byte_of_char() -> dict[str, int]:
    """Printable bytes stand for themselves; the others follow from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoder(json_file: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(json_file)


def pieces(docs: DataFrame, json_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise (doc_id, text) and cut into pieces of at most `capacity` ids; null text counts as empty.

    Every document gets `end_id` last. Only documents longer than `capacity` are cut; the
    first piece takes the remainder. Rows with the same doc_id are packed independently.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(json_file)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                at, piece = 0, 0
                to = n if n <= capacity else (n % capacity or capacity)
                while at < n:
                    out.append((doc_id, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, to, piece = to, to + capacity, piece + 1
            names = [x.split()[0] for x in PIECES.split(", ")]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tidy(run), PIECES)


def patterns(capacity: int, lengths: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none), largest first, that fill `capacity` exactly and use only `lengths`."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    a = np.arange(1, capacity + 1)[:, None]
    b = np.arange(0, capacity + 1)[None, :]
    c = capacity - a - b
    ok = (c >= 0) & (b <= a) & (c <= b) & there[a] & (there[b] | (b == 0)) & (there[np.maximum(c, 0)] | (c == 0))
    i, j = np.nonzero(ok)
    return np.stack([i + 1, j, capacity - i - 1 - j], axis=1)


def fit(rows: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """min |A x - h|^2, x >= 0, by accelerated projected gradients; column p of A counts pattern p's lengths."""
    size = len(histogram)
    h = histogram.astype(float)
    h[0] = 0
    use = (rows > 0).astype(float)

    def forward(x):
        out = np.zeros(size)
        for k in range(3):
            out += np.bincount(rows[:, k], weights=x * use[:, k], minlength=size)
        return out

    def back(r):
        return sum(r[rows[:, k]] * use[:, k] for k in range(3))

    v = np.random.default_rng(0).random(len(rows))
    norm = 1.0
    for _ in range(30):
        v = back(forward(v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - h) / (1.05 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, end rank, first sequence, offset) that place every counted piece.

    A run says: pieces of `length` ranked first..end-1 go, one each, to consecutive
    sequences at `offset`. There are at most three runs a pattern plus those of the residuals,
    whose number depends on `capacity` only.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros(len(left), np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(parts: list[int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for length in parts:
            runs.append((length, used[length], used[length] + times, sequences, offset))
            used[length] += times
            left[length] -= times
            offset += length
        sequences += times

    lengths = np.nonzero(left)[0]
    rows = patterns(capacity, lengths) if len(lengths) else np.zeros((0, 3), np.int64)
    if len(rows):
        x = np.rint(fit(rows, left)).astype(np.int64)
        for p in np.argsort(-x, kind="stable"):
            if x[p] <= 0:
                break
            parts = [int(v) for v in rows[p] if v]
            times = min(int(x[p]), *(left[v] // parts.count(v) for v in parts))
            if times > 0:
                place(parts, int(times))
    while (some := np.nonzero(left)[0]).size:  # each turn uses up a length, so there are at most `capacity`
        parts, room, kept = [], capacity, left.copy()
        while room > 0:
            fitting = np.nonzero(kept[: room + 1])[0]
            if not fitting.size:
                break
            parts.append(int(fitting[-1]))
            kept[fitting[-1]] -= 1
            room -= int(fitting[-1])
        place(parts, int(min(left[v] // parts.count(v) for v in set(parts))))
        del some
    return np.array(runs, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, json_file: str, capacity: int = CAPACITY, end_id: int = END_ID, buckets: int = BUCKETS) -> DataFrame:
    """Pack whole documents; one row per piece with its sequence and its gapless offset.

    Empty tables give no rows. Full pieces are sequences of their own and keep negative
    numbers; the others share sequences 0, 1, ... . Other columns of `docs` are ignored.
    """
    whole = cut(pieces(docs, json_file, capacity, end_id))
    full = whole.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    part = whole.where(F.col("length") < capacity).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = np.zeros((capacity + 1, buckets), np.int64)
    for r in part.groupBy("length", "_salt").count().collect():  # at most capacity * buckets rows
        counts[r["length"], r["_salt"]] = r["count"]
    before = np.cumsum(counts, axis=1) - counts
    runs = plan(counts.sum(axis=1), capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast((before, runs, runs[:, 0] * (1 << 44) + runs[:, 1]))

    def place(batches):
        before, runs, keys = shared.value
        for batch in batches:
            length, salt, rn = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_salt", "_rn"))
            rank = before[length, salt] + rn - 1
            run = runs[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1] if len(length) else runs[:0]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(run[:, 3] + rank - run[:, 1], pa.int64()), pa.array(run[:, 4], pa.int64())],
                names=[x.split()[0] for x in PLACED.split(", ")],
            )

    ranked = part.withColumn("_rn", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")))
    return full.unionByName(ranked.mapInArrow(place, PLACED))
