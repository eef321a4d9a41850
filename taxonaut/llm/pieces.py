"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one a character. An agenda holds the adjacent pairs whose
concatenation is in the vocabulary, best score first and leftmost among equals; the top pair
is merged and its neighbours enter the agenda until none is left. Symbols outside
the vocabulary end as byte pieces. No vocabulary piece holds a gap mark after another
character, so chunks that start at a gap mark are encoded on their own and each distinct chunk
of a worker is encoded once: many short ones together as rows of an array (one agenda step of
every row at a time), long ones with a heap. Every new chunk is checked
against the sentencepiece library before it is used.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

GAP = "▁"
#: Longest chunk, in characters, that is encoded as a row of an array.
ROW = 48
NONE = np.int64(1 << 40)
MARKS = ",.;:!?*$%&#"


class PieceModel:
    """Vocabulary, pair table and chunk cache of one model file."""

    def __init__(self, model_file: str, limit: int = 600_000):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.vocab_size()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.ids = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if len(self.bytes) != 256 or any(sp.is_unused(i) for i in range(size)):
            raise ValueError("only vocabularies with byte pieces and without unused pieces are known here")
        if any(GAP in p.lstrip(GAP) for p in self.ids) or sp.normalize(" a  ﬁ\n") != f"{GAP}{GAP}a{GAP}{GAP}ﬁ\n":
            raise ValueError("chunks are not independent under this vocabulary or normaliser")
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.order = {score: r for r, score in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {i: self.order[sp.get_score(i)] for i in self.ids.values()}
        # Symbols: vocabulary ids, then characters that occur in pieces only, then one for all others.
        self.symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbols.setdefault(c, size + len(self.symbols) - len(self.ids))
        self.other = max(self.symbols.values()) + 1
        self.width = self.other + 1
        table = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    table[a * self.width + b] = i
        self.pairs = table
        self.keys = np.array(sorted(table), np.int64)
        self.merged = np.array([table[k] for k in self.keys.tolist()], np.int64)
        self.ranks = np.array([self.rank[i] for i in self.merged.tolist()], np.int64)
        self.size = size
        self.symbol_of = np.full(0x110000, self.other, np.int32)
        for x, i in self.symbols.items():
            if len(x) == 1:
                self.symbol_of[ord(x)] = i
        text = [b""] * size
        for x, i in self.ids.items():
            text[i] = x.replace(GAP, " ").encode()
        for x, i in self.bytes.items():
            text[i] = bytes([x])
        self.piece_size = np.array([len(x) for x in text], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_data = np.frombuffer(b"".join(text), np.uint8)
        # Two characters that no piece holds side by side never meet in a merge: a chunk may be cut between them.
        joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.joined = joined
        if any("\n" in x for x in self.ids):
            raise ValueError("lines are not independent under this vocabulary")
        self.limit, self.chunks = limit, {}

    def agenda(self, chunk: str) -> list[int]:
        """Ids of one chunk, by a heap of adjacent pairs."""
        text = list(chunk)
        symbol = [self.symbols.get(c, self.other) for c in text]
        before, after = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        alive = [True] * len(text)
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (new := self.pairs.get(symbol[a] * self.width + symbol[b])) is not None:
                heapq.heappush(heap, (self.rank[new], a, b, symbol[a], symbol[b]))

        for k in range(len(text) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, left, right = heapq.heappop(heap)
            if not (alive[a] and alive[b]) or symbol[a] != left or symbol[b] != right or after[a] != b:
                continue
            symbol[a] = self.pairs[left * self.width + right]
            alive[b] = False
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out: list[int] = []
        for k, s in enumerate(symbol):
            if alive[k]:
                out.extend([s] if s < self.size else (self.bytes[x] for x in text[k].encode("utf-8")))
        return out

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such pair) and merged id of pairs of symbols."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], NONE), self.merged[at]

    def agendas(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short chunks, and how many each has; each turn takes the top of every row's agenda."""
        width = max(map(len, chunks))
        symbol = np.full((len(chunks), width), -1, np.int64)
        joined = self.symbol_of[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbol[np.arange(width)[None] < size[:, None]] = joined
        origin = np.broadcast_to(np.arange(width), symbol.shape).copy()
        rank, new = self._lookup(symbol[:, :-1], symbol[:, 1:])
        done, done_at = symbol.copy(), origin.copy()
        rows = np.arange(len(chunks))
        columns = np.arange(width)[None]
        while width > 1 and len(rows):
            best = rank.argmin(axis=1)
            line = np.arange(len(rows))
            live = rank[line, best] < NONE
            if not live.all():
                done[rows[~live]], done_at[rows[~live]] = symbol[~live], origin[~live]
                rows, symbol, origin, rank, new, best = rows[live], symbol[live], origin[live], rank[live], new[live], best[live]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            symbol[line, best] = new[line, best]
            shift = np.minimum(columns + (columns > best[:, None]), width - 1)
            last = columns == width - 1
            symbol = np.where(last, -1, np.take_along_axis(symbol, shift, 1))
            origin = np.take_along_axis(origin, shift, 1)
            shift = np.minimum(columns[:, :-1] + (columns[:, :-1] > best[:, None]), width - 2)
            rank = np.where(last[:, 1:], NONE, np.take_along_axis(rank, shift, 1)) if width > 2 else np.full_like(rank, NONE)
            new = np.take_along_axis(new, shift, 1)
            for at in (best - 1, best):
                fine = (at >= 0) & (at < width - 1)
                r, m = self._lookup(symbol[line[fine], at[fine]], symbol[line[fine], at[fine] + 1])
                rank[line[fine], at[fine]], new[line[fine], at[fine]] = r, m
        done[rows], done_at[rows] = symbol, origin
        return self._flat(done, done_at, chunks)

    def _flat(self, symbol: np.ndarray, at: np.ndarray, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and how many each row has; unknown symbols become byte pieces."""
        there = symbol >= 0
        flat = symbol[there]
        row = np.nonzero(there)[0]
        unknown = np.nonzero(flat >= self.size)[0]
        if len(unknown):
            place = at[there]
            coded = [[self.bytes[x] for x in chunks[row[k]][place[k]].encode("utf-8")] for k in unknown]
            times = np.ones(len(flat), np.int64)
            times[unknown] = [len(x) for x in coded]
            starts = np.cumsum(times) - times
            flat, row = np.repeat(flat, times), np.repeat(row, times)
            for k, ids in zip(starts[unknown], coded):
                flat[k : k + len(ids)] = ids
        return flat, np.bincount(row, minlength=len(chunks))

    def learn(self, parts: set[str]) -> None:
        """Encode chunks not met before; raise if the library differs."""
        if len(self.chunks) + len(parts) > self.limit:
            self.chunks.clear()
        stems: set[str] = set()
        whole: list[tuple[str, str, str]] = []
        for part in parts:
            if part not in self.chunks:
                chunk = part if part[:1] == "\n" else GAP + part
                stem = chunk.rstrip(MARKS)
                if len(stem) == len(chunk) or not stem or stem[-1] + chunk[len(stem)] in self.joined:
                    stem = chunk
                tail = chunk[len(stem) :]
                whole.append((part, stem, tail))
                stems.add(stem)
                if tail:
                    stems.add(tail)
        ids = self.encode(sorted(stems, key=len))
        for part, stem, tail in whole:
            self.chunks[part] = ids[stem] + ids[tail] if tail else ids[stem]

    def encode(self, chunks: list[str], step: int = 20_000) -> dict[str, bytes]:
        """Ids of distinct chunks, shortest first, by their agendas and as the library has them."""
        out: dict[str, bytes] = {}
        short = [x for x in chunks if len(x) < ROW]
        for k in range(0, len(short), step):
            some = short[k : k + step]
            flat, count = self.agendas(some)
            self.check(some, flat, count)
            data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
            for x, a, b in zip(some, [0, *ends], ends):
                out[x] = data[a:b]
        for x in chunks[len(short) :]:
            ids = np.array(self.agenda(x), "<u4")
            self.check([x], ids, np.array([len(ids)]))
            out[x] = ids.tobytes()
        return out

    def check(self, chunks: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        """Compare with the sentencepiece library: chunks that start at a gap mark as one text, the others as one of lines."""
        starts = np.fromiter((x[0] == GAP and x.strip(GAP) != "" for x in chunks), bool, len(chunks))
        line = self.bytes[10]
        rest = np.insert(flat[np.repeat(~starts, count)], np.cumsum(count[~starts]) - count[~starts], line)
        for own, text in (
            (flat[np.repeat(starts, count)], "".join([x for x, s in zip(chunks, starts) if s])[1:]),
            (rest, "".join(["\n" + x for x, s in zip(chunks, starts) if not s])),
        ):
            expected = self.library.encode(text, num_threads=1)
            if not np.array_equal(own, expected[1:] if text[:1] == "\n" else expected):
                raise ValueError("ids differ from the sentencepiece library's")

    def decode(self, ids: np.ndarray, ends: list[int]) -> list[bytes]:
        """UTF-8 texts of runs of ids that end at `ends`; begin and end ids have no text, the first gap of a run is dropped."""
        size = self.piece_size[ids]
        total = np.cumsum(size)
        data = self.piece_data[np.arange(total[-1] if len(total) else 0) + np.repeat(self.piece_at[ids] - (total - size), size)].tobytes()
        at = [0, *(int(total[e - 1]) for e in ends)]
        return [data[a + 1 : b] for a, b in zip(at, at[1:])]

    PART = re.compile(f"\n[^{GAP}\n]*|{GAP}+[^{GAP}\n]*")

    def parts(self, text: str) -> list[str]:
        """Chunks of a text: a line feed and what follows it, or a gap mark (left out here) and what follows it."""
        if not text:
            return []
        if "  " not in text and " \n" not in text and GAP not in text and text[0] not in " \n" and text[-1] != " ":
            return text.replace("\n", " \n").split(" ")
        return [x[1:] if x[0] == GAP else x for x in self.PART.findall(GAP + text.replace(" ", GAP))]

    def run(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian uint32, decoded UTF-8) of whole texts."""
        cut = [self.parts(x) for x in texts]
        begin, end = np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()
        out: list[tuple[bytes, bytes]] = []
        k = 0
        while k < len(cut):  # as many texts at a time as the cache takes
            to, fresh = k, set()
            while to < len(cut) and (to == k or len(fresh) < self.limit // 3):
                fresh.update(cut[to])
                to += 1
            self.learn(fresh)
            coded = [b"".join([begin, *[self.chunks[p] for p in parts], end]) for parts in cut[k:to]]
            ends = np.cumsum([len(x) // 4 for x in coded]).tolist()
            decoded = self.decode(np.frombuffer(b"".join(coded), "<u4"), ends)
            for ids, own in zip(coded, decoded):
                if self.library.decode(np.frombuffer(ids, "<u4").tolist()).encode("utf-8", "surrogatepass") != own:
                    raise ValueError("a decoded text differs from the sentencepiece library's")
            out.extend(zip(coded, decoded))
            k = to
        return out


@lru_cache(maxsize=2)
def model(model_file: str) -> PieceModel:
    return PieceModel(model_file)


def encode_and_decode(docs: DataFrame, model_file: str, keep_ids: bool = False) -> DataFrame:
    """Encode each (doc_id, text) with begin and end ids and decode the ids again.

    Null and empty texts give the two marks and an empty decoded text. Repeated rows each
    give a row; other columns are ignored. Returns doc_id, n_tokens, ids_sha256 and
    decoded_sha256, and with `keep_ids` also ids (array<int>) and decoded (string).
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]

    def run(batches):
        pieces = model(model_file)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                found = pieces.run([x or "" for x in part.column(1).to_pylist()])
                columns = [part.column(0), [len(a) // 4 for a, _ in found], [hashlib.sha256(a).hexdigest() for a, _ in found], [hashlib.sha256(b).hexdigest() for _, b in found]]
                if keep_ids:
                    columns += [[np.frombuffer(a, "<u4").astype(np.int32) for a, _ in found], [b.decode("utf-8", "replace") for _, b in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c for c, t in zip(columns, types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)
