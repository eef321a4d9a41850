"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

The base kinds (assign, access, hex) are exact patterns. The method adds spans of kind
`novel`: long identifier-like strings near a sensitive word are candidates; each is priced
by the bytes that a zstandard frame grows when the candidate follows its surrounding text,
the compressor being primed with a dictionary of common code and identifiers. What stays
incompressible there (many marginal bytes a character) is reported.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from taxonaut.llm.common import tidy

# Fixed values of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make a context sensitive, and how far from a candidate's start they may end.
SENSITIVE = re.compile(r"password|passwd|secret|token|api_?key|credential|private|bearer|auth|access", re.I | re.A)
REACH = 48
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Marginal bytes a character from which a candidate counts as novel; random hexadecimal costs about 0.5, base64 0.75.
NOVELTY = 0.5

#: Identifiers and phrases of code that prime the compressor.
DICTIONARY = " ".join(
    """const let var function return import from export default class public private protected static final void int long
    string boolean float double null true false if else for while switch case break continue try catch finally throw new
    this self def lambda yield async await with assert raise except global nonlocal pass print len range enumerate
    password = " passwd = ' secret: token = " api_key = " apikey: access_token client_secret Authorization: Bearer
    configuration settings environment production development localhost https://www.example.com/index.html
    username user_id session_id created_at updated_at database connection request response header content-type
    application/json charset=utf-8 getElementById addEventListener querySelector toString valueOf hasOwnProperty
    abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 ffffffff xxxxxxxxxxxxxxxx your_token_here
    changeme example placeholder CamelCaseIdentifier snake_case_identifier kebab-case-identifier""".split()
).encode()


class Novelty:
    """Marginal compressed bytes of a string after its surroundings."""

    def __init__(self, dictionary: bytes = DICTIONARY, level: int = 3):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False)

    def bytes_of(self, before: str, candidate: str, after: str) -> int:
        around = (before + after).encode("utf-8", "replace")
        return len(self.compressor.compress(around + candidate.encode())) - len(self.compressor.compress(around))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, code points, by start and then kind."""
    found = []
    low = text.lower() if any(x in text for x in "=:") else ""
    if "password" in low or "passwd" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, novelty: Novelty, threshold: float = NOVELTY) -> list[tuple[int, int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if not SENSITIVE.search(text, max(0, start - REACH), start):
            continue
        candidate = m.group()
        if not any(c.isdigit() for c in candidate) or len(set(candidate)) < 8:
            continue
        marginal = novelty.bytes_of(text[max(0, start - 256) : start], candidate, text[end : end + 256])
        if marginal >= threshold * len(candidate):
            found.append((start, 3, end))
    return found


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, threshold: float = NOVELTY) -> DataFrame:
    """Spans of every whole (doc_id, text): counts of the base kinds, a digest of them, and all spans.

    Null and empty texts have no spans (the digest is that of an empty string). Positions are
    code points, ends exclusive. Repeated rows each give a row; other columns are ignored.
    """

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                count = [sum(k == n for _, k, _ in base) for n in range(3)]
                spans = sorted(base + novel_spans(text, novelty, threshold))
                rows.append((doc_id, *count, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[REDACTED]", threshold: float = NOVELTY) -> DataFrame:
    """`docs` with the text of every span replaced by `mark` (overlapping spans by one); n_chars follows the text."""

    names = docs.columns

    def run(batches):
        novelty = Novelty()
        for whole in batches:
            for k in range(0, max(1, whole.num_rows), 200):
                batch = whole.slice(k, 200)
                texts = [t if t is None else _without(t, sorted(base_spans(t) + novel_spans(t, novelty, threshold)), mark) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    return docs.mapInArrow(tidy(run), docs.schema).withColumn("n_chars", F.length("text").cast("long"))


def _without(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
