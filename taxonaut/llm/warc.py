"""WARC archives: writing, reading and revisit resolution.

Headers alone are shuffled by payload digest; the record with the largest id answers for
a digest and the others become revisit records that refer to it. Archives are written
with fresh headers by Spark's text writer (records are text with explicit separators, so every
store that Spark reaches works and its commit protocol covers lost executors) and read back
as whole files of bounded size, each record cut by its Content-Length.
"""

from __future__ import annotations

import gzip
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taxonaut.llm.common import shared_folder

# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Date of all records: archives of the same pages are the same bytes.
DATE = "1970-01-01T00:00:00Z"
#: Payload bytes of an archive file at most, but for a larger record alone; one record is never split.
ARCHIVE_BYTES = 128 << 20
#: Records of up to this many payload bytes share archives; larger ones are filed by size, four times wider each time.
SMALL_BYTES = 24 << 10


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 8 groups of 20 bits, 4 characters each."""
    digest = F.sha1(payload)
    letters = F.array(*[F.lit(c) for c in BASE32])
    out = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.element_at(letters, F.shiftright(bits, shift).bitwiseAND(31) + 1) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def resolve_revisits(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """(page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to.

    Null html is an empty payload. Among records with equal payloads of `at_least` bytes or more,
    those with the largest page_id are responses, the others revisits of it; smaller
    payloads are always responses. Rows with a null page_id are responses; repeated rows are
    alike. Only digests and ids are shuffled to find the answers; the join of revisits to the pages shuffles
    pages once, unless Spark sees that the revisits are few enough to broadcast.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    headed = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumns({"payload_bytes": F.length(payload).cast("long"), "payload_digest": base32_sha1(payload)})
    headers = headed.where(F.col("payload_bytes") >= at_least).select("page_id", "payload_digest")
    answers = headers.groupBy("payload_digest").agg(F.max("page_id").alias("answer"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = headers.join(answers, "payload_digest").where("page_id < answer").groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).agg(F.max("answer").alias("refers_to"))
    joined = headed.join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.drop("_page", "_digest").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def record(resolved: DataFrame) -> Column:
    """One record as text, without the two line ends after its block: fresh headers, and the payload of responses only."""

    def urn(page_id: Column) -> Column:
        name = F.sha1(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
        parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-5"), parts[2], F.lit("-8"), parts[3], F.lit("-"), parts[4], F.lit(">"))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    revisit = resolved["record_type"] == "revisit"
    size = F.when(revisit, F.lit(0)).otherwise(resolved["payload_bytes"])
    # A line end in a URL would start another header.
    uri = F.regexp_replace(F.coalesce(resolved["url"], F.lit("urn:unknown")), "[\\r\\n]+", "%0A")
    return F.concat(
        F.lit(VERSION + CRLF),
        header("WARC-Type", resolved["record_type"]),
        header("WARC-Record-ID", urn(resolved["page_id"])),
        header("WARC-Date", F.lit(DATE)),
        header("WARC-Target-URI", uri),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), resolved["payload_digest"])),
        F.when(revisit, F.concat(header("WARC-Profile", F.lit(REVISIT_PROFILE)), header("WARC-Refers-To", urn(resolved["refers_to"])), header("X-Refers-To-Page", resolved["refers_to"].cast("string")))).otherwise(F.lit("")),
        header("X-Payload-Bytes", resolved["payload_bytes"].cast("string")),
        F.when(resolved["page_id"].isNull(), F.lit("")).otherwise(header("X-Page", F.coalesce(resolved["page_id"].cast("string"), F.lit("")))),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", size.cast("string")),
        F.lit(CRLF),
        F.when(revisit, F.lit("")).otherwise(resolved["html"]),
    )


def size_class(payload_bytes: Column) -> Column:
    """0 up to SMALL_BYTES, then one more for each four times that."""
    return F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(payload_bytes, F.lit(1)) / SMALL_BYTES) - 1e-9)).cast("int")


def records_of(size: int) -> int:
    """Records an archive of size class `size` may hold: at ARCHIVE_BYTES of payload at most."""
    return max(1, ARCHIVE_BYTES // (SMALL_BYTES * 4**size))


def write(resolved: DataFrame, path: str, archive_records: int, compression: str = "gzip") -> None:
    """Write an archive a partition, or more where it has over `archive_records` records."""
    resolved.select(record(resolved).alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", archive_records).option("compression", compression).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under `path`, headers as a map and the block as binary, in no order.

    Raises on a record that is cut short or not followed by two line ends.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = memoryview(content.as_buffer())
                text, at, rows = bytes(data), 0, []
                if text[:2] == b"\x1f\x8b":
                    text = gzip.decompress(text)
                while at < len(text):
                    top = text.index(b"\r\n\r\n", at)
                    lines = text[at:top].decode("utf-8").split(CRLF)
                    if not lines[0].startswith("WARC/"):
                        raise ValueError("not a WARC record")
                    headers = dict(x.split(": ", 1) for x in lines[1:])
                    end = top + 4 + int(headers["Content-Length"])
                    if text[end : end + 4] != b"\r\n\r\n":
                        raise ValueError("a record has no end")
                    rows.append((headers, text[top + 4 : end]))
                    at = end + 4
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(run, "headers map<string,string>, block binary")


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in rows], pa.binary())], names=["headers", "block"])


def archive(pages: DataFrame, at_least: int = 0, path: str | None = None) -> DataFrame:
    """Write `pages` as deduplicated archives and read them back: one row per record.

    Columns page_id, payload_bytes, payload_digest, record_type, refers_to. The archives go to
    `path`, or to a new folder in the shared checkpoint folder, in a folder for each size class: equal payloads are
    of one class, and a bound on records bounds the bytes of a file. An empty table gives no rows.
    Digests of responses are worked out again from the blocks that were read.
    """
    spark = pages.sparkSession
    if path is None:
        path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    sizes = size_class(F.octet_length(F.coalesce(F.col("html"), F.lit(""))))
    # One small number for each fourfold size that there is; an empty table still writes an empty archive.
    for size in sorted(r[0] for r in pages.select(sizes).distinct().collect()) or [0]:
        write(resolve_revisits(pages.where(sizes == size), at_least), f"{path}/size={size}", records_of(size))
    got = read(spark, path)
    of = F.col("headers")
    response = of["WARC-Type"] == "response"
    return got.select(
        of["X-Page"].cast("long").alias("page_id"),
        F.when(response, F.length("block").cast("long")).otherwise(of["X-Payload-Bytes"].cast("long")).alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("block"))).otherwise(F.substring(of["WARC-Payload-Digest"], 6, 32)).alias("payload_digest"),
        of["WARC-Type"].alias("record_type"),
        of["X-Refers-To-Page"].cast("long").alias("refers_to"),
    )
