"""JSON files of one array or one object, read by many tasks.

The text source cuts a file at closing braces, so a large file is split into byte ranges as any text is. Whether a range begins inside
a string, and at which depth, is not known to it. A first scan gives for each range its quotes and, for either beginning, how much deeper
it ends; running sums over the ranges then tell where each one begins. A second scan cuts the items: one ends where a brace
closes at depth 1. What a range holds of an item that began in an earlier one, or goes on in a later one, is put
together again; items in between are parsed where they are. Each is parsed by itself, so a bad one spoils no other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ESCAPED = re.compile(r"\\.", re.S)
#: Brackets, and strings with their closing quote where the text has it.
MARKS = re.compile(r'[{}\[\]]|"(?:[^"\\]|\\.)*("?)', re.S)
STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
RANGES = "file string, block long, quotes long, outside long, inside long"
PIECES = "file string, block long, seq long, text string, closed boolean"


def _texts(batches) -> Iterator[tuple[str, int, str]]:
    """(file, block, text) of neighbouring pieces, each with its brace again."""
    for batch in batches:
        pieces, files, blocks = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        while at < len(pieces):
            end = at
            while end < len(pieces) and files[end] == files[at] and blocks[end] == blocks[at]:
                end += 1
            yield files[at], blocks[at], "}".join(pieces[at:end]) + "}"
            at = end


def _deeper(segments: list[str]) -> int:
    return sum(s.count("{") + s.count("[") - s.count("}") - s.count("]") for s in segments)


def _measure(batches):
    """One row a range: quotes, and the change of depth if it begins outside or inside of a string."""
    found: dict[tuple[str, int], list[int]] = {}
    for file, block, text in _texts(batches):
        parts = ESCAPED.sub("", text).split('"')
        even, odd = _deeper(parts[0::2]), _deeper(parts[1::2])
        own = found.setdefault((file, block), [0, 0, 0])
        swapped = own[0] % 2
        own[1] += odd if swapped else even
        own[2] += even if swapped else odd
        own[0] += len(parts) - 1
    rows = [(*key, *own) for key, own in found.items()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "block", "quotes", "outside", "inside"])


class _Cutter:
    """Pieces of one range: each ends where a brace closes at depth 1, the last one where the range ends."""

    def __init__(self, file: str, block: int, inside: bool, depth: int):
        self.file, self.block, self.inside, self.depth = file, block, inside, depth
        self.held: list[str] = []
        self.seq = 0

    def _row(self, closed: bool) -> tuple:
        row = (self.file, self.block, self.seq, "".join(self.held), closed)
        self.held, self.seq = [], self.seq + 1
        return row

    def cut(self, text: str) -> Iterator[tuple]:
        begin = at = 0
        if self.inside:
            end = STRING_END.match(text)
            if not end:
                self.held.append(text)
                return
            at, self.inside = end.end(), False
        for mark in MARKS.finditer(text, at):
            sign = text[mark.start()]
            if sign in "{[":
                self.depth += 1
            elif sign == '"':
                self.inside = not mark[1]
            else:
                self.depth -= 1
                if sign == "}" and self.depth == 1:
                    self.held.append(text[begin : mark.end()])
                    begin = mark.end()
                    yield self._row(True)
        self.held.append(text[begin:])

    def end(self) -> tuple:
        return self._row(False)


def _pieces(states: dict[tuple[str, int], tuple[bool, int]]):
    def run(batches):
        cutter, rows = None, []

        def batch():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "block", "seq", "text", "closed"])

        for file, block, text in _texts(batches):
            if cutter is None or (cutter.file, cutter.block) != (file, block):
                if cutter is not None:
                    rows.append(cutter.end())
                cutter = _Cutter(file, block, *states[file, block])
            rows += cutter.cut(text)
            if len(rows) >= 1000:
                yield batch()
                rows = []
        if cutter is not None:
            rows.append(cutter.end())
        if rows:
            yield batch()

    return run


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, text, closed): the text of the files up to the end of each object at depth 1, in the order of block and seq, with what stands before it; then, not closed, the rest of each file."""
    text = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    ranges = text.mapInArrow(_measure, RANGES).orderBy("file", "block").collect()  # a row a byte range
    states, file, inside, depth = {}, None, False, 0
    for r in ranges:
        if r["file"] != file:
            file, inside, depth = r["file"], False, 0
        states[r["file"], r["block"]] = (inside, depth)
        depth += r["inside"] if inside else r["outside"]
        inside ^= bool(r["quotes"] % 2)
    cut = text.mapInArrow(_pieces(states), PIECES)
    whole = F.col("closed") & (F.col("seq") > 0)
    # The first and the last piece of each range, put together up to one that is closed.
    before = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)
    broken = cut.where(~whole).withColumn("_item", F.coalesce(F.sum(F.col("closed").cast("int")).over(before), F.lit(0)))
    joined = broken.groupBy("file", "_item").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "text", "closed"))).alias("parts"))
    last = F.element_at("parts", -1)
    stitched = joined.select("file", last["block"].alias("block"), last["seq"].alias("seq"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), last["closed"].alias("closed"))
    return cut.where(whole).union(stitched)


def _bare(opening: str, closing: str) -> Column:
    """The items of a piece without the comma or bracket before them and, at the end of a file, without its closing bracket and the brace that the text source lacks there."""
    head = F.regexp_replace("text", rf"^[\x{{feff}}\s]*(?:{opening}|,)?\s*", "")
    return F.when(F.col("closed"), head).otherwise(F.regexp_replace(head, rf"\s*{closing}\s*\}}?\s*$", ""))


def _numbered(rows: DataFrame) -> DataFrame:
    """row_no of exploded items (file, block, seq, pos): places within a range, on top of the items of the ranges before."""
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("seq", "pos")) - 1
    starts = sizes.select(F.col("file").alias("_file"), F.col("block").alias("_block"), base.alias("_base"))
    met = rows.withColumn("_place", place).join(starts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return met.withColumn("row_no", F.col("_base") + F.col("_place"))


def items(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, item, bad) of files that hold a JSON array: each item as VARIANT in file order, or, with a null item, the text that is no JSON in bad.

    Items that are no objects are parsed together with the next object. An array without items and an empty file give no rows.
    """
    inner = pieces(spark, path).select("file", "block", "seq", _bare(r"\[", r"\]").alias("text")).where("trim(text) <> ''")
    parsed = inner.withColumn("all", F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]"))).cast("array<variant>"))
    good = parsed.where("all is not null").select("file", "block", "seq", F.posexplode("all").alias("pos", "item"), F.lit(None).cast("string").alias("bad"))
    bad = parsed.where("all is null").select("file", "block", "seq", F.lit(0).alias("pos"), F.lit(None).cast("variant").alias("item"), F.col("text").alias("bad"))
    return _numbered(good.union(bad)).select("file", "row_no", "item", "bad")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, key, value, bad) of files that hold a JSON object: its entries in file order, texts as they are and other values as JSON, or what is no JSON in bad.

    A repeated key gives an entry each time, but for neighbours that are no objects. Entries whose values are no objects are
    parsed together with the next one that is.
    """
    inner = pieces(spark, path).select("file", "block", "seq", _bare(r"\{", r"\}").alias("text")).where("trim(text) <> ''")
    parsed = inner.withColumn("all", F.map_entries(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,string>")))
    good = parsed.where("all is not null").select("file", "block", "seq", F.posexplode("all").alias("pos", "e"), F.lit(None).cast("string").alias("bad")).select("file", "block", "seq", "pos", "e.key", "e.value", "bad")
    bad = parsed.where("all is null").select("file", "block", "seq", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.col("text").alias("bad"))
    return _numbered(good.union(bad)).select("file", "row_no", "key", "value", "bad")
