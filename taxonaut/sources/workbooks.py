"""Workbooks (.xlsx): cells and merged ranges as rows, tables with a header row, and the two layouts of grading standards.

Files are read by Spark's binary source, so any store that Spark reaches will do; a task unzips its workbook and goes through the sheets'
XML as a stream of events, in batches. Merged ranges are joined to the cells they show (operators.standards.merged_grid).
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taxonaut.functions import text
from taxonaut.operators.standards import PLACEHOLDERS, merged_grid
from taxonaut.sources.readers import read_csv
from taxonaut.sources.writers import stored

# Namespaces of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BATCH = 10_000
PARTS = "file string, sheet string, row int, col int, last_row int, last_col int, value string"
KEY = ("file", "sheet")


def column_number(letters: str) -> int:
    """1 for A, 27 for AA."""
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def column_letters(number: Column) -> Column:
    """A for 1, AA for 27, up to the three letters that sheets have."""
    one = lambda x: F.char(65 + F.pmod(x, F.lit(26)))
    n = number - 1
    two = F.floor(n / 26) - 1
    three = F.floor(two / 26) - 1
    return F.concat(F.when(two >= 26, one(three)).otherwise(""), F.when(n >= 26, one(two)).otherwise(""), one(n))


def _place(name: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", name).groups()
    return int(row), column_number(letters)


def _plain(node: ElementTree.Element) -> str:
    """The text of a string item: its own or that of its runs, without reading aids."""
    return "".join(t.text or "" for part in node if part.tag in (f"{MAIN}t", f"{MAIN}r") for t in ([part] if part.tag == f"{MAIN}t" else part.findall(f"{MAIN}t")))


def _shared(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    out = []
    with archive.open("xl/sharedStrings.xml") as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag == f"{MAIN}si":
                out.append(_plain(node))
                node.clear()
    return out


def _sheets(archive: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(name, member) in the order of the workbook."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = links[sheet.get(LINK)]
        yield sheet.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    """A cell's cached value as text: whole numbers without a point, others as Python writes them, True and False."""
    kind, raw = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        node = cell.find(f"{MAIN}is")
        return None if node is None else _plain(node)
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return str(raw.strip() == "1")
    if kind == "n":
        return repr(float(raw)) if re.search("[.eE]", raw) else str(int(raw))
    return raw


def parts_of(content: bytes) -> Iterator[tuple[str, int, int, int | None, int | None, str | None]]:
    """(sheet, row, col, last_row, last_col, value): cells with a value, and merged ranges, which have an end and no value."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = _shared(archive)
        for name, member in _sheets(archive):
            row = col = 0
            with archive.open(member) as stream:
                for event, node in ElementTree.iterparse(stream, ("start", "end")):
                    if event == "start":
                        if node.tag == f"{MAIN}row":
                            row, col = int(node.get("r") or row + 1), 0
                        continue
                    if node.tag == f"{MAIN}c":
                        row, col = _place(node.get("r")) if node.get("r") else (row, col + 1)
                        if (value := _value(node, shared)) is not None:
                            yield name, row, col, None, None, value
                    elif node.tag == f"{MAIN}mergeCell":
                        first, _, last = node.get("ref").partition(":")
                        yield (name, *_place(first), *_place(last or first), None)
                    if node.tag in (f"{MAIN}row", f"{MAIN}mergeCell"):
                        node.clear()


def read_workbook(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cells (file, sheet, row, col, value) and merged ranges (file, sheet, r1, c1, r2, c2) of the workbooks under a path, from 1.

    Each file is parsed once. Values are the cached ones, as text; dates are the numbers that the file holds.
    Cells without a value do not appear. A file that is no workbook raises.
    """

    def parse(batches):
        names = ["file", "sheet", "row", "col", "last_row", "last_col", "value"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for part in parts_of(content.as_py()):
                    rows.append((file, *part))
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    parts = stored(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, PARTS))
    ranges = parts.where("last_row is not null").select(*KEY, F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("last_row").alias("r2"), F.col("last_col").alias("c2"))
    return parts.where("last_row is null").select(*KEY, "row", "col", "value"), ranges


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The sheet of a workbook, its first by default, as a table: names from row 1, trimmed, all columns text, with row_no from 0.

    Columns without a name and rows without a value do not appear; names that are then the same raise.
    """
    cells, _ = read_workbook(spark, path)
    content = spark.read.format("binaryFile").load(path).select("content").limit(2).collect() if sheet is None else None
    if content is not None:
        if len(content) != 1:
            raise ValueError(f"{path} is not one file")
        with zipfile.ZipFile(io.BytesIO(content[0]["content"])) as archive:
            sheet = next(_sheets(archive))[0]
    own = cells.where(F.col("sheet") == sheet)
    header = {r["col"]: r["value"].strip() for r in own.where("row = 1").select("col", "value").limit(20_000).collect()}
    header = {c: name for c, name in sorted(header.items()) if name}
    if len(set(header.values())) != len(header):
        raise ValueError("duplicate column names after trimming")
    body = own.where("row > 1").groupBy("file", "row").agg(F.lit(1).alias("_"), *[F.max(F.when(F.col("col") == c, F.col("value"))).alias(f"_c{c}") for c in header])
    return body.select((F.col("row") - 2).alias("row_no"), *[F.col(f"_c{c}").alias(name) for c, name in header.items()])


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """A table of labelled fields from .csv or .xlsx; any other suffix raises."""
    suffix = posixpath.splitext(path)[1].lower()
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix == ".xlsx":
        return read_table(spark, path).drop("row_no")
    raise ValueError(f"unsupported input type {suffix!r}: .csv or .xlsx is needed")


# Sheets of the two standards, and what their columns hold. Data starts in row 3.
FIRST_ROW = 3
FINANCE_SHEET = "Table 1"
FINANCE = {
    "level_1": "B", "level_2": "C", "level_2_definition": "D", "level_3": "E", "level_3_definition": "F",
    "leaf": "G", "description": "H", "raw_level": "I", "remark": "J", "department_opinion": "K",
}
CATALOGUE_SHEET = "数据分类分级"
CATALOGUE = {
    "level_1": "B", "level_1_definition": "C", "level_2": "D", "level_2_definition": "E", "level_3": "F", "level_3_definition": "G",
    "level_4": "H", "level_4_definition": "I", "content": "J", "raw_level": "K", "resource": "L",
}


def layout(cells: DataFrame, ranges: DataFrame, sheet: str, columns: dict[str, str], sources: Sequence[str] = ()) -> DataFrame:
    """Rows of a sheet from FIRST_ROW on: file, sheet, row, the named columns as texts ('' where blank), and provenance of `sources`.

    Every cell of a merged range shows the value of its first one. provenance has for each source its cell, merged range, first and
    last row of that, and whether the value is inherited. White space is cleaned, but only trimmed around raw_level. A
    sheet that no file has raises.
    """
    held, merged = cells.where(F.col("sheet") == sheet), ranges.where(F.col("sheet") == sheet)
    ends = held.select(*KEY, F.col("row").alias("end")).union(merged.select(*KEY, F.col("r2").alias("end"))).groupBy(*KEY).agg(F.max("end").alias("end"))
    if ends.isEmpty():
        raise ValueError(f"no sheet {sheet!r}")
    wanted = [column_number(c) for c in columns.values()]
    rows = ends.where(F.col("end") >= FIRST_ROW).select(*KEY, F.explode(F.sequence(F.lit(FIRST_ROW), F.col("end"))).alias("row"))
    points = rows.select(*KEY, "row", F.explode(F.array(*[F.lit(c) for c in wanted])).alias("col"))
    shown = merged_grid(held, merged, KEY, points)
    name = lambda row, col: F.concat(column_letters(F.col(col)), F.col(row).cast("string"))
    spans = F.when(F.col("start_row").isNotNull(), F.concat(name("anchor_row", "anchor_col"), F.lit(":"), name("end_row", "end_col")))
    source = F.struct(name("anchor_row", "anchor_col").alias("source_cell"), spans.alias("merged_range"), "start_row", "end_row", "inherited")
    cell = shown.select(*KEY, "row", "col", F.struct("value", source.alias("source")).alias("cell"))
    wide = cell.groupBy(*KEY, "row").agg(*[F.max(F.when(F.col("col") == c, F.col("cell"))).alias(f"_{field}") for field, c in zip(columns, wanted)])
    value = lambda field: F.coalesce(text.strip(F.col(f"_{field}.value")), F.lit("")) if field == "raw_level" else text.clean(F.col(f"_{field}.value"))
    provenance = [F.struct(*[F.col(f"_{s}.source").alias(s) for s in sources]).alias("provenance")] if sources else []
    return wide.select(*KEY, "row", *[value(field).alias(field) for field in columns], *provenance)


def finance_standard(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of the financial grading standard that name a leaf, ready for standards.build_entries()."""
    rows = layout(cells, ranges, FINANCE_SHEET, FINANCE, ("level_2_definition", "level_3_definition", "remark", "department_opinion"))
    return rows.where("leaf <> ''")


def grading_catalogue(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of the grading catalogue with leaf, description and issue, ready for standards.build_entries() and build_catalog().

    A blank or dashed fourth level leaves the leaf, and its definition, to the third; issue says so where that is blank, too.
    """
    rows = layout(cells, ranges, CATALOGUE_SHEET, CATALOGUE, ("level_1_definition", "level_2_definition", "level_3_definition", "resource"))
    higher = F.col("level_4").isin("", PLACEHOLDERS[0])
    leaf = F.when(higher, F.col("level_3")).otherwise(F.col("level_4"))
    described = F.when(higher, F.col("level_3_definition")).otherwise(F.col("level_4_definition"))
    return rows.withColumns({"leaf": leaf, "description": described, "issue": F.when(leaf == "", "no real leaf level")})
