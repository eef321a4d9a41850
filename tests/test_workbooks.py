"""Workbooks that the tests write: cells of every kind, merged ranges, tables, both layouts of standards."""

import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from taxonaut.operators import standards
from taxonaut.sources import workbooks

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
SPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def place(row, col):
    letters = ""
    while col:
        col, rest = divmod(col - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def write(path, sheets):
    """sheets: name -> (cells {(row, col): value or raw XML}, merged refs). Texts are shared strings, lists rich ones."""
    strings, parts = [], {}
    for n, (cells, merged) in enumerate(sheets.values(), 1):
        rows = {}
        for (row, col), value in sorted(cells.items()):
            at = place(row, col)
            if isinstance(value, bool):
                cell = f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
            elif isinstance(value, (int, float)):
                cell = f'<c r="{at}"><v>{value!r}</v></c>'
            elif isinstance(value, tuple):
                cell = value[0].replace("AT", at)
            else:
                runs = value if isinstance(value, list) else None
                strings.append("".join(f"<r><t>{escape(x)}</t></r>" for x in runs) + "<rPh><t>aid</t></rPh>" if runs else f'<t xml:space="preserve">{escape(value)}</t>')
                cell = f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'
            rows.setdefault(row, []).append(cell)
        data = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows.items())
        joined = f'<mergeCells>{"".join(f"<mergeCell ref={chr(34)}{m}{chr(34)}/>" for m in merged)}</mergeCells>' if merged else ""
        parts[f"xl/worksheets/sheet{n}.xml"] = f"{HEAD}<worksheet {SPACE}><sheetData>{data}</sheetData>{joined}</worksheet>"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts["xl/workbook.xml"] = f'{HEAD}<workbook {SPACE} xmlns:r="{link}"><sheets>{"".join(f"<sheet name={chr(34)}{escape(s)}{chr(34)} sheetId={chr(34)}{n}{chr(34)} r:id={chr(34)}rId{n}{chr(34)}/>" for n, s in enumerate(sheets, 1))}</sheets></workbook>'
    targets = "".join(f'<Relationship Id="rId{n}" Type="{link}/worksheet" Target="{"/xl/" if n % 2 else ""}worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>'
    parts["xl/sharedStrings.xml"] = f'{HEAD}<sst {SPACE}>{"".join(f"<si>{s}</si>" for s in strings)}</sst>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in parts.items():
            archive.writestr(name, body)
    return str(path)


def test_cells_of_every_kind(spark, tmp_path):
    cells = {
        (1, 1): "a & b", (1, 2): ["rich ", "text"], (2, 28): 3, (2, 29): 2.5, (2, 30): 1e20, (3, 1): True, (3, 2): ('<c r="AT" t="str"><f>A1</f><v>formula</v></c>',), (3, 3): ('<c r="AT" t="e"><v>#N/A</v></c>',),
        (3, 4): ('<c r="AT" t="inlineStr"><is><t>inline</t></is></c>',), (3, 5): ('<c r="AT" s="1"/>',), (3, 6): ("<c><v>7</v></c>",), (9, 1): "  kept ", (9, 2): "",
    }
    path = write(tmp_path / "w.xlsx", {"S": (cells, ["B2:B4", "D5"]), "空": ({}, [])})
    found, merged = workbooks.read_workbook(spark, path)
    assert {(r["sheet"], r["row"], r["col"]): r["value"] for r in found.collect()} == {
        ("S", 1, 1): "a & b", ("S", 1, 2): "rich text", ("S", 2, 28): "3", ("S", 2, 29): "2.5", ("S", 2, 30): "1e+20", ("S", 3, 1): "True", ("S", 3, 2): "formula", ("S", 3, 3): "#N/A", ("S", 3, 4): "inline",
        ("S", 3, 6): "7", ("S", 9, 1): "  kept ", ("S", 9, 2): "",
    }
    assert {(r["r1"], r["c1"], r["r2"], r["c2"]) for r in merged.collect()} == {(2, 2, 4, 2), (5, 4, 5, 4)}
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    with pytest.raises(Exception, match="zip"):
        workbooks.read_workbook(spark, str(tmp_path / "bad.xlsx"))


def test_column_letters(spark):
    numbers = [1, 26, 27, 52, 53, 702, 703, 16384]
    got = spark.createDataFrame([(n,) for n in numbers], "n int").select("n", workbooks.column_letters(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == {n: place(1, n)[:-1] for n in numbers}
    assert [workbooks.column_number(place(1, n)[:-1]) for n in numbers] == numbers


def test_tables(spark, tmp_path):
    path = write(tmp_path / "t.xlsx", {"first": ({(1, 1): " name ", (1, 2): "size", (1, 4): "x", (2, 1): "a", (2, 2): 5, (2, 3): "no name", (4, 4): "z"}, []), "second": ({(1, 1): "q"}, [])})
    assert [tuple(r) for r in workbooks.read_table(spark, path).orderBy("row_no").collect()] == [(0, "a", "5", None), (2, None, None, "z")]
    assert workbooks.read_table(spark, path, "second").columns == ["row_no", "q"] and workbooks.read_table(spark, path, "second").count() == 0
    assert workbooks.read_data(spark, path).columns == ["name", "size", "x"]
    (tmp_path / "t.csv").write_text("name\na\n")
    assert workbooks.read_data(spark, str(tmp_path / "t.csv")).count() == 1
    with pytest.raises(ValueError, match="unsupported"):
        workbooks.read_data(spark, "x.txt")
    with pytest.raises(ValueError, match="duplicate"):
        workbooks.read_data(spark, write(tmp_path / "d.xlsx", {"s": ({(1, 1): "a", (1, 2): "a "}, [])}))


def test_financial_standard(spark, tmp_path):
    cells = {
        (1, 2): "title", (2, 7): "leaf", (3, 2): "客户", (3, 3): "个人", (3, 4): "about 个人", (3, 5): "身份", (3, 6): "about 身份", (3, 7): " 姓名 ", (3, 8): "d1", (3, 9): " 3 ", (3, 10): "remark",
        (4, 7): "证件", (4, 9): 4, (5, 5): "联系", (5, 7): "电话", (5, 9): "2级", (6, 7): "——", (6, 2): "业务", (8, 2): "trailing",
    }
    path = write(tmp_path / "f.xlsx", {"other": ({(3, 7): "no"}, []), workbooks.FINANCE_SHEET: (cells, ["B3:B5", "C3:C5", "D3:D5", "E3:E4", "F3:F4", "J3:J5", "K3:K4"])})
    rows = workbooks.finance_standard(*workbooks.read_workbook(spark, path))
    got = {r["row"]: r for r in rows.collect()}
    assert sorted(got) == [3, 4, 5, 6]
    assert [got[4][c] for c in ("level_1", "level_2", "level_3", "leaf", "description", "raw_level", "remark", "department_opinion")] == ["客户", "个人", "身份", "证件", "", "4", "remark", ""]
    assert got[3]["leaf"] == "姓名" and got[3]["raw_level"] == "3" and got[5]["level_3"] == "联系" and got[5]["level_3_definition"] == "" and got[6]["level_2"] == ""
    assert got[4]["provenance"]["remark"].asDict() == {"source_cell": "J3", "merged_range": "J3:J5", "start_row": 3, "end_row": 5, "inherited": True}
    assert got[6]["provenance"]["remark"].asDict() == {"source_cell": "J6", "merged_range": None, "start_row": None, "end_row": None, "inherited": False}
    assert got[3]["provenance"]["department_opinion"].asDict() == {"source_cell": "K3", "merged_range": "K3:K4", "start_row": 3, "end_row": 4, "inherited": False}
    levels = ["level_1", "level_2", "level_3", "leaf"]
    entries = {r["row"]: r for r in standards.build_entries(rows, "finance", levels, levels, "row", "raw_level").collect()}
    assert (entries[4]["category_id"], entries[4]["level"], entries[5]["level"], entries[6]["issue"]) == ("finance:客户.个人.身份.证件", "L4", "L2", "placeholder")
    built, notes = standards.path_standard(rows, "finance")
    assert {r["category_id"] for r in built.collect()} == {"finance:客户.个人.姓名", "finance:客户.个人.证件", "finance:客户.个人.电话", "finance:业务..——"}
    assert [tuple(r) for r in notes.collect()] == [("finance-remark-3-5", "remark", "remark", "J3", "J3:J5", 3, 5, 0, sorted(["finance:客户.个人.身份.姓名", "finance:客户.个人.身份.证件", "finance:客户.个人.联系.电话"]))]
    own = rows.withColumn("remark", F.when(F.col("row") == 6, "alone").otherwise(F.col("remark")))
    assert {(r["annotation_id"], r["merged_range"]) for r in standards.path_standard(own, "f")[1].collect()} == {("f-remark-3-5", "J3:J5"), ("f-remark-6-6", None)}
    with pytest.raises(ValueError, match="entry ids are repeated"):
        standards.path_standard(rows.withColumn("leaf", F.lit("x")).withColumn("level_3", F.lit("")), "f")
    with pytest.raises(ValueError, match="no sheet"):
        workbooks.grading_catalogue(*workbooks.read_workbook(spark, path))


def test_grading_catalogue(spark, tmp_path):
    cells = {
        (3, 2): "业务", (3, 4): "生产", (3, 6): "工艺（A1-1）", (3, 7): "about 工艺", (3, 8): "参数（A1-1-1）", (3, 9): "d", (3, 10): "c", (3, 11): "3", (4, 8): "——", (4, 11): 2, (5, 6): "设备（A1-2）", (5, 7): "about 设备", (5, 12): "source", (6, 2): "only",
    }
    path = write(tmp_path / "c.xlsx", {workbooks.CATALOGUE_SHEET: (cells, ["B3:B5", "D3:D5", "F3:F4", "G3:G4", "L5:L6"])})
    rows = workbooks.grading_catalogue(*workbooks.read_workbook(spark, path))
    got = {r["row"]: r for r in rows.collect()}
    assert [(got[i]["leaf"], got[i]["description"], got[i]["issue"]) for i in (3, 4, 5, 6)] == [("参数（A1-1-1）", "d", None), ("工艺（A1-1）", "about 工艺", None), ("设备（A1-2）", "about 设备", None), ("", "", "no real leaf level")]
    assert got[6]["resource"] == "source" and got[6]["provenance"]["resource"]["inherited"]
    built = standards.build_catalog(rows, "g", "level_4", "level_3", "row").orderBy("row").collect()
    assert [r["category_id"] for r in built][0::2] == ["A1-1-1", "A1-2"]


def test_anchors_outside_of_a_layout_still_show(spark, tmp_path):
    path = write(tmp_path / "a.xlsx", {workbooks.FINANCE_SHEET: ({(2, 1): "wide", (3, 7): "leaf"}, ["A2:C3"])})
    row = workbooks.finance_standard(*workbooks.read_workbook(spark, path)).first()
    assert (row["level_1"], row["level_2"], row["level_3"]) == ("wide", "wide", "")
