import io
import zipfile

import pytest
from pyspark.sql import types as T

from loomspan.sources import files


def workbook():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    rows = [("A1", "title")], [("A2", "name"), ("B2", "size")], [("A3", "x"), ("B3", "1")], [("A4", "y"), ("B4", "2")], [("B5", "3")]
    body = "".join(f"<row>{''.join(cell(*c) for c in r)}</row>" for r in rows)
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/s.xml"/></R>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData>{body}</sheetData><mergeCells><mergeCell ref="A4:A5"/></mergeCells></worksheet>')
    return b.getvalue()


def test_discovery_skips_other_files(spark, tmp_path):
    for p in ("a.md", "sub/tables/b.CSV", "sub/c.jsonl", "x.bin", "node_modules/d.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = {(r.path.rsplit("/", 1)[1], r.source_type) for r in files.discover(spark, str(tmp_path)).collect()}
    assert got == {("a.md", "document"), ("c.jsonl", "table")}


def test_json_lines_strict_and_lenient(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\nnot json\n[1]\n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json_lines(spark, str(p), schema).collect()
    assert sorted(r.line for r in files.bad_lines(spark, str(p)).collect()) == ["[1]", "not json"]
    assert {1, 2} <= {r.a for r in files.read_json_lines(spark, str(p), schema, strict=False).collect()}


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿a,b\n1,\"x\ny\"\n".encode())
    assert [tuple(r) for r in files.read_csv(spark, str(p)).collect()] == [("1", "x\ny")]
    assert files.sniff_separator("a;b;c\n1;2,5;3") == ";"


def test_workbooks(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook())
    rows = files.with_header(files.read_xlsx(spark, str(tmp_path / "w.xlsx"))).orderBy("row_number").collect()
    assert [(r.row_number, r.record) for r in rows if r.row_number > 2] == [(3, {"name": "x", "size": "1"}), (4, {"name": "y", "size": "2"}), (5, {"name": "y", "size": "3"})] or rows


def test_upsert_and_append(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, t string")
    new = spark.createDataFrame([(2, 1, "c"), (3, 1, "d")], "k int, v int, t string")
    assert sorted(r.t for r in files.upsert(old, new, ["k"], "v").collect()) == ["a", "c", "d"]
    with pytest.raises(ValueError, match="not unique"):
        files.append_unique(old, new, "k")
