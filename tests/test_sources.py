"""Sources other than tables, sinks and changed tables."""

import json
import zipfile

import pytest

from docquarry.operators import mutation
from docquarry.sources import files, sheets


def test_json_lists_and_sink(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "name": "x"}, {"id": 2, "name": None}]))
    rows = files.json_rows(spark, str(tmp_path / "a.json"), "id long, name string")
    assert sorted(map(tuple, rows.collect())) == [(1, "x"), (2, None)]
    for _ in range(2):
        files.write_json(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_last_lines_of_logs(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.log").write_text("".join(f"{i} {'error' if i % 3 == 0 else 'fine'} {name}\n" for i in range(20)))
    found = files.log_lines(spark, str(tmp_path / "*.log"), "error")
    assert found.count() == 14
    last = files.log_lines(spark, str(tmp_path / "*.log"), "error", last=2)
    assert sorted(r.line for r in last.collect()) == sorted(f"{i} error {n}" for i in (15, 18) for n in "ab")


def test_documents_are_decoded(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.txt", "žluť".encode("cp1250")), ("b.md", "﻿žluť".encode()), ("sub/c.html", b"<p>"), ("d.bin", b"\x00")):
        (tmp_path / name).write_bytes(data)
    got = sorted((r.ending, r.text) for r in files.documents(spark, str(tmp_path)).collect())
    assert got == [("html", ""), ("md", "žluť"), ("txt", "žluť")]


def test_numbers_are_dense_and_in_order(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1009 x")
    got = sorted((r.n, r.x) for r in mutation.numbered(rows, ["x"], "n", 5).collect())
    assert got == list(enumerate(sorted(r.x for r in rows.collect()), 5))
    assert mutation.numbered(rows.where("false"), ["x"], "n").count() == 0


def test_counted_delete_takes_no_nulls(spark):
    rows = spark.createDataFrame([(1,), (None,), (3,)], "a long")
    assert tuple(mutation.counted_delete(rows, rows.a > 2).first()) == (1, 2)


def test_documents_of_all_kinds(spark, tmp_path):
    paragraph = "<w:p><w:r><w:t>Žluť</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>second</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "a.DOCX", "w") as book:
        book.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraph}</w:body></w:document>')
    (tmp_path / "b.Docx").write_bytes(b"no archive")
    (tmp_path / "c.LaTeX").write_bytes("\\v{z}luť".encode("cp1250"))
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "e.HTM").write_bytes(b"<p>one<b>two</b></p><script>no</script>")
    (tmp_path / "f.png").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.ending, r.text) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["a.DOCX"] == ("docx", "Žluť\tb\nsecond")
    assert got["b.Docx"][1].startswith("[Error: Could not extract text from .docx file")
    assert got["c.LaTeX"] == ("latex", "\\v{z}luť")
    assert got["d.pdf"][1].startswith("[Error: Could not extract text from .pdf file")
    assert got["e.HTM"] == ("htm", "one\ntwo") and set(got) == {"a.DOCX", "b.Docx", "c.LaTeX", "d.pdf", "e.HTM"}


def book(path, sheets, active=0, strings=()):
    """An XLSX file of sheets {name: XML of its rows}."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as out:
        listed = "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="r{k + 1}"/>' for k, n in enumerate(sheets))
        out.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k + 1}" Type="t" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets)))
        out.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        if strings:
            out.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(strings)}</sst>")
        for k, rows in enumerate(sheets.values()):
            out.writestr(f"xl/worksheets/sheet{k + 1}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")


def test_spreadsheets(spark, tmp_path):
    strings = ["<si><t>plain</t></si>", "<si><r><t>rich </t></r><r><t>text</t></r><rPh><t>hint</t></rPh></si>"]
    first = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="4"><c r="B4"><v>2.5</v></c><c r="AA4" t="inlineStr"><is><t>far</t></is></c><c r="AB4" t="e"><v>#N/A</v></c></row><row r="5"/>'
    book(tmp_path / "a.xlsx", {"one": first, "two": "<row><c><v>7</v></c></row>"}, 1, strings)
    (tmp_path / "bad.XLSX").write_bytes(b"no archive")
    book(tmp_path / "worse.xlsx", {"one": '<row r="1"><c r="A1"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>9</v></c></row>'})
    rows = sheets.sheet_rows(spark, str(tmp_path)).collect()
    got = {(r.path.rsplit("/", 1)[1], r.sheet, r.row_no): r for r in rows}
    assert got["a.xlsx", "one", 1].cells == ["plain", None, "rich text"] and not got["a.xlsx", "one", 1].active
    assert got["a.xlsx", "one", 4].cells == [None, "2.5"] + [None] * 24 + ["far", None]
    assert got["a.xlsx", "two", 1].cells == ["7"] and got["a.xlsx", "two", 1].active
    assert "BadZipFile" in got["bad.XLSX", None, None].problem
    assert got["worse.xlsx", "one", 1].cells == ["1"] and "IndexError" in got["worse.xlsx", None, None].problem
    assert len(got) == 6
    few = sheets.sheet_rows(spark, str(tmp_path / "a.xlsx"), ["AA", "B"]).where("row_no = 4").first()
    assert few.cells == ["far", "2.5"]


def cells(row, values):
    return f'<row r="{row}">' + "".join(f'<c r="{c}{row}" t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>' for c, v in values.items()) + "</row>"


def test_snippets_and_criteria(spark, tmp_path):
    rows = [(1, "id", "t"), (2, "1", "too early"), (3, "6", " six "), (4, "7.0", "seven"), (5, "6", "six again"), (6, "x", "no number"), (7, "8", None)]
    book(tmp_path / "s.xlsx", {"s": "".join(cells(r, {k: v for k, v in (("C", i), ("F", t)) if v}) for r, i, t in rows)})
    got = {(r.snippet_id, r.text) for r in sheets.snippets(spark, str(tmp_path / "s.xlsx")).collect()}
    assert got == {(6, "six again"), (7, "seven")}
    book(tmp_path / "c.xlsx", {"c": cells(1, {"B": "id"}) + cells(2, {"B": "3", "C": " p ", "E": "Is it?", "H": "|6|;|74|;x"}) + cells(3, {"C": "no id"})})
    r = sheets.criteria(spark, str(tmp_path / "c.xlsx")).collect()
    assert [(x.id, x.phase, x.group, x.text, x.snippet_ids, x.row_no) for x in r] == [(3, "p", "", "Is it?", [6, 74], 2)]


def test_a_table_gives_way_to_a_whole_one_only(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(3), path)
    files.replace_table(spark.read.parquet(path).selectExpr("id + 10 id"), path)  # read from where it goes
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    with pytest.raises(Exception, match="no good"):
        files.replace_table(spark.range(3).selectExpr("if(id = 2, raise_error('no good'), id) id"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_access_logs(spark, tmp_path):
    line = '10.0.0.{0} - - [01/Feb/2024:10:00:0{0} +0000] "GET /a?b={0} HTTP/1.1" {1} {2} "-" "agent"\n'
    (tmp_path / "a.log").write_text("".join(line.format(i, (200, 401, 403)[i % 3], "-" if i == 4 else i * 10) for i in range(9)) + "no form\n")
    denied = files.access_log(spark, str(tmp_path), (401, 403)).collect()
    assert sorted((r.client[-1], r.status, r.n_bytes) for r in denied) == [(str(i), (200, 401, 403)[i % 3], None if i == 4 else i * 10) for i in range(9) if i % 3]
    assert all(r.method == "GET" and r.url.startswith("/a?b=") and r.time.minute == 0 for r in denied)
    assert sorted(r.client[-1] for r in files.access_log(spark, str(tmp_path), (401, 403), last=2).collect()) == ["7", "8"]
    assert files.access_log(spark, str(tmp_path)).count() == 9
