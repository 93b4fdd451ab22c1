import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docketmill.sources import files, web

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def p(text, style=None, num=None, level=0):
    s = f'<w:pStyle w:val="{style}"/>' if style else ""
    n = f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>' if num else ""
    return f"<w:p><w:pPr>{s}{n}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


LEVELS = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>' for i, (f, t) in enumerate([("decimal", "%1."), ("lowerLetter", "(%2)"), ("upperRoman", "%1.%3")]))
DOCX = package({
    "word/document.xml": f'<w:document {W}><w:body>{p("Title", "Heading1")}{p("first", num=1)}{p("sub", num=1, level=1)}{p("sub two", num=1, level=1)}{p("deep", num=1, level=2)}{p("second", num=1)}{p("sub again", num=1, level=1)}'
    f'<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl><w:p><w:ins><w:r><w:t>kept</w:t></w:r></w:ins><w:del><w:r><w:delText>x</w:delText><w:t>gone</w:t></w:r></w:del></w:p></w:body></w:document>',
    "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="7">{LEVELS}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
    "word/footnotes.xml": f"<w:footnotes {W}>{p('a note')}</w:footnotes>", "docProps/core.xml": "<x><dc:creator>A Person</dc:creator></x>",
})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
XLSX = package({"xl/workbook.xml": "<w/>", "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>12.5</v></c></row><row/></sheetData></worksheet>'})
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
PPTX = package({"ppt/presentation.xml": "<p/>", "ppt/slides/slide10.xml": f"<s {A}><a:p><a:r><a:t>ten</a:t></a:r></a:p></s>", "ppt/slides/slide2.xml": f"<s {A}><a:p><a:r><a:t>two</a:t></a:r></a:p></s>", "ppt/notesSlides/notesSlide2.xml": f"<s {A}><a:p><a:r><a:t>said</a:t></a:r></a:p></s>"})
EML = b"Message-ID: <1@x>\r\nIn-Reply-To: <0@x>\r\nReferences: <a@x> <b@x>\r\nFrom: Ann <Ann@Firm.example>\r\nTo: b@c.example, D <d@e.example>\r\nSubject: =?utf-8?q?Caf=C3=A9?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=Z\r\n\r\n--Z\r\nContent-Type: text/plain\r\n\r\nhello\r\n--Z\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename=t.csv\r\n\r\n1,2\r\n--Z--\r\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    to = tmp_path_factory.mktemp("files")
    bomb = package({"a.txt": "0" * 30_000_000})
    small = package({"a.txt": "0" * 1_000_000})
    for name, data in {"a.docx": DOCX, "b.xlsx": XLSX, "c.pptx": PPTX, "d.eml": EML, "e.pdf": b"%PDF-1.7", "f.txt": b"plain", "g.zip": bomb, "j.zip": small, "h.docx": DOCX[:200], "i.html": b"<p>x"}.items():
        (to / name).write_bytes(data)
    return str(to)


def test_kinds_and_refusals(spark, folder):
    found = {r.path[-1:] + r.path.split("/")[-1][0]: r.kind for r in files.identified(files.read(spark, folder)).collect()}
    assert {k[1]: v for k, v in found.items()} == {"a": "docx", "b": "xlsx", "c": "pptx", "d": "eml", "e": "pdf", "f": "text", "g": "zip", "h": "zip", "i": "html", "j": "zip"}
    assert {r.path.split("/")[-1]: r.reason for r in files.refused(files.read(spark, folder)).collect()} == {"g.zip": "ratio", "h.docx": "damaged"}


def test_office_blocks(spark, folder):
    rows = files.office_blocks(files.read(spark, folder)).collect()
    of = lambda n: [r for r in sorted(rows, key=lambda r: r.idx or 0) if r.path.endswith(n)]
    assert [(r.number, r.text, r.kind) for r in of("a.docx")] == [(None, "Title", "heading"), ("1.", "first", "paragraph"), ("(a)", "sub", "paragraph"), ("(b)", "sub two", "paragraph"), ("1.I", "deep", "paragraph"), ("2.", "second", "paragraph"), ("(a)", "sub again", "paragraph"), (None, "a", "cell"), (None, "b", "cell"), (None, "kept", "paragraph"), (None, "a note", "note")]
    assert [(r.tbl, r.row, r.col) for r in of("a.docx")][7:9] == [(0, 0, 0), (0, 0, 1)]
    assert [r.text for r in of("b.xlsx")] == ["name | 12.5"] and [r.text for r in of("c.pptx")] == ["two", "ten", "said"]
    assert {r.problem for r in rows} == {None}
    assert {(r.path.split("/")[-1], r.kind) for r in files.package_findings(files.read(spark, folder)).collect()} == {("a.docx", "tracked"), ("a.docx", "author"), ("c.pptx", "notes")}


def test_content_controls_nested_tables_and_moves():
    sdt = lambda x: f"<w:sdt><w:sdtContent>{x}</w:sdtContent></w:sdt>"
    nested = f"<w:tbl><w:tr><w:tc>{p('inner')}</w:tc></w:tr></w:tbl>"
    table = f"<w:tbl>{sdt(f'<w:tr><w:tc>{p(chr(111) + chr(117) + chr(116) + chr(101) + chr(114))}{nested}{p(chr(121))}</w:tc>{sdt(f'<w:tc>{p(chr(122))}</w:tc>')}</w:tr>')}</w:tbl>"
    moved = '<w:p><w:moveFrom><w:r><w:t>gone</w:t></w:r></w:moveFrom></w:p><w:p><w:moveTo><w:r><w:t>came</w:t></w:r></w:moveTo></w:p>'
    data = package({"word/document.xml": f"<w:document {W}><w:body>{p('a')}{sdt(p('inside control') + sdt(p('deeper')))}{table}{moved}<w:p>{sdt('<w:r><w:t>in line</w:t></w:r>')}</w:p></w:body></w:document>"})
    got = [(b["text"], b["tbl"], b["row"], b["col"]) for b in files.docx_blocks(data)]
    none = (None, None, None)
    assert got == [("a", *none), ("inside control", *none), ("deeper", *none), ("outer", 0, 0, 0), ("inner", 1, 0, 0), ("y", 0, 0, 0), ("z", 0, 0, 1), ("came", *none), ("in line", *none)]


def test_sheets_in_the_order_of_tabs_or_numbers():
    sheet = lambda t: f'<worksheet {S}><sheetData><row><c t="inlineStr"><is><t>{t}</t></is></c></row></sheetData></worksheet>'
    parts = {f"xl/worksheets/sheet{i}.xml": sheet(i) for i in range(1, 13)}
    assert [b["text"] for b in files.xlsx_blocks(package({"xl/workbook.xml": "<w/>", **parts}))] == [str(i) for i in range(1, 13)]
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    tabs = [7, 12, 1]
    book = f"<workbook {S} {rel}><sheets>{''.join(f'<sheet r:id={chr(34)}r{i}{chr(34)}/>' for i in tabs)}</sheets></workbook>"
    rels = f"<Relationships>{''.join(f'<Relationship Id={chr(34)}r{i}{chr(34)} Target={chr(34)}worksheets/sheet{i}.xml{chr(34)}/>' for i in tabs)}</Relationships>"
    got = [b["text"] for b in files.xlsx_blocks(package({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, **parts}))]
    assert got == ["7", "12", "1", *(str(i) for i in range(2, 12) if i != 7)]


def test_leftovers_of_decks_and_workbooks():
    deck = package({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": '<s show="0"/>', "ppt/comments/c.xml": "<c/>"})
    book = package({"xl/workbook.xml": f'<workbook {S}><sheets><sheet state="veryHidden"/></sheets></workbook>', "xl/externalLinks/e.xml": "<e/>"})
    assert files.deck_leftovers(deck) == {"notes": False, "hidden": True, "comments": True}
    assert files.workbook_leftovers(book) == {"hidden": True, "comments": False, "links": True}


def test_damaged_office_file_is_a_row(spark):
    broken = package({"word/document.xml": "<not closed"})
    frame = spark.createDataFrame([("x.docx", bytearray(broken))], "path string, content binary")
    rows = files.office_blocks(frame).collect()
    assert [(r.path, r.problem) for r in rows] == [("x.docx", "ParseError")]


def test_counters():
    assert [files.counter(n, "lowerRoman") for n in (1, 4, 9, 14, 40, 1994)] == ["i", "iv", "ix", "xiv", "xl", "mcmxciv"]
    assert [files.counter(n, "upperLetter") for n in (1, 26, 27, 53)] == ["A", "Z", "AA", "AAA"]


def test_messages(spark, folder):
    rows = web.messages(files.read(spark, folder).where("path like '%.eml'")).collect()
    r = rows[0]
    assert (r.message_id, r.in_reply_to, r.refs, r.sender, r.to, r.subject, r.body.strip()) == ("<1@x>", "<0@x>", ["<a@x>", "<b@x>"], "ann@firm.example", ["b@c.example", "d@e.example"], "Café", "hello")
    assert [(a.name, a.type) for a in r.attachments] == [("t.csv", "text/csv")]


def test_pages_quotes_and_webhooks(spark):
    page = "<html><head><title>t</title></head><body><script>x('</p>')</script><p>One &amp; two</p><div>three<br>four&nbsp;5</div><!-- no --></body></html>"
    frame = spark.createDataFrame([(page,), (None,), ("",)], "html string")
    assert [r.t for r in frame.select(web.to_text(F.col("html")).alias("t")).collect()] == ["One & two\nthree\nfour 5", None, ""]
    assert web.quoted("a<blockquote>b<blockquote>c</blockquote></blockquote>").split("\n") == ["a", "> b", "> > c", ""]
    hook = spark.createDataFrame([('{"MessageID":"m","From":"a@b","Headers":[{"Name":"X","Value":"1"}]}',), ("nothing",)], "j string").select(web.from_webhook(F.col("j")).alias("m")).collect()
    assert hook[0].m.MessageID == "m" and hook[0].m.Headers[0].Value == "1" and (hook[1].m is None or hook[1].m.MessageID is None)


def test_another_vendors_json(spark):
    rows = ['{"message_id":"1","threadId":"t","from":"a@b","to":["c@d"],"attachments":[{"filename":"x","content_type":"y","size":3}]}', '{"message":{"message_id":"2","thread_id":" ","in_reply_to":"1","from_":"q"}}', '{"message_id":"3"}', "no json", None, "{}"]
    got = [r.m for r in spark.createDataFrame([(x,) for x in rows], "j string").select(web.from_vendor(F.col("j")).alias("m")).collect()]
    assert [(m.message_id, m.thread, m.sender) if m else None for m in got] == [("1", "t", "a@b"), ("2", "1", "q"), ("3", "3", None), None, None, None]
    assert got[0].to == ["c@d"] and tuple(got[0].attachments[0]) == ("x", "y", 3)


def test_outbound_json(spark):
    import json

    row = spark.range(1).select(web.outbound(F.array(F.lit("a@b")), F.lit("s"), F.lit('q"'), in_reply_to=F.lit("m1")).alias("a"), web.outbound(F.array(F.lit("a@b")), F.lit("s"), F.lit(None).cast("string")).alias("b")).first()
    assert json.loads(row.a) == {"to": ["a@b"], "subject": "s", "text": 'q"', "headers": {"In-Reply-To": "m1", "References": "m1"}} and json.loads(row.b) == {"to": ["a@b"], "subject": "s"}


def test_blocks_of_any_kind(spark, folder):
    rows = web.all_blocks(files.read(spark, folder)).collect()
    of = lambda n: [(r.text, r.problem) for r in sorted(rows, key=lambda r: r.idx or 0) if r.path.endswith(n)]
    assert of("f.txt") == [("plain", None)] and of("i.html") == [("x", None)] and of("d.eml") == [("hello", None)]
    assert of("e.pdf") == [(None, "no reader: pdf")] and of("g.zip") == [(None, "no reader: zip")] and of("b.xlsx") == [("name | 12.5", None)]
    assert len(of("a.docx")) == 11
    odd = spark.createDataFrame([("x/o.txt", bytearray(b"caf\xe9 \xff\r\nb\n"))], "path string, content binary")
    assert [(r.idx, r.text) for r in web.all_blocks(odd).orderBy("idx").collect()] == [(0, "caf\ufffd \ufffd"), (1, "b")]
