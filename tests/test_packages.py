import pytest
from test_sources import W, package, p

from docketmill.sources import packages

RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
out = lambda target: f'<Relationship Id="r1" Type="x" TargetMode="External" Target="{target}"/>'


def docx(text="plain", **more):
    return package({"word/document.xml": f"<w:document {W}><w:body>{p(text)}</w:body></w:document>", **{k.replace("__", "/").replace("_xml", ".xml"): v for k, v in more.items()}})


INNER = package({"xl/workbook.xml": "<w/>", "xl/externalLinks/externalLink1.xml": "<x/>", "docProps/core.xml": '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Other Person</dc:creator></c>', "xl/embeddings/deep.docx": docx("deepest", docProps__app_xml="<P><Company>Strand LLP</Company></P>")})
OUTER = package({
    "word/document.xml": f"<w:document {W}><w:body>{p('Acme Mills and Strand LLP')}<w:p><w:ins><w:r><w:t>x</w:t></w:r></w:ins></w:p></w:body></w:document>",
    "word/_rels/document.xml.rels": RELS.format(out("https://example.com/x") + out("file:///C:/Users/someone/template.dotx") + '<Relationship Id="r2" Type="x" Target="media/a.png"/>'),
    "word/header1.xml": f'<w:hdr {W} xmlns:v="urn:schemas-microsoft-com:vml"><w:p><w:r><w:pict><v:shape><v:textpath string="DRAFT"/></v:shape></w:pict></w:r></w:p></w:hdr>',
    "word/embeddings/table.xlsx": INNER, "word/embeddings/ole.bin": b"\xd0\xcf\x11\xe0", "word/embeddings/broken.docx": INNER[:80],
})


def test_a_walk_goes_into_packages_within_packages():
    got = list(packages.walk(OUTER))
    table, deep = "word/embeddings/table.xlsx", "word/embeddings/table.xlsx|xl/embeddings/deep.docx"
    assert set(got) == {
        ("", 0, "link", "https://example.com/x"), ("", 0, "local link", "file:///C:/Users/someone/template.dotx"), ("", 0, "watermark", "DRAFT"), ("", 0, "tracked", ""), ("", 0, "embedded file", table),
        ("", 0, "embedded file", "word/embeddings/ole.bin"), ("", 0, "embedded file", "word/embeddings/broken.docx"), ("word/embeddings/broken.docx", 1, "not opened", "BadZipFile"), (table, 1, "property", "Other Person"), (table, 1, "links", ""),
        (table, 1, "embedded file", "xl/embeddings/deep.docx"), (deep, 2, "property", "Strand LLP"),
    }


def test_depth_and_size_are_bounded():
    shallow = list(packages.walk(OUTER, depth=1))
    assert ("word/embeddings/table.xlsx|xl/embeddings/deep.docx", 2, "not opened", "too deep") in shallow and not any(r[3] == "Strand LLP" for r in shallow)
    bomb = docx(word__embeddings__b=package({"a": "0" * 30_000_000}))
    assert [r for r in packages.walk(bomb) if r[2] == "not opened"] == [("word/embeddings/b", 1, "not opened", "packed too tightly")]


@pytest.mark.parametrize("own,want", [([], {("a", "word/embeddings/table.xlsx", "Other Person")}), (["other person"], set())])
def test_names_of_others(spark, own, want):
    files = spark.createDataFrame([("a", bytearray(OUTER)), ("b", bytearray(b"no")), ("c", None), ("d", bytearray(docx()))], "path string, content binary")
    found = packages.travelling(files)
    assert {r.path for r in found.collect()} == {"a"}
    texts = spark.createDataFrame([("a", "Acme Mills and STRAND LLP"), ("b", None)], "path string, text string")
    assert {tuple(r) for r in packages.foreign_names(found, texts, own).collect()} == want


def test_other_attachments(spark):
    rows = [(1, 0, "deed.docx", bytearray(OUTER)), (1, 1, "x.docx", bytearray(docx(docProps__app_xml="<P><Manager>B</Manager></P>"))), (1, 2, "y.docx", bytearray(docx())), (2, 0, "z.docx", bytearray(OUTER)), (2, 1, "t.txt", bytearray(b"text"))]
    frame = spark.createDataFrame(rows, "msg_id long, position int, filename string, content binary")
    assert [tuple(r) for r in packages.other_attachments(frame).collect()] == [(1, 1, "x.docx", "property: B")]


def test_files_are_made_by_all_cores(spark):
    """A table in one small file is dealt out before its files are made."""
    from docketmill.plans import packages as plans

    made = plans.files(spark, "/root/testdata/sf0.001")
    assert made.select("path").rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
