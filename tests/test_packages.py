"""Archives, Office packages, EPUB and images, built in the tests."""

import struct
import zlib

import pytest

from tests import packages as k
from veldmark.operators import archive, emit, epub, images, office
from veldmark.operators.errors import FormatError, Limits
from veldmark.sources import documents

W = f'xmlns:w="{office.W}" xmlns:r="{office.R}" xmlns:a="{office.A}"'


def md(d):
    return emit.markdown(d.blocks, assets=d.assets)


def refused(f, *args):
    with pytest.raises(FormatError) as e:
        f(*args)
    return e.value.code, e.value.limit, e.value.actual, e.value.maximum


def code(f, *args):
    return refused(f, *args)[0]


def read(kind, data, limits=None):
    return documents.read(kind, data, path="x." + kind, **({"limits": limits} if limits else {}))


def test_zip_takes_the_first_by_name():
    d = read("zip", k.zipped([("z.json", b"[1,2,3]"), ("a.csv", b"a,b\n1,2"), ("notes.txt", b"n"), ("d/", b"", True, 0o040755 << 16)], streamed=("a.csv",)))
    assert md(d) == "| a | b |\n| --- | --- |\n| 1 | 2 |\n" and d.source_format == "zip (csv)"
    assert d.properties["selected_entry"] == "a.csv" and d.properties["entry_count"] == "3" and d.properties["convertible_entry_count"] == "2"
    assert [w[0] for w in d.warnings] == ["additional_archive_entries_skipped"] and "z.json" in d.warnings[0][1]
    assert md(read("zip", k.zipped([("b.txt", b"1"), ("ä.bin", b"")]))) == "- b.txt\n- ä.bin\n"
    assert code(read, "zip", k.zipped([("a.csv", b"a,b\n1,2"), ("in.zip", k.zipped([("x", b"")]))])) == "unsupported_format"


@pytest.mark.parametrize("name", ["../x", "a/../x", "/x", "\\\\h\\x", "c:x", "a\0b", "./"])
def test_zip_names(name):
    assert code(archive.Archive, k.zipped([(name, b"")])) == "corrupt_input"


def test_zip_is_strict():
    good = k.zipped([("a.txt", b"x" * 100), ("b.txt", b"y")])
    archive.Archive(good + b"") and archive.Archive(k.zipped([("a", b"x")], comment=b"PK\5\6"))
    broken = [good[:-1], good + b"x", b"x" + good, good[:30], k.zipped([("a", b"1"), ("A/../a", b"2")]), k.zipped([("a", b"1"), ("./a", b"2")]), k.zipped([]), k.zipped([("l", b"x", True, 0o120777 << 16)]), k.zipped([("a", b"x", True, 0o040755 << 16)])]
    broken += [k.zipped([("a", b"x")], flags=1 << 4), good.replace(b"x" * 1, b"x", 1)[:14] + b"\0\0\0\0" + good[18:]]
    for data in broken:
        assert code(archive.Archive, data) == "corrupt_input"
    assert code(archive.Archive, k.zipped([("a", b"x")], flags=1)) == "encrypted_input"
    stored = bytearray(k.zipped([("a", b"hello", True)]))
    stored[31] ^= 1
    assert code(archive.Archive, bytes(stored)) == "corrupt_input"


def test_zip_limits():
    big = k.zipped([("a", bytes(100_000))])
    assert refused(archive.Archive, big, Limits(archive_expansion_ratio=10))[:2] == ("limit_exceeded", "archive_expansion_ratio")
    two = k.zipped([("a", b"x" * 40), ("b", b"y" * 40)])
    assert refused(archive.Archive, two, Limits(archive_total_uncompressed_bytes=79)) == ("limit_exceeded", "archive_total_uncompressed_bytes", 80, 79)
    archive.Archive(two, Limits(archive_total_uncompressed_bytes=80))
    assert refused(archive.Archive, two, Limits(archive_entries=1)) == ("limit_exceeded", "archive_entries", 2, 1)
    assert refused(archive.Archive, two, Limits(archive_entry_uncompressed_bytes=39)) == ("limit_exceeded", "archive_entry_uncompressed_bytes", 40, 39)


def paragraph(text, style="", run=""):
    return f"<w:p>{style and f'<w:pPr>{style}</w:pPr>'}<w:r>{run and f'<w:rPr>{run}</w:rPr>'}<w:t>{text}</w:t></w:r></w:p>"


def item(text, level=0, num=1):
    return paragraph(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>')


def docx(body, styles="", numbering=True, links=(), extra=None):
    lists = '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'
    parts = {
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>",
        "word/numbering.xml": f"<w:numbering {W}>{lists}</w:numbering>", "word/_rels/document.xml.rels": k.rels(links), "word/media/p.png": k.png(),
        "docProps/core.xml": f'<c:coreProperties xmlns:c="{office.CORE}" xmlns:d="{office.DC}"><d:title>T</d:title><d:creator>Me</d:creator><d:subject> </d:subject></c:coreProperties>', **(extra or {}),
    }
    return k.package("word/document.xml", office.DOCX, parts)


def test_docx():
    styles = '<w:style w:styleId="H"><w:name w:val="Heading 2"/></w:style><w:style w:styleId="S"><w:basedOn w:val="H"/></w:style><w:style w:styleId="O"><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style>'
    links = [("l1", f"{office.R}/hyperlink", "http://x", True), ("l2", f"{office.R}/hyperlink", "a/b.md", False), ("i1", office.IMAGE, "media/p.png", False)]
    body = paragraph("Top", '<w:pStyle w:val="O"/>') + paragraph("Sub", '<w:pStyle w:val="S"/>') + paragraph("Six", '<w:outlineLvl w:val="5"/>') + paragraph("seven", '<w:outlineLvl w:val="6"/>')
    body += item("one") + item("deep", 1) + item("two") + paragraph("bold", run='<w:b w:val="0"/>') + paragraph("both", run="<w:i/><w:b/>")
    body += '<w:p><w:hyperlink r:id="l1"><w:r><w:t>out</w:t></w:r></w:hyperlink><w:hyperlink r:id="l1"><w:r><w:t>again</w:t></w:r></w:hyperlink><w:hyperlink r:id="l2"><w:r><w:t>in</w:t></w:r></w:hyperlink><w:hyperlink w:anchor="m"><w:r><w:t>at</w:t></w:r></w:hyperlink></w:p>'
    body += '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:drawing><a:blip r:embed="i1"/></w:drawing><w:t>x</w:t><w:tab/><w:br/><w:t>y</w:t></w:r></w:p>'
    d = read("docx", docx(body, styles, links=links))
    assert md(d) == "# Top\n\n## Sub\n\n###### Six\n\nseven\n\n3. one\n\n   - deep\n4. two\n\n**bold**\n\n***both***\n\noutagain[in](a/b.md)[at](#m)\n\n| a<br>b |\n| --- |\n\nx\t  \ny\n\n![](image-001-p.png)\n"
    assert (d.title, d.author, d.subject) == ("T", "Me", None) and [w[0] for w in d.warnings] == ["external_link_skipped"] and d.assets[0].id == "asset-001"
    assert code(read, "docx", docx("", '<w:style w:styleId="a"><w:basedOn w:val="b"/></w:style><w:style w:styleId="b"><w:basedOn w:val="a"/></w:style>')) == "corrupt_input"
    chain = "".join(f'<w:style w:styleId="s{i}"><w:basedOn w:val="s{i + 1}"/></w:style>' for i in range(130))
    assert refused(read, "docx", docx("", chain))[:2] == ("limit_exceeded", "docx_style_inheritance_depth")
    assert code(read, "docx", docx("").replace(b"[Content_Types]", b"[content_types]")) == "corrupt_input"
    strict = docx("", extra={"word/document.xml": '<w:document xmlns:w="http://purl.oclc.org/ooxml/wordprocessingml/main"/>'})
    assert code(read, "docx", strict) == "unsupported_input"


P = f'xmlns:p="{office.P}" xmlns:a="{office.A}" xmlns:r="{office.R}"'


def shape(text, kind="", link=""):
    ph = f'<p:nvPr><p:ph type="{kind}"/></p:nvPr>' if kind else ""
    return f'<p:sp>{ph}<a:p><a:r>{f"""<a:rPr><a:hlinkClick r:id="{link}"/></a:rPr>""" if link else ""}<a:t>{text}</a:t></a:r></a:p></p:sp>'


def test_pptx():
    table = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:p><a:r><a:t>c1</a:t></a:r></a:p></a:tc><a:tc/></a:tr></a:tbl></p:graphicFrame>"
    slide = f'<p:sld {P}><p:spTree>{shape("Title", "ctrTitle")}{table}<p:grpSp><p:pic><a:blip r:embed="i"/></p:pic></p:grpSp>{shape("see", link="l")}{shape("more", link="l")}</p:spTree></p:sld>'
    notes = f'<p:notes {P}>{shape("hidden", "sldNum")}{shape("said")}</p:notes>'
    parts = {
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldId r:id="b"/><p:sldId r:id="a"/></p:presentation>', "ppt/media/p.png": k.png(),
        "ppt/_rels/presentation.xml.rels": k.rels([("a", office.SLIDE, "slides/one.xml", False), ("b", office.SLIDE, "slides/two.xml", False)]),
        "ppt/slides/one.xml": slide, "ppt/slides/two.xml": f"<p:sld {P}/>", "ppt/notes.xml": notes,
        "ppt/slides/_rels/one.xml.rels": k.rels([("i", office.IMAGE, "../media/p.png", False), ("l", f"{office.R}/hyperlink", "http://x", True), ("n", office.NOTES, "../notes.xml", False)]),
    }
    d = read("pptx", k.package("ppt/presentation.xml", office.PPTX, parts))
    assert md(d) == "## Slide 1\n\n## Slide 2\n\n# Title\n\n| c1 |  |\n| --- | --- |\n\n![](image-001-p.png)\n\nsee\n\nmore\n\n### Notes\n\nsaid\n"
    assert [(c, p) for c, _, p in d.warnings] == [("external_link_skipped", 2)] and d.page_count == 2
    assert refused(read, "pptx", k.package("ppt/presentation.xml", office.PPTX, parts), Limits(pages=1)) == ("limit_exceeded", "pages", 2, 1)
    del parts["ppt/slides/two.xml"]
    assert code(read, "pptx", k.package("ppt/presentation.xml", office.PPTX, parts)) == "corrupt_input"


def xlsx(rows, extra=None, dimension=""):
    s = f'xmlns="{office.S}" xmlns:r="{office.R}"'
    parts = {
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="Data" r:id="w"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": k.rels([("w", office.WORKSHEET, "s.xml", False)]),
        "xl/sharedStrings.xml": f"<sst {s}><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {s}><numFmts><numFmt numFmtId="164" formatCode="0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="10"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/s.xml": f"<worksheet {s}>{dimension}<sheetData>{rows}</sheetData></worksheet>", **(extra or {}),
    }
    return k.package("xl/workbook.xml", office.XLSX, parts)


def test_xlsx():
    rows = '<row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1" s="1"><v>0.125</v></c></row><row r="3"><c r="B3"><f>SUM(1,2)</f><v>3</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" s="2"><v>0.125</v></c></row>'
    d = read("xlsx", xlsx(rows))
    assert md(d) == "## Data\n\n| one |  | 12.50% |  |\n| --- | --- | --- | --- |\n|  |  |  |  |\n|  | `=SUM(1,2)` (3) | TRUE | 12% |\n"
    assert md(read("xlsx", xlsx(""))) == "## Data\n\n|  |\n| --- |\n"
    cell = '<row r="%d"><c r="%s"><v>1</v></c></row>'
    assert refused(read, "xlsx", xlsx(cell % (100000, "XFD100000"))) == ("limit_exceeded", "worksheet_cells", 1_638_400_000, 1_000_000)
    assert refused(read, "xlsx", xlsx(cell % (100001, "A100001"))) == ("limit_exceeded", "worksheet_rows", 100_001, 100_000)
    assert refused(read, "xlsx", xlsx(cell % (1, "XFE1"))) == ("limit_exceeded", "worksheet_columns", 16_385, 16_384)
    assert refused(read, "xlsx", xlsx("", dimension='<dimension ref="A1:Z100000"/>')) == ("limit_exceeded", "worksheet_dimension_cells", 2_600_000, 1_000_000)
    for bad in (cell % (2, "A1"), cell % (1, "a1"), cell % (2, "A2") + cell % (1, "A1"), '<row r="1"><c r="B1"/><c r="A1"/></row>', '<row r="1"><c r="A1" t="s"><v>2</v></c></row>', '<row r="1"><c r="A1" t="b"><v>2</v></c></row>', '<row r="1"><c r="A1" t="q"/></row>'):
        assert code(read, "xlsx", xlsx(bad)) == "corrupt_input"
    assert code(read, "xlsx", xlsx("", {"xl/externalLinks/e.xml": "<a/>"})) == "corrupt_input"


@pytest.mark.parametrize("formula", ["[1]Sheet!A1", "'[b.xlsx]S'!A1", "'C:\\[b]S' !A1", "cmd|'/c'!A0", 'WEBSERVICE ("x")', "1+rtd(1)", "IMAGE(A1)", "STOCKHISTORY(1)", '"open', "'open"])
def test_formulas_that_reach_outside(formula):
    assert code(office.check_formula, formula) == "corrupt_input"


@pytest.mark.parametrize("formula", ["'My [old] notes'&A1", "Table1[[#All],[a|b]]".replace("|", ","), '"[1]S!A1 | WEBSERVICE("', "FILTERXML(A1)", "MYIMAGE(1)", "'it''s'!A1", "Sheet1!A1+T[c]", "A1"])
def test_formulas_that_stay_inside(formula):
    office.check_formula(formula)


def book(spine=("two", "one"), extra="", first=True, page2=None):
    page = lambda t, body="": f'<html xmlns="{epub.XHTML}"><head><title>{t}</title></head><body><h1>{t}</h1>{body}</body></html>'
    opf = f'<package xmlns="{epub.OPF}"><metadata xmlns:d="{epub.DC}"><d:title>Book</d:title></metadata><manifest><item id="nav" href="nav.xhtml" media-type="{epub.PAGE}" properties="nav"/>' + "".join(f'<item id="{i}" href="t/{i}.xhtml" media-type="{epub.PAGE}"/>' for i in ("one", "two")) + f'<item id="p" href="p.png" media-type="image/png"/>{extra}</manifest><spine>{"".join(f"""<itemref idref="{i}"/>""" for i in spine)}</spine></package>'
    entries = [
        ("mimetype", epub.MIMETYPE, True), ("META-INF/container.xml", f'<container xmlns="{epub.CONTAINER}"><rootfile full-path="O/b.opf" media-type="{epub.PACKAGE}"/></container>'.encode()), ("O/b.opf", opf.encode()),
        ("O/nav.xhtml", page("Nav", '<p><a href="t/one.xhtml">first</a></p>').encode()), ("O/t/one.xhtml", page("One", '<p onclick="x">a <a href="http://o">out</a></p>').encode()),
        ("O/t/two.xhtml", (page2 or page("Two", '<p><img src="../p.png#f" alt="pic"/></p>')).encode()), ("O/p.png", k.png()),
    ]
    return k.zipped(entries if first else entries[1:] + entries[:1])


def test_epub():
    d = read("epub", book())
    assert md(d) == "## Navigation\n\n# Nav\n\n[first](epub://local/O/t/one.xhtml)\n\n# Two\n\n![pic](image-001.png)\n\n# One\n\na out\n"
    assert d.title == "Book" and d.page_count == 2 and d.assets[0].id == "epub-image-001"
    for bad in (book(first=False), book(spine=()), book(spine=("p",)), book(spine=("no",)), book(extra=f'<item id="one" href="p.png" media-type="image/png"/>'), book(extra='<item id="q" href="p.png" media-type="image/png"/>')):
        assert code(read, "epub", bad) == "corrupt_input"
    html = f'<html xmlns="{epub.XHTML}"><body>%s</body></html>'
    for body in ('<img src="http://x/y.png"/>', '<img src="../none.png"/>', '<svg xmlns="http://www.w3.org/2000/svg"/>'):
        assert code(read, "epub", book(page2=html % body)) == "corrupt_input"


def test_png():
    text = lambda key, value: (b"tEXt", key + b"\0" + value)
    image = images.png(k.png(texts=[text(b"Title", b"caf\xe9"), (b"zTXt", b"Software\0\0" + zlib.compress(b"s")), (b"iTXt", b"Comment\0\0\0en\0k\0" + "ü".encode())]))
    assert image.metadata == {"png.Title": "café", "png.Software": "s", "png.Comment": "ü"} and image.semantic
    d = read("png", k.png(texts=[text(b"Software", b"x")]))
    assert md(d) == "![x.png](image-001.png)\n" and [w[0] for w in d.warnings] == ["ocr_deferred"]
    assert images.png(k.png(color=3, depth=4, extra=k.chunk(b"PLTE", bytes(6)) + k.chunk(b"tRNS", b"\0\1"))).kind == "png"
    good = k.png()
    assert images.png(images.encode(2, 2, bytes(16))).width == 2
    bad = [
        good[:-1], good + b"x", good[:40] + b"\xff" + good[41:], k.png(rows=b"\0" * 17), k.png(rows=b"\0" * 19), k.png(rows=b"\5" + b"\0" * 17), k.png(color=3), k.png(depth=3, color=2, rows=b""), k.png(0),
        k.png(extra=k.chunk(b"ABCD", b"")), k.png(color=3, depth=1, extra=k.chunk(b"PLTE", bytes(9))), k.png(texts=[text(b" x", b"")]), k.png(texts=[text(b"", b"")]), k.png(texts=[(b"tEXt", b"none")]),
        k.png(extra=k.chunk(b"IDAT", zlib.compress(b"\0" * 18)) + k.chunk(b"aaaa", b"")), images.PNG + k.chunk(b"IEND", b""),
    ]
    for data in bad:
        assert code(images.png, data) == "corrupt_input"
    assert code(images.png, k.png(interlace=1)) == "unsupported_input"
    assert refused(images.parse, k.png(100, 100), Limits(image_width=50)) == ("limit_exceeded", "image_width", 100, 50)
    assert refused(images.parse, k.png(10, 10), Limits(image_pixels=99)) == ("limit_exceeded", "image_pixels", 100, 99)
    assert refused(images.parse, k.png(texts=[text(b"A", b"x" * 10)]), Limits(image_metadata_bytes=11))[1:] == ("image_metadata_bytes", 12, 11)


def test_jpeg():
    d = read("jpg" and "jpeg", k.jpeg(before=k.segment(0xFE, b"a note") + k.segment(0xFE, b"two")))
    assert d.properties["jpeg.comment"] == "a note" and d.properties["jpeg.comment.2"] == "two" and (d.properties["width"], d.properties["height"]) == ("3", "2") and not d.warnings
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 1) + struct.pack("<HHII", 0x010E, 2, 6, 26) + b"\0\0\0\0" + b"scene\0"
    assert images.jpeg(k.jpeg(before=k.segment(0xE1, b"Exif\0\0" + tiff))).metadata == {"exif.description": "scene"}
    dri = k.segment(0xDD, b"\0\1")
    fine = [
        k.jpeg(scans=b"".join(k.scan([i]) + b"\1" for i in (1, 2, 3))), k.jpeg(before=dri, scans=k.scan([1, 2, 3]) + b"\1\xff\xd0\2\xff\x00\xff\xff\xd1\3"), k.jpeg(before=k.segment(0xDD, b"\0\0")),
        k.jpeg(progressive=True, scans=k.scan([1, 2, 3], 0, 0, 1) + b"\1" + k.scan([1], 1, 63) + b"\1" + k.scan([1, 2, 3], 0, 0, 0x10) + b"\1"),
    ]
    for data in fine:
        assert images.jpeg(data).width == 3
    good = k.jpeg()
    bad = [
        good[:-2], good + b"x", good[:-3] + b"\xff\xd9", k.jpeg(scans=k.scan([1]) + b"\1"), k.jpeg(scans=k.scan([1, 1, 2]) + b"\1"), k.jpeg(scans=k.scan([1, 2, 4]) + b"\1"), k.jpeg(scans=k.scan([1, 2, 3], 1) + b"\1"),
        k.jpeg(scans=k.scan([1, 2, 3]) + b"\1\xff\xd0\1"), k.jpeg(before=dri, scans=k.scan([1, 2, 3]) + b"\1\xff\xd1\1"), k.jpeg(scans=k.scan([1, 2, 3]) + b"\1\xff\xff\0"), k.jpeg(width=0), k.jpeg(components=5),
        k.jpeg(progressive=True, scans=k.scan([1, 2, 3], 0, 0, 0x10) + b"\1"), k.jpeg(progressive=True, scans=k.scan([1, 2], 0, 0) + b"\1"), k.jpeg(scans=b""), k.jpeg(end=dri + b"\xff\xd9"), b"\xff\xd8" + k.scan([1]) + b"\1\xff\xd9",
    ]
    for data in bad:
        assert code(images.jpeg, data) == "corrupt_input"
    assert code(images.jpeg, k.jpeg().replace(b"\xff\xc0", b"\xff\xc1")) == "unsupported_format"
    assert code(documents.read, "jpeg", good, None, "x.png") == "corrupt_input"


def test_recognised_lines():
    d = images.convert(k.png(), "a/p.png", ocr_lines=[("one", 0.9), ("two", 0.4)])
    assert md(d) == "one\n\ntwo\n\n![p.png](image-001.png)\n" and [w[0] for w in d.warnings] == ["ocr_low_confidence"]
    assert [w[0] for w in images.convert(k.png(), "p.png", ocr_lines=[]).warnings] == ["ocr_no_text_found"]


def test_rows(spark):
    rows = [("1", "a/x.docx", docx(paragraph("hi"))), ("2", "x.zip", k.zipped([("a.html", b"<p>z")])), ("3", "y.png", k.png()), ("4", "x.xlsx", b"PK\3\4"), ("5", "x", docx("")), ("6", "x.pdf", b"%PDF-1.7"), ("7", "x.epub", b"nothing"), ("8", "z.png", None)]
    docs = spark.createDataFrame([(i, p, None, bytearray(c) if c is not None else None) for i, p, c in rows], "doc_id string, path string, source_url string, content binary")
    out = {r.doc_id: r for r in documents.convert(docs, asset_prefix="x.assets").collect()}
    assert [out[i].markdown for i in "123"] == ["hi\n", "z\n", "![y.png](x.assets/image-001.png)\n"]
    assert [out[i].error_code for i in "45678"] == ["corrupt_input", "ambiguous_format", "pdfium_unavailable", "format_conflict", "corrupt_input"]
    assert out["3"].assets[0].media_type == "image/png" and bytes(out["3"].assets[0].data) == k.png() and out["2"].format == "zip (html)"


def test_sql_function(spark):
    from veldmark.sources import sql

    rows = [("a.docx", docx(paragraph("hi"))), ("b.csv", b"a;b\n1;2"), ("c.pdf", b"x"), ("d", k.png()), (None, b"[1]x"), ("e.png", None)]
    spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary").createOrReplaceTempView("some_docs")
    sql.register(spark)
    got = {r.path: (r.markdown, r.error_code) for r in spark.sql("select path, t.* from some_docs, lateral to_markdown(content, path, cast(null as string)) t").collect()}
    assert got["a.docx"] == ("hi\n", None) and got["b.csv"][0].startswith("| a | b |") and got["c.pdf"] == (None, "format_conflict")
    assert got["d"] == (None, "corrupt_input") and got[None] == (None, "unsupported_format") and got["e.png"] == (None, "corrupt_input")


def test_formats_as_expressions(spark):
    cases = [(p, c) for p in ("a.DOCX", "x/b.d/c", "a.htm", "a.txt", "a.zip", "a.png", "a.pdf", None) for c in (b"PK\3\4x", b"%PDF-1", k.png(), b"\xff\xd8", b"plain", b"")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in cases], "path string, content binary")
    assert [r.format for r in documents.with_format(df).collect()] == [documents.format_of(p, c) for p, c in cases]
