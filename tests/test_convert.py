"""Conversion of small documents, and errors as rows."""

import pytest

from veldmark.functions import urls
from veldmark.operators import emit, html, structured
from veldmark.operators.errors import FormatError, Limits
from veldmark.sources.documents import convert, convert_one


def md(text, url=None):
    return emit.markdown(html.Converter(url).document(text)[1])


@pytest.mark.parametrize(
    "source,expected",
    [
        ("<p>a <b>b<p>c", "a **b**\n\n**c**\n"),
        ("<h2>T</h2><ul><li>x<li>y</ul>", "## T\n\n- x\n- y\n"),
        ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y\n"),
        ("<p>a<em> b </em>c", "a *b* c\n"),
        ("<pre><code class='language-py'>x = 1\n</code></pre>", "```py\nx = 1\n```\n"),
        ("<table><tr><th align=right>a<th>b<tr><td>1|2</table>", "| a | b |\n| ---: | --- |\n| 1\\|2 |  |\n"),
        ("<blockquote><p>q</blockquote><hr>", "> q\n\n***\n"),
        ("<p>x <a href='/y' title='t'>z</a>", 'x [z](http://h/y "t")\n'),
        ("<p><a href='javascript:x'>z</a><script>var a='<p>'</script>", "z\n"),
        ("<p style='display:none'>x</p><p hidden>y</p>", ""),
    ],
)
def test_html(source, expected):
    assert md(source, "http://h/") == expected


def test_title():
    assert html.Converter().document("<title> a \n b&amp; </title>x")[0] == "a b&"


@pytest.mark.parametrize(
    "text,extension,found",
    [
        (b"{name,age\nx,1", None, ("csv", None)), (b"[1,2]", None, (None, "ambiguous_format")), (b"[1,2]", "json", ("json", None)), (b"{not json", None, (None, "unsupported_format")),
        (b"{not json", "json", ("json", None)), (b"<a/>", None, ("xml", None)), (b"<a/>", "csv", (None, "format_conflict")), (b"a,b;c\n1,2;3", None, (None, "ambiguous_format")),
        (b"a,b;c\n1,2;3", "csv", (None, "ambiguous_format")), (b'{"a":1,"a":2}', None, ("json", None)),
    ],
)
def test_detection(text, extension, found):
    assert structured.detect(text, extension) == found


def test_delimiter_is_judged_on_records_that_it_splits():
    assert structured.detect_delimiter("title\nnote\nmore\na,b\nc,d") == (",", True)
    assert structured.delimiter_scores("a,b\n1,2,3\n") == {",": (1, 3, 2)}


def budget(f, *args):
    with pytest.raises(FormatError) as e:
        f(*args)
    return e.value.code, e.value.limit, e.value.actual, e.value.maximum


def test_budgets_are_exact():
    over = lambda *x: ("limit_exceeded", *x)
    csv = lambda t: structured.parse_csv(t, ",")
    assert budget(csv, ",".join("a" * 4097)) == over("csv_fields_per_record", 4097, 4096) and csv(",".join("a" * 4096))
    assert budget(csv, "x" * 65_537) == over("csv_field_bytes", 65_537, 65_536) and csv("x" * 65_536)
    assert budget(csv, "a\n" * 10_001) == over("csv_records", 10_001, 10_000) and csv("a\n" * 10_000)
    assert budget(csv, (",".join("a" * 1000) + "\n") * 101) == over("csv_cells", 100_001, 100_000)
    assert budget(structured.parse_json, "[" + "0," * 20_000 + "0]") == over("json_array_entries", 20_001, 20_000)
    assert budget(structured.parse_json, "[0,[0,0]]", Limits(json_nodes=2, json_array_entries=1)) == over("json_array_entries", 2, 1)
    assert budget(structured.parse_json, "[" * 129 + "]" * 129) == over("json_nesting_depth", 129, 128) and structured.parse_json("[" * 128 + "]" * 128)
    assert budget(structured.parse_xml, b"<a>" * 129) == over("xml_nesting_depth", 129, 128)
    assert budget(structured.parse_xml, b"<a><b/><c/></a>", Limits(xml_nodes=2)) == over("xml_nodes", 3, 2)
    assert budget(html.parse, "<div>" * 300) == over("html_dom_depth", 257, 256)
    for bad in ({"pages": 0}, {"json_nesting_depth": 129}):
        with pytest.raises(ValueError):
            Limits(**bad)


XMLNS = "http://www.w3.org/2000/xmlns/"


@pytest.mark.parametrize("bad", ["<xmlns:a/>", '<a xmlns:x=""/>', f'<a xmlns="{XMLNS}"/>', '<a xmlns:xml="u"/>', '<a xmlns:x="http://www.w3.org/XML/1998/namespace"/>', '<a xmlns:x="u" xmlns:y="u" x:k="1" y:k="2"/>', "<a:b:c/>", "<?xml version='1.0' encoding='UTF-16'?><a/>", "<a><?XmL x?></a>", "<a/>b", "<a>&x;</a>"])
def test_xml_refuses(bad):
    with pytest.raises(FormatError):
        structured.parse_xml(bad.encode())


@pytest.mark.parametrize("good", ['<x:a xmlns:x="u"><x:a xmlns:x="v"/></x:a>', '<a xmlns="u"><b xmlns=""/></a>', '<a xml:lang="en"/>', "<xmlns/>", "<?xml version='1.0' encoding='utf-8' standalone='yes'?><!-- c --><a/><?p x?>"])
def test_xml_reads(good):
    structured.parse_xml(good.encode())


def test_images_of_pages():
    d = html.Converter("http://h/d/")
    one = "data:image/png;base64,iVBORw0KGgo="
    _, blocks = d.document(f"<img alt=a src='{one}'><img alt=b src='data:text/plain,x'><img src='//h/x.png'><img alt=c src=y.png><img alt=d>")
    assert emit.markdown(blocks, assets=d.assets) == "![a](image-001.png)\n\nb\n\nc\n\nd\n" and d.assets[0].media_type == "image/png"
    assert [w[0] for w in d.warnings] == ["invalid_asset_skipped", "missing_image_alt", "external_asset_skipped", "external_asset_skipped", "invalid_asset_skipped"]


def test_local_images(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "p.jpeg").write_bytes(b"1")
    (tmp_path / "o.png").write_bytes(b"2")
    (tmp_path / "d" / "x.html").write_text("")
    d = html.Converter(path=f"file:{tmp_path}/d/x.html")
    _, blocks = d.document("<img alt=a src=p.jpeg><img alt=b src=../o.png><img alt=c src=none.png>")
    assert [a.file_name for a in d.assets] == ["image-001.jpg"] and [w[0] for w in d.warnings] == ["external_asset_skipped", "invalid_asset_skipped"]


@pytest.mark.parametrize(
    "base,reference,url",
    [
        ("http://H:80/a/b?x#y", "../c d?q='1'#f g", "http://h/c%20d?q=%271%27#f%20g"), ("http://h/a", "/für", "http://h/f%C3%BCr"), (None, "mailto:a@b", "mailto:a@b"), ("http://h/x/", "//o/p", "http://o/p"),
        ("http://h/x/?a", "#b", "http://h/x/?a#b"), ("http://h", "", "http://h/"), ("file:///d/x.html", "pic.png", "file:///d/pic.png"), ("https://h/a/b/", "..\\c", "https://h/a/c"), ("http://h/", "https:x", "https://x/"),
    ],
)
def test_urls(base, reference, url):
    assert str(urls.join(base, reference)) == url


@pytest.mark.parametrize("source,expected", [("<base href='http://[x'><p><a href=y>z", "[z](http://s/y)\n"), ("\ufeff<p>x", "x\n"), ("<base href='mailto:x'><a href=y>z</a>", "[z](http://s/y)\n"), ("<pre></pre>", "```\n\n```\n")])
def test_html_oddities(source, expected):
    assert md(source, "http://s/") == expected


def test_csv_is_strict():
    assert structured.parse_csv('a,"b ""x"""\r\n\nc,d\n', ",") == [["a", 'b "x"'], [""], ["c", "d"]]
    for bad in ('a"b,c', '"a', '"a"b', "a\rb"):
        with pytest.raises(structured.FormatError):
            structured.parse_csv(bad, ",")


def test_json_keeps_numbers_and_order():
    text = b'{"z": 1.50, "a": [123456789012345678901234567890, null]}'
    assert emit.markdown(structured.json_blocks(text)[0]) == "- **z**: `1.50`\n- **a**:\n\n  - `123456789012345678901234567890`\n  - `null`\n"
    for bad in (b'{"a":1,"a":2}', b'{"a":1} x', b"NaN"):
        with pytest.raises(structured.FormatError):
            structured.json_blocks(bad)


def test_xml():
    assert emit.markdown(structured.xml_blocks(b'<r k="v">\n <c>t</c>\n</r>')[0]) == "- **r** (**k**: `v`)\n\n  - **c**: t\n"
    for bad in (b"<!DOCTYPE r><r/>", b"<a><b></a>", b"<x:a/>"):
        with pytest.raises(structured.FormatError):
            structured.parse_xml(bad)


def test_errors_are_rows(spark):
    rows = [("1", "a.csv", None, bytearray(b"a,b\n1,2")), ("2", "b.pdf", None, bytearray(b"no")), ("3", "c.json", None, bytearray(b"\xff")), ("4", "x", None, bytearray(b"[1,2]"))]
    out = {r.doc_id: r for r in convert(spark.createDataFrame(rows, "doc_id string, path string, source_url string, content binary")).collect()}
    assert out["1"].markdown == "| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    assert [out[i].error_code for i in "234"] == ["format_conflict", "corrupt_input", "ambiguous_format"]


def test_escape_text_matches_columns(spark):
    from veldmark.functions import gfm

    texts = ["- a", "   + b", "---", "== ", "12. x", "a_b*c", "<&>", "1) y", "x - y", "#t\n- u\n", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(gfm.escape_text("t"), gfm.escape_text("t", True)).collect()
    assert [tuple(r) for r in got] == [(emit.escape_text(t), emit.escape_text(t, True)) for t in texts]


def test_empty_and_unknown():
    assert convert_one("1", "json", b"", None)["error_code"] == "corrupt_input"
    assert convert_one("1", "html", b"", None)["error_code"] == "format_conflict"
    assert convert_one("1", "zip", b"", None)["error_code"] == "corrupt_input"
    assert convert_one("1", None, None, None)["error_code"] == "corrupt_input"
    assert convert_one("1", None, b"just words", None)["error_code"] == "unsupported_format"
