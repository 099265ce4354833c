"""Tree construction by the rules of the HTML standard."""

import pytest

from veldmark.operators import dom


def tree(text):
    """The body as nested names and texts."""

    def show(e):
        return e if isinstance(e, str) else f"<{e.name}>" + "".join(map(show, e.children)) + f"</{e.name}>"

    html = dom.parse(text).children[0]
    return "".join(show(c) for c in html.children[-1].children)


@pytest.mark.parametrize(
    "source,expected",
    [
        # formatting
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<a>1<div>2<div>3</a>4</div>5</div>", "<a>1</a><div><a>2</a><div><a>3</a>4</div>5</div>"),
        ("<p><b><b><b><b>x<p>y", "<p><b><b><b><b>x</b></b></b></b></p><p><b><b><b>y</b></b></b></p>"),
        ("<a href=x>1<a href=y>2", "<a>1</a><a>2</a>"),
        ("<b><table><td></b><i>x</table>y", "<b><table><tbody><tr><td><i>x</i></td></tr></tbody></table>y</b>"),
        ("<p><font><p>x</font>y", "<p><font></font></p><p><font>x</font>y</p>"),
        # tables
        ("<table>x<tr><td>y</table>", "x<table><tbody><tr><td>y</td></tr></tbody></table>"),
        ("<table><b><tr><td>a</td></tr>c", "<b></b><b>c</b><table><tbody><tr><td>a</td></tr></tbody></table>"),
        ("<table><caption>c<tr><th>a<td>b<tfoot><tr><td>f</table>", "<table><caption>c</caption><tbody><tr><th>a</th><td>b</td></tr></tbody><tfoot><tr><td>f</td></tr></tfoot></table>"),
        ("<table><col><colgroup><col><tr><td>x", "<table><colgroup><col></col></colgroup><colgroup><col></col></colgroup><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<table><tr><td><table><tr><td>i</table>o</table>", "<table><tbody><tr><td><table><tbody><tr><td>i</td></tr></tbody></table>o</td></tr></tbody></table>"),
        ("<table><tr><td>a<table>b", "<table><tbody><tr><td>ab<table></table></td></tr></tbody></table>"),
        # implied ends
        ("<p>a<div>b</p>c</div>", "<p>a</p><div>b<p></p>c</div>"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"),
        ("x</p>y</br>z", "x<p></p>y<br></br>z"),
        ("<select><option>a<option>b<p>c</select>d", "<select><option>a</option><option>bc</option></select>d"),
        ("<button>a<button>b", "<button>a</button><button>b</button>"),
        # tokens
        ("<pre>\n\na</pre>", "<pre>\na</pre>"),
        ("<textarea>\n<b></textarea>x", "<textarea><b></textarea>x"),
        ("a<!-- x --!>b<!-->c<?php y>d</ z>e", "abcde"),
        ("<i><script>if (a < b) '</p>'</script>x", "<i><script>if (a < b) '</p>'</script>x</i>"),
        ("x<a href='unclosed>y</a>z", "x"),
        ("a < b &amp c &notit; &#128; &am", "a < b & c ¬it; € &am"),
        ("<svg><title>t</title><path/>x</svg>y<math><mi>a<b>c</math>", "<svg><title>t</title><path></path>x</svg>y<math><mi>a<b>c</b></mi></math>"),
        ("<svg><p>x", "<svg></svg><p>x</p>"),
        ("x</body>y</html>z", "xyz"),
        ("<template><p>a</template>b", "b"),
    ],
)
def test_trees(source, expected):
    assert tree(source) == expected


def test_attributes():
    (e,) = [c for c in dom.parse("<body><a HREF='?a=1&copy=2&amp;b&lt;' href=x data-x=&copy title>").children[0].children[-1].children]
    assert e.attrs == {"href": "?a=1&copy=2&b<", "data-x": "©", "title": ""}


def test_heads():
    html = dom.parse("<!doctype html><title> a &amp; b</title><meta x><p>y<html lang=en><body class=k>").children[0]
    assert html.attrs == {"lang": "en"} and [c.name for c in html.children] == ["head", "body"] and html.children[1].attrs == {"class": "k"}
    assert [c.name for c in html.children[0].children] == ["title", "meta"] and dom.title("<p><title> a\n&amp;  b </title>") == "a & b"
    assert [c.name for c in dom.parse("").children[0].children] == ["head", "body"]


def test_pathological_texts_are_linear():
    for text in ("<a x=" * 20_000, "<b>" * 250 + "</i>" * 2000, "<a " + "=x" * 50_000, "&" * 100_000, "</" * 50_000):
        try:
            dom.parse(text)
        except dom.within.__globals__["FormatError"]:
            pass
