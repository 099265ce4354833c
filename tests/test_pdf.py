"""Pages rebuilt from synthetic glyphs: 5 points a character, as high as their size."""

import numpy as np
import pytest

from veldmark.operators import emit, pdf


def glyphs(text, left, top, size=10, weight=400, advance=5):
    return [pdf.Glyph(c, pdf.Box(left + i * advance, top, left + (i + 1) * advance, top + size), size, weight) for i, c in enumerate(text)]


def lines(*rows):
    return pdf.page_lines([[g] for r in rows for g in glyphs(*r)], pdf.STANDARD, False)


def page(rows, rules=(), links=(), body=10, width=300):
    p = pdf.Page(lines(*rows), list(rules), [(pdf.Box(*b), t) for b, t in links], width, np.float32(body))
    return emit.markdown([b for _, _, b in p.blocks]), [c for c, _ in p.warnings]


def test_paragraphs_and_hyphens():
    rows = [("determin-", 20, 20), ("istic A-", 20, 32), ("Frame 9-", 20, 44), ("patch", 20, 56), ("far", 20, 90)]
    assert page(rows) == ("deterministic A- Frame 9- patch\n\nfar\n", [])


def test_columns():
    rows = [("left one", 20, 20), ("right one", 180, 20), ("left two", 20, 32), ("right two", 180, 32)]
    assert page(rows)[0] == "left one left two\n\nright one right two\n"
    assert page([("left one", 20, 20), ("right", 180, 20), ("left two", 20, 32)])[1] == ["table_degraded", "ambiguous_reading_order"]


def test_headings():
    assert page([("Big", 20, 20, 20, 700), ("Mid", 20, 60, 15, 700), ("text", 20, 90)])[0] == "# Big\n\n## Mid\n\ntext\n"
    assert page([("One", 20, 20, 24, 700), ("Two", 20, 60, 19, 700), ("x", 20, 100)])[0] == "# One\n\n## Two\n\nx\n"
    assert page([("Thin", 20, 20, 16, 0), ("x", 20, 60)])[0] == "# Thin\n\nx\n"


def test_lists():
    assert page([("1. One", 20, 20), ("2. Two", 20, 32), ("4. Four", 20, 44), ("- a", 20, 60), ("- b", 40, 72)])[0] == "1. One\n2. Two\n\n4. Four\n\n- a\n\n- b\n"
    assert page([("•", 20, 20), ("first", 45, 20), ("•", 20, 40), ("second", 45, 40)])[0] == "- first\n- second\n"


def test_links():
    rows = [("Safe link tail", 20, 20)]
    assert page(rows, links=[((20, 20, 65, 30), "https://x/y")])[0] == "[Safe link](https://x/y) tail\n"
    assert page(rows, links=[((20, 20, 65, 30), "javascript:x")]) == ("Safe link tail\n", ["invalid_link_skipped"])


def rule(kind, *box):
    return kind, pdf.Box(*box)


def test_ruled_table():
    grid = [rule("line", x, 10, x, 90) for x in (10, 100, 190)] + [rule("line", 10, y, 190, y) for y in (10, 50, 90)]
    rows = [("a", 20, 20), ("b", 110, 20), ("c", 20, 60), ("d", 110, 60)]
    assert page(rows, grid) == ("| a | b |\n| --- | --- |\n| c | d |\n", [])
    boxes = [rule("rectangle", x, y, x + 90, y + 40) for x in (10, 100) for y in (10, 50)]
    assert page(rows, boxes)[0].startswith("| a | b |")
    assert page(rows, grid[:-1])[0].count("|") == 0
    assert "table_degraded" in page([*rows, ("over the rule", 70, 70)], grid)[1]


def test_borderless_tables():
    numbers = [("Key", 20, 20), ("Amount", 120, 20), ("one", 20, 40), ("1", 120, 40), ("two", 20, 60), ("2.5", 120, 60)]
    assert page(numbers) == ("| Key | Amount |\n| --- | --- |\n| one | 1 |\n| two | 2.5 |\n", [])
    words = lambda pitch: [(t, x, 20 + pitch * i) for i, r in enumerate((("A", "B"), ("c", "d"), ("e", "f"))) for t, x in zip(r, (20, 120))]
    assert page(words(13))[0].startswith("| A | B |") and "table_degraded" in page(words(20))[1]


def test_boxes_of_words_and_sizes():
    x = pdf.page_lines([glyphs("ab", 20, 20), glyphs("cd", 33, 21)], pdf.STANDARD)[0]
    assert x.text == "ab cd" and [s[:2] for s in x.spans] == [(0, 1), (1, 2), (3, 4), (4, 5)] and x.after(3).text == "cd"
    assert lines(("a", 20, 20), ("b", 26, 20), ("c", 40, 20))[0].text == "ab c"
    with pytest.raises(ValueError):
        pdf.Heuristics(word_gap_ratio=float("nan"))


SCHEMA = "doc_id string, page int, idx int, text string, l double, t double, r double, b double, font_size double, font_weight int"


def tables(spark, placed, images=()):
    """placed: (doc, page, glyphs)."""
    rows = [(d, p, i, g.text, *map(float, (g.box.l, g.box.t, g.box.r, g.box.b, g.size)), g.weight) for d, p, gs in placed for i, g in enumerate(gs)]
    pages = sorted({(d, p, 300.0, 400.0) for d, p, _ in placed})
    frame = spark.createDataFrame
    return (
        frame(pages, "doc_id string, page int, width double, height double"), pdf.with_words(frame(rows, SCHEMA)), frame([], "doc_id string, page int, kind string, l double, t double, r double, b double"),
        frame([], "doc_id string, page int, l double, t double, r double, b double, target string"),
        frame(list(images), "doc_id string, page int, idx int, l double, t double, r double, b double, px_w int, px_h int, rgba binary"),
    )


def typeset(*rows):
    return [g for r in rows for g in [*glyphs(*r), *glyphs("\n", 290, r[2])]]


def test_documents(spark):
    one = typeset(("Quarterly  Report", 20, 5), ("Body text", 20, 100), ("Confidential", 20, 380))
    two = typeset(("quarterly Report", 20, 6), ("More text", 20, 100), ("Confidential", 20, 379))
    picture = ("a", 2, 0, 20.0, 50.0, 60.0, 90.0, 1, 1, bytearray(b"\1\2\3\4"))
    t = tables(spark, [("a", 1, one), ("a", 2, two), ("b", 1, typeset(("only", 20, 5))), ("c", 1, glyphs(" ", 0, 0))], [picture])
    out = {r.doc_id: r for r in pdf.reconstruct(*t).collect()}
    assert out["a"].markdown == "Body text\n\n![](image-001.png)\n\nMore text\n" and out["a"].page_count == 2 and [w.code for w in out["a"].warnings] == ["missing_image_alt"]
    assert out["b"].markdown == "only\n" and out["c"].error_code == "ocr_required"
    limited = pdf.reconstruct(*t, limits=pdf.Limits(pages=1)).where("doc_id = 'a'").first()
    assert (limited.status, limited.error_code, limited.markdown) == ("error", "limit_exceeded", None)
    shown = pdf.numbered_images(t[4], pdf.blocks(pdf.lines(t[0], t[1]).crossJoin(spark.range(1).selectExpr("float(10) as body")), t[2], t[3]))
    assert bytes(pdf.image_assets(shown).first().data).startswith(b"\x89PNG")


def test_recognition_policy(spark):
    t = tables(spark, [("a", 1, typeset(("Hello", 20, 20))), ("a", 2, glyphs(" ", 0, 0))], [("a", 1, i, 0.0, 0.0, s, s, px, px, None) for i, (s, px) in enumerate([(100.0, 128), (100.0, 127), (30.0, 128), (100.0, 63)])])
    assert [r.page for r in pdf.pages_to_recognise(t[0], t[1]).collect()] == [2]
    assert [r.idx for r in pdf.images_to_recognise(t[0], t[4]).collect()] == [0]
    found = spark.createDataFrame([("a", 1, 0, "HELLO!", 20.0, 20.0, 45.0, 30.0), ("a", 1, 1, "new", 100.0, 100.0, 120.0, 110.0), ("a", 1, 2, "--", 0.0, 0.0, 1.0, 1.0)], "doc_id string, page int, ord int, text string, l double, t double, r double, b double")
    assert [r.text for r in pdf.new_recognised_lines(found, t[1]).collect()] == ["new"]


@pytest.mark.parametrize("rotation,expected", [(0, (10, 60, 20, 80)), (90, (20, 10, 40, 20)), (180, (180, 20, 190, 40)), (270, (60, 180, 80, 190))])
def test_rotation(spark, rotation, expected):
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.expr("named_struct('l', 15.0, 't', 45.0, 'r', 25.0, 'b', 25.0)").alias("rect"))
    got = df.select(pdf.placed("rect", F.lit(5), F.lit(5), F.lit(200), F.lit(100), F.lit(rotation)).alias("x")).first().x
    assert (got.l, got.t, got.r, got.b) == expected
