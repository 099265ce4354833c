"""Words to lines: filters, keys, order, confidence and boxes."""

import pytest

from veldmark.operators import ocr

COLUMNS = "doc_id string, image_width long, image_height long, level int, page int, block int, par int, line int, word int, left long, top long, width long, height long, conf double, text string"


def lines(spark, *words):
    rows = [(doc, 200, 100, level, *key, word, *box, conf, text) for doc, level, key, word, box, conf, text in words]
    return ocr.lines(spark.createDataFrame(rows, COLUMNS)).orderBy("doc_id", "position").collect()


def test_lines(spark):
    a, b, c = (1, 1, 1, 1), (1, 1, 2, 1), (1, 2, 1, 1)
    got = lines(
        spark,
        ("d", 5, a, 2, (60, 52, 30, 8), 70.0, "\u2003two\t"), ("d", 5, a, 1, (20, 50, 30, 12), 90.0, "one"),
        ("d", 4, a, 0, (0, 0, 200, 100), 50.0, "level"), ("d", 5, a, 3, (0, 0, 9, 9), 50.0, " \n"), ("d", 5, a, 4, (0, 0, 9, 9), -1.0, "unsure"),
        ("d", 5, a, 5, (0, 0, 9, 9), float("nan"), "nan"), ("d", 5, a, 6, (0, 0, 9, 9), float("inf"), "inf"), ("d", 5, a, 7, (200, 0, 9, 9), 50.0, "outside"), ("d", 5, a, 8, (0, 0, 0, 9), 50.0, "empty"),
        ("d", 5, b, 1, (190, 10, 50, 200), 150.0, "right"), ("d", 5, c, 1, (5, 10, 10, 10), 40.0, "left"),
        ("e", 5, a, 1, (0, 0, 1, 1), 0.0, "other"),
    )
    assert [(r.doc_id, r.position, r.text, r.n_words, r.status) for r in got] == [("d", 1, "left", 1, "ok"), ("d", 2, "right", 1, "ok"), ("d", 3, "one two", 2, "ok"), ("e", 1, "other", 1, "ok")]
    assert [r.confidence for r in got] == pytest.approx([0.4, 1.0, 0.8, 0.0])
    assert [(r.left, r.top, r.right, r.bottom) for r in got[:3]] == [(5, 10, 15, 20), (190, 10, 200, 100), (20, 50, 90, 62)]
    assert tuple(got[2].bounds) == pytest.approx((0.1, 0.5, 0.35, 0.12))
    assert [(r.page, r.block, r.par, r.line) for r in got[:3]] == [c, b, a]


def test_bad_number_fails_the_image(spark):
    a = (1, 1, 1, 1)
    for bad in (("d", 5, a, 2, (None, 0, 5, 5), 90.0, "x"), ("d", 5, a, 2, (0, -1, 5, 5), 90.0, "x"), ("d", 5, a, 2, (0, 0, 5, 5), None, "x"), ("d", 5, (1, None, 1, 1), 2, (0, 0, 5, 5), -1.0, "x")):
        got = lines(spark, ("d", 5, a, 1, (0, 0, 5, 5), 90.0, "fine"), bad, ("e", 5, a, 1, (0, 0, 5, 5), 90.0, "fine"))
        assert [(r.doc_id, r.status, r.error_code, r.text) for r in got] == [("d", "error", "recognition_failed", None), ("e", "ok", None, "fine")]
    assert lines(spark, ("d", 5, a, 1, (None, 0, 5, 5), 90.0, "  "), ("d", 5, a, 2, (0, 0, 5, 5), 90.0, "fine"))[0].text == "fine"
