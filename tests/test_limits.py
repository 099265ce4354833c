"""Files over the limit of bytes are rows with an error, and their content is not read."""

import pytest

from veldmark.sources import documents
from veldmark.streaming import spool

ERROR = ("error", "limit_exceeded", "limit input_bytes exceeded: actual 21, maximum 20", None)


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("a.html", 5), ("b.html", 20), ("c.html", 21), ("d.pdf", 21)):
        (tmp_path / "in" / name).write_text("<p>" + "x" * (n - 3))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 20)  # reading more fails
    yield tmp_path
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def by_name(rows):
    return {r.doc_id.rsplit("/", 1)[1]: (r.status, r.error_code, r.error_message, r.markdown) for r in rows}


EXPECTED = {"a.html": ("ok", None, None, "xx\n"), "b.html": ("ok", None, None, "x" * 17 + "\n"), "c.html": ERROR, "d.pdf": ERROR}


def test_scan(spark, folder):
    got = documents.convert(documents.scan(spark, str(folder / "in"), 20)).collect()
    assert len(got) == 4 and by_name(got) == EXPECTED


def test_spool_over_restarts(spark, folder):
    for name in (None, "e.html"):
        if name:
            (folder / "in" / name).write_text("y" * 21)
        q = spool.start(spark, str(folder / "in"), str(folder / "out"), str(folder / "cp"), per_batch=2, max_bytes=20)
        assert q.awaitTermination(120)
    got = spark.read.parquet(str(folder / "out")).collect()
    assert len(got) == 5 and by_name(got) == {**EXPECTED, "e.html": ERROR}
