"""Publication, envelopes, snapshots and cancelled runs."""

import hashlib
import json
import time

import pytest

from tests import packages as k
from veldmark.operators.errors import FormatError
from veldmark.sinks import publish as sink
from veldmark.sources import documents, runs


def asset(name, data=b"abc"):
    return {"asset_id": name, "file_name": name, "media_type": "image/png", "sha256": hashlib.sha256(data).hexdigest(), "data": data}


def code(f, *args):
    with pytest.raises(FormatError) as e:
        f(*args)
    return e.value.code


def test_publish(tmp_path):
    out = sink.Folder(f"file://{tmp_path}")
    paths = out.publish("foo.md", "# x\n", [asset("z.png"), asset("a.png", b"")], False)
    assert paths == (f"{tmp_path}/foo.md", f"{tmp_path}/foo.assets") and (tmp_path / "foo.md").read_text() == "# x\n"
    listed = json.loads((tmp_path / "foo.assets" / sink.MANIFEST).read_text())
    assert [a["file_name"] for a in listed["assets"]] == ["a.png", "z.png"] and listed["assets"][1]["sha256"].startswith("ba7816bf")
    assert out.publish("foo.md", "# x\n", [asset("z.png"), asset("a.png", b"")], False) == paths  # the same again
    assert code(out.publish, "foo.md", "other", [], False) == "output_exists"
    (tmp_path / "foo.assets" / "extra").write_text("")
    assert code(out.publish, "foo.md", "other", [], True) == "unowned_assets"
    (tmp_path / "foo.assets" / "extra").unlink()
    assert out.publish("foo.md", "other", [], True) == (f"{tmp_path}/foo.md", None)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["foo.md"]
    (tmp_path / "bar.assets").mkdir()
    assert code(out.publish, "bar.md", "x", [asset("a.png")], True) == "unowned_assets"
    (tmp_path / "bar.assets" / sink.MANIFEST).write_text("{")
    assert code(out.publish, "bar.md", "x", [asset("a.png")], True) == "invalid_manifest"


def test_failed_move_is_undone(tmp_path, monkeypatch):
    out = sink.Folder(f"file://{tmp_path}")
    out.publish("a.md", "old", [asset("p.png")], False)

    class Broken:
        def __getattr__(self, name):
            return getattr(real, name)

        def move(self, a, b):
            if a.endswith("new.md"):
                raise OSError("full")
            real.move(a, b)

    real, out.fs = out.fs, Broken()
    assert code(out.publish, "a.md", "new", [asset("q.png")], True) == "output_io"
    assert (tmp_path / "a.md").read_text() == "old" and (tmp_path / "a.assets" / "p.png").exists() and sorted(p.name for p in tmp_path.iterdir()) == ["a.assets", "a.md"]


@pytest.mark.parametrize("name", ["", ".", "..", "a/b", "a\\b", "a:b", "a.", "a ", "a\n", "a\x7f", "con", "AUX.txt", "nul .x", "com1", "lpt¹", sink.MANIFEST.upper()])
def test_unsafe_names(name):
    assert code(sink.check_assets, [name]) == "invalid_asset_name"


def test_names_and_targets():
    sink.check_assets(["a.png", "con1.png", "com10", "．x"])
    for pair in (["Image.PNG", "image.png"], ["é.png", "é.png"], ["ﬁ", "fi"]):
        assert code(sink.check_assets, pair) == "duplicate_asset_name"
    assert sink.check_target("/o/x.md", "/i/x.html", "/o/x.assets/") == ("/o/x.md", "/o/x.assets")
    for bad in ("/o/x.MD", "/o/x.txt", "/o/", "/o/.md", "/o/con.md"):
        assert code(sink.check_target, bad) == "invalid_output"
    assert code(sink.check_target, "/o/x.md", "/o/x.assets/in.html") == "source_output_alias"
    assert code(sink.check_target, "/o/x.md", None, "/o/y.assets") == "invalid_assets_path"


def test_publish_rows(spark, tmp_path):
    rows = [("1", "in/a.png", None, bytearray(k.png())), ("2", "in/b.csv", None, bytearray(b"a,b\n1,2")), ("3", "in/c.pdf", None, bytearray(b"x"))]
    made = documents.convert(spark.createDataFrame(rows, "doc_id string, path string, source_url string, content binary"), asset_prefix="{stem}.assets")
    named = made.selectExpr("*", "element_at(array('a.md', 'b.md', 'c.md'), int(doc_id)) as name")
    got = {r.doc_id: r for r in sink.publish(named, f"file://{tmp_path}/out").collect()}
    assert [got[i].error_code for i in "123"] == [None, None, "format_conflict"] and got["2"].assets_path is None
    assert (tmp_path / "out" / "a.md").read_text() == "![a.png](a.assets/image-001.png)\n" and (tmp_path / "out" / "a.assets" / "image-001.png").read_bytes() == k.png()
    said = {r.doc_id: (json.loads(r.envelope), r.exit_code) for r in sink.envelope(made).collect()}
    assert said["2"][0]["metadata"]["source_format"] == "csv" and "error" not in said["2"][0] and said["2"][1] == 0
    assert said["3"] == ({"schema_version": sink.ENVELOPE_SCHEMA, "status": "failed", "metadata": {}, "warnings": [], "error": {"code": "format_conflict", "message": documents.MESSAGES["format_conflict"]}}, 3)


def test_snapshots(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n)
    rows = [tuple(r) for r in runs.snapshot(spark, str(tmp_path)).collect()]
    before = spark.createDataFrame(rows, "path string, length long, modificationTime timestamp")
    (tmp_path / "a").write_text("longer")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("d")
    got = {r.path[-1]: r.error_code for r in runs.changed(before, runs.snapshot(spark, str(tmp_path))).collect()}
    assert got == {"a": "input_changed", "b": "input_missing", "d": "input_new"}


def test_cancelled_runs(spark):
    assert runs.cancellable(spark, lambda: spark.range(3).count(), lambda: False) == 3
    assert code(runs.cancellable, spark, lambda: 1, lambda: True) == "cancelled"
    began = time.time()
    slow = lambda: spark.range(4).repartition(4).mapInPandas(_sleep, "id long").count()
    assert code(runs.cancellable, spark, slow, lambda: time.time() > began + 1.5) == "cancelled"
    assert time.time() - began < 25


def _sleep(frames):
    for f in frames:
        time.sleep(30)
        yield f
