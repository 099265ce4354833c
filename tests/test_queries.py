"""Every registered query with SQL agrees with DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from veldmark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name, tmp_path):
    got = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got.write.parquet(str(tmp_path / "out"))
    want = db.sql(sql)
    cols = ", ".join(f'"{c}"' for c in sorted(want.columns))
    assert sorted(got.columns) == sorted(want.columns)
    mine = db.sql(f"select {cols} from '{tmp_path}/out/*.parquet'").fetchall()
    theirs = db.sql(f"select {cols} from want").fetchall()
    assert sorted(map(repr, mine)) == sorted(map(repr, theirs))


def test_stream(spark, tmp_path):
    from veldmark.streaming import spool

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>x")
    q = spool.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.markdown for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["x\n"]
