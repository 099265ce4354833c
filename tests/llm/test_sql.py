"""Every SQL of the corpus operators agrees with its query on the small tables."""

import glob
import os

import duckdb
import pytest

queries = pytest.importorskip("veldmark.llm.queries")

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name, tmp_path):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = queries.queries()[name](spark, SF)
    got.write.parquet(str(tmp_path / "out"))
    want = db.sql(queries.oracle_sql()[name])
    cols = ", ".join(f'"{c}"' for c in sorted(want.columns))
    assert sorted(got.columns) == sorted(want.columns)
    mine = db.sql(f"select {cols} from '{tmp_path}/out/*.parquet'").fetchall()
    theirs = db.sql(f"select {cols} from want").fetchall()
    assert mine and sorted(map(repr, mine)) == sorted(map(repr, theirs))
