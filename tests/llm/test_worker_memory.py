"""What the workers of the near-duplicate join hold at a time."""

import numpy as np
import pandas as pd

from veldmark.llm import common, op9_jaccard

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_entries_of_a_part_come_in_frames_of_bounded_rows():
    rnd = np.random.default_rng(3)
    low = rnd.choice(1 << 30, 120_000, replace=False).astype(np.uint64)
    frames = [f for first in (0, 500_000) for f in op9_jaccard.blocks(low, np.arange(first, first + len(low)), 1)]
    found = list(op9_jaccard.meetings([pd.concat(frames, ignore_index=True)]))
    assert max(map(len, found)) <= 50_000  # one frame of 240,000 rows before
    all_ = pd.concat(found)
    expected = {(int(e), first + i) for first in (0, 500_000) for i, e in enumerate(low)}
    assert set(zip(all_["entry"].astype(int), all_["row"].astype(int))) == expected and len(all_) == len(expected)


def test_join_runs_with_small_batches_and_leaves_the_session_its_own(spark, monkeypatch):
    seen, own = [], op9_jaccard.index
    monkeypatch.setattr(op9_jaccard, "index", lambda *a: seen.append(spark.conf.get(BATCH)) or own(*a))
    docs = spark.createDataFrame([(i, i, f"a b c d e{i // 2}") for i in range(6)], "row long, doc_id long, text string")
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, str(5 << 20))
        rows = op9_jaccard.components(docs, 3, 90).collect()
        assert seen == [str(2 << 20)] and spark.conf.get(BATCH) == str(5 << 20)
        assert {r["doc_id"]: r["component_id"] for r in rows} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}
        with common.batch_bytes(spark, 9 << 20):
            assert spark.conf.get(BATCH) == str(5 << 20)
    finally:
        spark.conf.set(BATCH, before)
