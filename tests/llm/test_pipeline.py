"""The pipeline and its stages on a small corpus with expected rows."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from veldmark.llm import common, tokens  # noqa: E402

KEY = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"


def words(seed, n=40):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))


def test_run(spark, tmp_path):
    item = words(99, 20)
    texts = {1: words(1), 2: words(1), 3: words(1) + " more", 4: words(4) + " " + item, 5: f'{words(5)} token = "{KEY}" end', 6: "", 7: words(7)}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda name: sorted(r.doc_id for r in stage[name](spark, docs, str(tmp_path)).collect())
    assert ids("toxicity") == [1, 2, 3, 4, 5, 6, 7]  # no toxic label: nothing goes
    assert ids("near_duplicates") == [1, 4, 5, 6, 7]
    assert ids("decontamination") == [1, 2, 3, 5, 6, 7]
    clean = texts[5].replace(KEY, "[secret]")
    assert {r.doc_id: (r.text, r.n_chars) for r in stage["secrets"](spark, docs, str(tmp_path)).collect()} == {i: (clean, len(clean)) if i == 5 else (t, len(t)) for i, t in texts.items()}
    cache = tokens.WordCache(common.default_path("byte_bpe_50k.json"), True)
    want = {i: [*cache.tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in {**texts, 5: clean}.items() if i in (1, 5, 6, 7)}
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length").collect()
    assert sorted(tuple(r) for r in got) == sorted((i, 0, len(t)) for i, t in want.items())


def test_stages_run_with_bounded_batches(spark, tmp_path):
    rows = [(i, words(i), "en", "s", 1) for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(99, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, own = spark.read.parquet(f"{tmp_path}/documents.parquet"), {k: spark.conf.get(k, None) for k in corpus_pipeline.BOUNDS}
    try:
        for name, stage in corpus_pipeline.STAGES:
            for k, v in own.items():
                spark.conf.set(k, v) if v else spark.conf.unset(k)
            assert stage(spark, docs, str(tmp_path)).count() == 4, name
            assert {k: spark.conf.get(k) for k in own} == corpus_pipeline.BOUNDS, name
    finally:
        for k, v in own.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
