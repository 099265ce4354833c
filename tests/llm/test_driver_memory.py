"""What the driver holds while it fits the toxicity model, and after."""

import random
import tracemalloc

from veldmark.llm import common, op10_toxicity


def test_token_sets_are_held_as_numbers():
    rnd = random.Random(2)
    vocabulary = [f"word{i}" for i in range(5000)]
    texts = [" ".join(rnd.sample(vocabulary, 300)) for _ in range(1000)]
    tracemalloc.start()
    bags = op10_toxicity.Bags(texts)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 4 << 20  # as sets of shared strings about 17 MB
    assert len(bags) == 1000 and all(set(b) == op10_toxicity.tokens(t) for b, t in zip(bags, texts))


def test_training_gives_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda own=common.give_back: given.append(own()))
    docs = spark.createDataFrame([(i, "zgrumpf an" if i % 2 else "the on") for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    assert op10_toxicity.train(docs, labels) is not None and given == [None]
