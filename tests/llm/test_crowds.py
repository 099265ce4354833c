"""Passages that many documents share, and what a similar pair must have in common in the index."""

import random

from veldmark.llm import common, op9_jaccard


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("monotonically_increasing_id() as row", "doc_id", "text").localCheckpoint()


def similar(a, b, percent):
    return 100 * len(a & b) >= percent * len(a | b)


def test_similar_sets_share_the_entries_that_both_need(spark):
    rnd, texts = random.Random(3), []
    for size in (3, 6, 11, 14, 20, 24, 38, 45, 70, 75, 120, 130, 210, 230, 380, 400, 670, 700):
        for _ in range(6):
            base = rnd.sample(range(10**6), size)
            for _ in range(4):
                few = rnd.randint(0, size // 6)
                v = base[: size - rnd.randint(0, few)]
                v[:few] = rnd.sample(range(10**6), few)
                texts.append(" ".join(f"w{x}" for x in v))
    texts = list({frozenset(t.split()): t for t in texts}.values())  # of copies one leaves entries
    sets = [op9_jaccard.shingles(t, 1) for t in texts]
    frame = rows_of(spark, texts)
    at = {r.row: r.doc_id for r in frame.collect()}
    found, entries, needs = op9_jaccard.index(frame, 1, 80).collect(), {}, {}
    for r in found:
        if r.entry is None:
            needs[at[r.row]] = (r.even, r.odd)
        else:
            entries.setdefault(at[r.row], set()).add(r.entry)
    checked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if a != sets[j] and similar(a, sets[j], 80):
                both = entries.get(i, set()) & entries.get(j, set())
                of = [sum(e & 1 == bit for e in both) for bit in (0, 1)]
                assert any(0 < max(needs[i][bit], needs[j][bit]) <= of[bit] for bit in (0, 1))
                checked += max(max(needs[i]), max(needs[j])) > 2
    assert checked > 100


def test_shared_passages_bring_few_pairs_together(spark, monkeypatch):
    """200 documents with one passage: the last round once compared every two of them."""
    rnd, texts = random.Random(5), []
    passage = " ".join(f"p{x}" for x in range(130))
    for i in range(200):
        own = " ".join(f"w{rnd.randrange(10**9)}" for _ in range(60))
        texts.append(f"{own} {passage}")
        if i % 20 == 0:
            texts.append(f"{own} {passage} more")
    saved, save = {}, common.Scratch.save

    def record(self, df, name):
        out = save(self, df, name)
        if name == "sized":
            saved[name] = [r["count"] for r in out.groupBy("entry").count().collect()]
        return out

    monkeypatch.setattr(common.Scratch, "save", record)
    frame = rows_of(spark, texts)
    out = {r.doc_id: r.component_id for r in op9_jaccard.components(frame, 5, 80).collect()}
    sets = [op9_jaccard.shingles(t, 5) for t in texts]
    expected = {i: min(j for j in range(len(sets)) if similar(sets[i], sets[j], 80)) for i in range(len(sets))}
    assert out == expected and len(set(out.values())) == 200
    assert sum(n * (n - 1) // 2 for n in saved.get("sized", [])) < 500


def test_rarest_shingles_of_similar_sets_meet(spark):
    """Sets of few frequent words, so that orders by frequency have many ties."""
    rnd = random.Random(8)
    words = [f"w{x}" for x in range(60)]
    texts = [" ".join(rnd.sample(words, rnd.randint(1, 40))) for _ in range(80)]
    for t in texts[:40]:
        w = t.split()
        texts.append(" ".join(w[: len(w) - len(w) // 8]))
    frame = rows_of(spark, texts)
    sets, at = [op9_jaccard.shingles(t, 1) for t in texts], {r.row: r.doc_id for r in frame.collect()}
    nodes = spark.createDataFrame([(row, len(sets[i])) for row, i in at.items()], "node long, n long")
    entries = {}
    for r in op9_jaccard.prefixes(frame.select("row", "text"), nodes, 1, 80, common.Scratch(spark, "test")).collect():
        entries.setdefault(at[r.node], set()).add(r.entry)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j], 80)]
    assert len(pairs) > 30 and all(entries[i] & entries[j] for i, j in pairs)
    assert all(len(e) <= len(sets[i]) - (80 * len(sets[i]) + 99) // 100 + 1 for i, e in entries.items())
