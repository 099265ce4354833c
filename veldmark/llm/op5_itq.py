"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation of the principal axes is learned that makes the signs of the rotated vectors lose least
(Procrustes steps on a bounded sample). Each vector gets a code of ``bits`` bits. The code is cut into ``tables``
parts; two codes within Hamming distance ``tables * 2 - 1`` agree in one part up to one bit, so every vector is entered
once in each table and looked up with its part and all parts one bit away. Of the tables in which a pair
meets only the first counts, and pairs within the distance are reranked with the original vectors in double
precision. Equal vectors are one node; their copies are counted, not paired.

Vectors of each length have a rotation and tables of their own. The sample has at most ``sample`` vectors of a length, the
first by a hash; all vectors are coded and looked up. Recall is measured against brute force in tests/llm/test_op5.py (0.9 is asked for).
Vectors that are null, zero or hold null or non-finite components, and rows without
label, link with nothing. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.llm import common


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) such that the signs of ``(x - mean) @ projection`` are balanced codes."""
    mean = x.mean(0)
    spread = np.atleast_2d(np.cov((x - mean).T)) if len(x) > 1 else np.zeros((x.shape[1],) * 2)
    values, vectors = np.linalg.eigh(spread + 1e-12 * np.eye(x.shape[1]))
    axes = vectors[:, np.argsort(-values)[: min(bits, x.shape[1])]]
    v = (x - mean) @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ wt).T
    return mean, axes @ r


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, label, embedding) that can link: a label and finite components that are not all zero."""
    fine = "label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    return vectors.where(fine)


CODES = "node long, label string, code long, vector array<double>"


def near_pairs(nodes: DataFrame, threshold: float, bits: int, tables: int, sample: int, scratch: common.Scratch) -> DataFrame:
    """(a, b) of ``nodes`` (node, label, vector; vectors of one length) whose cosine reaches the threshold."""
    taken = nodes.orderBy(F.xxhash64("node")).limit(sample).select("vector").toPandas()["vector"]
    if not len(taken):
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    dim = len(taken[0])
    mean, projection = learn_rotation(np.array([v / np.linalg.norm(v) for v in taken]), bits)
    n = projection.shape[1]
    tables = min(tables, n)
    part = n // tables

    def code(frames):
        weights = np.uint64(1) << np.arange(n, dtype=np.uint64)
        for pdf in frames:
            if len(pdf):
                x = np.array(pdf["vector"].tolist())
                big = np.abs(x).max(1, keepdims=True)
                x = x / big / np.linalg.norm(x / big, axis=1, keepdims=True)
                codes = ((x - mean) @ projection >= 0) @ weights
                yield pd.DataFrame({"node": pdf["node"], "label": pdf["label"], "code": codes.astype(np.uint64).view(np.int64), "vector": list(x)})

    coded = scratch.save(nodes.mapInPandas(code, CODES), f"codes-{dim}")
    key = f"shiftrightunsigned(code, {part} * t) & {(1 << part) - 1}L"
    entered = coded.select("node", "label", "code", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t")).withColumn("k", F.expr(key))
    asked = entered.withColumn("k", F.explode(F.expr(f"concat(array(k), transform(sequence(0, {part - 1}), i -> k ^ shiftleft(1L, i)))")))
    x, y = asked.alias("x"), entered.alias("y")
    differ = F.col("x.code").bitwiseXOR(F.col("y.code"))
    first = " and ".join(f"(x.t <= {t} or bit_count((shiftrightunsigned(x.code ^ y.code, {part * t})) & {(1 << part) - 1}L) > 1)" for t in range(tables - 1)) or "true"
    met = x.join(
        y,
        (F.col("x.label") == F.col("y.label")) & (F.col("x.t") == F.col("y.t")) & (F.col("x.k") == F.col("y.k"))
        & (F.col("x.node") < F.col("y.node")) & (F.bit_count(differ) <= 2 * tables - 1) & F.expr(first),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    one = coded.select(F.col("node").alias("a"), F.col("vector").alias("va"))
    two = coded.select(F.col("node").alias("b"), F.col("vector").alias("vb"))

    def rerank(frames):
        for pdf in frames:
            if len(pdf):
                u, v = np.array(pdf["va"].tolist()), np.array(pdf["vb"].tolist())
                cosine = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1))
                yield pdf.loc[cosine >= threshold, ["a", "b"]]

    return met.join(one, "a").join(two, "b").mapInPandas(rerank, "a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, bits: int = 64, tables: int = 4, sample: int = 20_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    scratch = common.Scratch(vectors.sparkSession, "itq")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.expr("transform(embedding, x -> double(x) + 0D)").alias("embedding"))
    rows = common.numbered(base, "row")
    fine = usable(rows)
    nodes = fine.groupBy("label", "embedding").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    nodes = scratch.save(nodes.withColumnRenamed("embedding", "vector"), "nodes")
    lengths = [r["length"] for r in nodes.groupBy(F.size("vector").alias("length")).count().where("count > 1").orderBy("length").collect()]
    found = [near_pairs(nodes.where(F.size("vector") == n).select("node", "label", "vector"), threshold, bits, tables, sample, scratch) for n in lengths]
    none = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    pairs = scratch.save(reduce(DataFrame.unionAll, found) if found else none, "pairs")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = nodes.select("node", "copies")
    links = both.join(copies.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("copies").alias("linked"))
    found = common.connected_components(pairs, scratch)
    full = nodes.join(links, F.col("node") == F.col("a"), "left").join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    full = full.select("label", "vector", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    named = rows.join(full, (rows["label"] == full["label"]) & (rows["embedding"] == full["vector"]), "left").select("row", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "row").alias("c"))
    named = scratch.save(named, "named")
    low = named.groupBy("c").agg(F.min("vec_id").alias("component_id"))
    return named.join(low, "c").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
