"""Best-fit-decreasing packing of documents into token sequences.

Lengths are whole numbers up to the capacity, so the order of work of best-fit decreasing is fixed
by the number of pieces of each length. The plan is therefore made once, exactly, for the whole
corpus from a histogram with at most ``capacity`` rows: a segment tree over the remaining
capacities gives the tightest open bin in logarithmic time, and a run of equal pieces goes to all
bins of that kind at once. Pieces then find their place from their rank among the pieces of their
length. No task holds the corpus; what is broadcast depends on the capacity alone, not on the data.

Null text counts as empty (a document of the end id alone), repeated rows are documents of their
own, an empty table gives an empty result. Further columns of the input are not carried.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.llm import common, tokens

PIECES = "row long, doc_id long, piece int, start long, length long, ids binary"
#: Offsets of partitions are broadcast up to so many rows of 16 bytes; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


class TightestFit:
    """Segment tree over remaining capacities 0..n: how many bins kinds are open in each range."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, change: int) -> None:
        i = self.size + capacity
        while i:
            self.open[i] += change
            i >>= 1

    def at_least(self, need: int) -> int | None:
        """The smallest open capacity that is ``need`` or more."""
        i = self.size + need
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, number of pieces, pieces per bin, first bin, offset in the bin).

    The piece of rank ``r`` among those of its length goes, with ``k = r - first rank``, to bin
    ``first bin + k // per bin`` at ``offset + k % per bin * length``.
    """
    tree, runs, rows, bins = TightestFit(capacity), defaultdict(list), [], 0

    def put(first: int, count: int, left: int) -> None:
        if count and left:
            runs[left].append((first, count))
            tree.add(left, 1)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.at_least(length)
            if left is None:
                left, per = capacity, capacity // length
                first, count = bins, -(-todo // per)
                bins += count
            else:
                (first, count), per = runs[left].pop(), left // length
                tree.add(left, -1)
            whole = min(count, todo // per)
            if whole:
                rows.append((length, rank, whole * per, per, first, capacity - left))
                put(first, whole, left - per * length)
                rank, todo = rank + whole * per, todo - whole * per
            if todo and whole < count:
                rows.append((length, rank, todo, todo, first + whole, capacity - left))
                put(first + whole, 1, left - todo * length)
                whole, todo = whole + 1, 0
            put(first + whole, count - whole, left)
    return rows


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Token ids of every document with the end id, cut where longer than the capacity; the first piece takes the rest.

    ``k`` counts the pieces of the same length before it in the same partition.
    """

    def cut(frames):
        words, seen = tokens.cache(path, True), Counter()
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in common.batches(frames, 2500, 4_000_000):
            out = []
            for row, doc, data in zip(pdf["row"], pdf["doc_id"], words.encode(pdf["text"].fillna("").tolist())):
                data += end
                n, at, piece = len(data) // 4, 0, 0
                while at < n:
                    size = min(n, (n - at) % capacity or capacity)
                    out.append((row, doc, piece, at, size, data[4 * at : 4 * (at + size)], seen[size]))
                    seen[size] += 1
                    at, piece = at + size, piece + 1
            df = pd.DataFrame(out, columns=["row", "doc_id", "piece", "start", "length", "ids", "k"])
            yield df.astype({"doc_id": "Int64", "piece": "int32"})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(cut, PIECES + ", k long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its ids, its sequence and its offset there.

    Returns row, doc_id, piece, start, length, ids (little-endian uint32), sequence_id, offset.
    """
    spark = common.lean(docs).sparkSession
    scratch = common.Scratch(spark, "pack")
    made = scratch.save(pieces(docs, path or common.default_path("byte_bpe_50k.json"), capacity, end_id).withColumn("part", F.spark_partition_id()), "pieces")
    counts = scratch.save(made.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    steps = spark.createDataFrame(plan(histogram, capacity) or [(0,) * 6], "length long, first long, n long, per long, bin long, at long")
    before = counts.select("part", "length", F.expr("sum(n) over (partition by length order by part) - n").alias("before"))
    before = before.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    joined = made.join(before, "part").withColumn("rank", F.expr("k + before[length]")).drop("before", "k", "part")

    place = joined.join(F.broadcast(steps), "length").where("rank >= first and rank < first + n")  # rows of the plan: bound by the capacity
    return place.select(
        "row", "doc_id", "piece", "start", "length", "ids",
        F.expr("bin + (rank - first) div per").alias("sequence_id"), F.expr("at + (rank - first) % per * length").alias("offset"),
    )


def digest(packed: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; the checksum is taken from the packed ids."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(common.table(spark, sf_dir, "documents")))
