"""Quality by an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

One pass over the documents counts, in each task, the distinct n-grams of all texts and those of trusted
texts. The counts are summed, lower orders are continuation counts, and the probabilities of all
n-grams asked for come from joins with the counts and context totals of each order, all keyed and sharded by
(language, n-gram); nothing is broadcast but discounts (a row for a language and order). Each task then gets back the
probabilities of its own n-grams, keeps them as sorted 64-bit keys, and scores its documents. A document's perplexity is compared with a quantile of the trusted
documents of its language; a tenth of these, by a hash, is kept out of the counts for that.

A null language is one of its own. Null and empty texts have no n-grams, a null perplexity, and are kept, as is
every document of a language without trusted text. A language whose trusted documents all miss the held-out tenth (likely
below about 20 of them) has a null threshold, and all its documents are kept too: it is not filtered. With few held-out
documents the quantile is their maximum. Copies and repeated rows are scored alike. An empty table, or one of empty texts, gives its rows
with null perplexities; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.llm import common

ORDER = 5
PAD = "\x02"
TASK_BYTES = 64 << 20
BROADCAST_LABELS = 2_000_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def keys(codes: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """64-bit keys of the n-grams that begin at these places."""
    key = np.zeros(len(at), np.uint64)
    for i in range(order):
        key = (key ^ (codes[at + i] + np.uint64(i + 1))) * _MULT[i % len(_MULT)]
        key ^= key >> np.uint64(29)
    return key


def lookup(g: pd.Series, logp: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, log-probabilities) of n-grams."""
    codes = np.frombuffer("".join(g).encode("utf-32-le"), "<u4").astype(np.uint64)
    return keys(codes, np.arange(0, len(codes), order), order), logp


def grams(texts: list[str], order: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined text, distinct keys, a position of each, number of each n-gram's key, n-grams of each text)."""
    pad = PAD * (order - 1)
    sizes = np.array([len(t) for t in texts])
    joined = "".join(pad + t for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    starts = np.cumsum(sizes + order - 1) - sizes - (order - 1)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    key = keys(codes, at, order)
    inverse, distinct = pd.factorize(key)
    first = np.zeros(len(distinct), np.int64)
    first[inverse[::-1]] = at[::-1]
    return joined, distinct, first, inverse, sizes


def _by_language(pdf: pd.DataFrame):
    for lang, part in pdf.groupby("lang", sort=False, dropna=False):
        yield lang, part


def count(docs: DataFrame, order: int) -> DataFrame:
    """(task, lang, g, n): the distinct n-grams of each task, and how often they occur in trusted texts."""

    def run(frames):
        from pyspark import TaskContext

        task, found = TaskContext.get().partitionId(), {}

        def rows():
            for lang, known in [(lang, known) for lang, known in found.items() if known]:
                yield pd.DataFrame({"task": np.full(len(known), task, "int32"), "lang": lang, "g": list(known), "n": list(known.values())})

        for pdf in common.batches(frames, 10_000, 1_200_000):
            for lang, part in _by_language(pdf):
                known = found.setdefault(lang, {})
                for trusted, some in part.groupby("trusted"):
                    joined, _, first, inverse, _ = grams(some["text"].tolist(), order)
                    counts = np.bincount(inverse) if trusted else np.zeros(len(first), np.int64)
                    for i, n in zip(first.tolist(), counts.tolist()):
                        g = joined[i : i + order]
                        known[g] = known.get(g, 0) + n
            if sum(map(len, found.values())) > 1_500_000:
                yield from rows()
                found.clear()
        yield from rows()

    return docs.mapInPandas(run, "task int, lang string, g string, n long")


def _discounts(counts: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of an order for each language, from the counts of counts."""
    out = {}
    cols = [F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    for r in counts.groupBy("lang").agg(*cols).collect():
        n1, n2, n3, n4 = (max(float(r[f"n{k}"]), 0.5) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        out[r["lang"]] = tuple(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3)))
    return out


def probabilities(asked: DataFrame, counts: DataFrame, order: int, scratch: common.Scratch) -> DataFrame:
    """(lang, g, logp) for ``asked`` (lang, g) from ``counts`` (lang, g, n) of trusted text."""
    spark = asked.sparkSession
    out = asked.withColumn("p", F.lit(0.0)).withColumn("w", F.lit(1.0))
    for k in range(order, 0, -1):
        rows = [(lang, *d) for lang, d in _discounts(counts).items()]
        disc = F.broadcast(spark.createDataFrame(rows, "lang string, d1 double, d2 double, d3 double"))
        step = F.expr("case when n = 1 then d1 when n = 2 then d2 else d3 end")
        held = counts.join(disc, "lang").withColumn("d", step)
        context = held.groupBy("lang", F.expr(f"substring(g, 1, {k - 1})").alias("ctx")).agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
        here = held.select("lang", F.col("g").alias("gk"), (F.col("n") - F.col("d")).alias("num"))
        out = out.withColumn("gk", F.expr(f"right(g, {k})")).withColumn("ctx", F.expr(f"substring(gk, 1, {k - 1})"))
        out = out.join(here, ["lang", "gk"], "left").join(context, ["lang", "ctx"], "left")
        out = out.withColumn("p", F.expr("p + w * coalesce(num / total, 0)")).withColumn("w", F.expr("w * coalesce(mass / total, 1)")).select("lang", "g", "p", "w")
        if k > 1:
            counts = scratch.save(counts.groupBy("lang", F.expr(f"right(g, {k - 1})").alias("g")).agg(F.count("*").alias("n")), f"order-{k - 1}")
    return out.select("lang", "g", F.expr("ln(p + w / 65536)").alias("logp"))


def score(docs: DataFrame, order: int, folder: str) -> DataFrame:
    """Sum of log-probabilities and number of n-grams of each document; each task reads its own table under ``folder``."""

    def run(frames):
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import TaskContext

        task, tables = TaskContext.get().partitionId(), None
        for pdf in common.batches(frames, 10_000, 1_200_000):
            if tables is None:
                system, local = fs.FileSystem.from_uri(f"{folder}/task={task}")
                tables = {}
                if system.get_file_info(local).type != fs.FileType.NotFound:  # a task of empty texts has no n-grams
                    pieces: dict = {}
                    for fragment in pq.ParquetDataset(local, filesystem=system, partitioning=None).fragments:
                        for batch in fragment.to_batches(columns=["lang", "g", "logp"], batch_size=100_000):
                            for lang, part in batch.to_pandas().groupby("lang"):
                                pieces.setdefault(lang, []).append(lookup(part["g"], part["logp"].to_numpy(), order))
                    for lang, found in pieces.items():
                        coded, logp = (np.concatenate(x) for x in zip(*found))
                        rank = np.argsort(coded)
                        tables[lang] = coded[rank], logp[rank]
            total, n = np.full(len(pdf), np.nan), np.zeros(len(pdf), np.int64)
            place = pd.Series(np.arange(len(pdf)), index=pdf.index)
            for lang, part in _by_language(pdf):
                _, distinct, _, inverse, sizes = grams(part["text"].tolist(), order)
                logp = np.zeros(0)
                if len(distinct):
                    known, values = tables[lang]
                    place_of = np.searchsorted(known, distinct)
                    if (known[np.minimum(place_of, len(known) - 1)] != distinct).any():
                        raise ValueError("a task has n-grams that it did not count")
                    logp = values[place_of]
                sums = np.concatenate([[0], np.cumsum(logp[inverse])])[np.concatenate([[0], np.cumsum(sizes)])]
                i = place[part.index].to_numpy()
                total[i], n[i] = np.diff(sums), sizes
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").array, "lang": pdf["lang"].array, "held": pdf["held"].array, "n_grams": n, "total": total})

    return docs.mapInPandas(run, "doc_id long, lang string, held boolean, n_grams long, total double")


def quality(docs: DataFrame, trusted: DataFrame, order: int = ORDER, quantile: float = 0.995) -> DataFrame:
    """(doc_id, lang, n_grams, perplexity, threshold, keep) for ``docs`` (doc_id, text, lang); ``trusted``: doc_id of trusted documents."""
    scratch = common.Scratch(common.lean(docs).sparkSession, "quality")
    ids = trusted.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct().withColumn("t", F.lit(True))
    small = trusted.count() <= BROADCAST_LABELS
    ids = F.broadcast(ids) if small else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    rows = rows.join(ids, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "text", "lang", F.expr("t is not null and pmod(xxhash64(doc_id), 10) > 0").alias("trusted"), F.expr("t is not null and pmod(xxhash64(doc_id), 10) = 0").alias("held")
    )
    if not small:
        rows = scratch.save(rows, "rows")  # the partitions of a shuffle may differ from one plan to the next
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.coalesce(max(1, -(-size // TASK_BYTES)))  # large tasks: fewer tables of mostly the same n-grams
    made = scratch.save(count(rows, order), "counts")
    every = scratch.save(made.groupBy("lang", "g").agg(F.sum("n").alias("n")), "grams")
    logp = probabilities(every.select("lang", "g"), every.where("n > 0"), order, scratch)
    folder = scratch.path("logp")
    made.select("task", "lang", "g").join(logp, ["lang", "g"]).repartition("task").write.partitionBy("task").option("compression", "zstd").parquet(folder)
    scored = scratch.save(score(rows, order, folder).withColumn("perplexity", F.expr("if(n_grams > 0, exp(-total / n_grams), null)")), "scored")
    limit = scored.where("held and perplexity is not null").groupBy("lang").agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000)).alias("threshold"))
    return scored.join(F.broadcast(limit), "lang", "left").select(
        "doc_id", F.nullif("lang", F.lit("")).alias("lang"), "n_grams", "perplexity", "threshold", F.expr("perplexity is null or threshold is null or perplexity <= threshold").alias("keep")
    )


def op7_quality_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = common.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality(common.table(spark, sf_dir, "documents"), trusted)
