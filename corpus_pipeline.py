"""Corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the
shared folder and the next stage reads that. Stages 1 to 4 return the columns of documents, with further ones if there are any.

In every stage an empty table gives an empty one, repeated rows are rows of their own (near_duplicates keeps one of them), and texts of any
length are read whole. A null text has no words, shingles, windows or candidates, so toxicity and decontamination keep it, near_duplicates
links it with nothing, secrets leaves it null, and packing makes it a document of the end id alone. A null doc_id is a document too; in a
group of near-duplicates it stays only if all are null. A null lang, source or n_chars changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.llm import common, op2_packing, op3_secrets, op8_decontaminate, op9_jaccard, op10_toxicity


#: What a task holds at a time, in the JVM and in its worker: Arrow batches and Parquet row groups in bytes, rows of text that a scan decodes
#: at once (4096 in Spark, 14 MB here), and one hash map for each aggregate (two in Spark, each with pages of its own).
BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512",
    "parquet.block.size": str(16 << 20), "spark.sql.codegen.aggregate.map.twolevel.enabled": "false",
}


def bounded(spark: SparkSession) -> None:
    """The session's tasks hold no more than `BOUNDS` from now on: executors keep what one stage made them take while the next one runs."""
    for name, value in BOUNDS.items():
        spark.conf.set(name, value)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; without labels of both classes none does. Ties at 0.5 go."""
    bounded(spark)
    model, name = op10_toxicity.train(docs, common.table(spark, sf_dir, "labels")), common.free_name(docs, "score")
    return op10_toxicity.score(docs, model, name).where(F.col(name) < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays; of rows that share it, one."""
    bounded(spark)
    return op9_jaccard.deduplicate(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go; with an empty benchmark none does."""
    bounded(spark)
    return op8_decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text. No row goes."""
    bounded(spark)
    out = op3_secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids, a row for each piece of a document."""
    bounded(spark)
    return op2_packing.pack(docs).select("doc_id", "piece", "start", "length", "sequence_id", "offset", "ids")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: No stage but decontamination can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = common.table(spark, sf_dir, "documents"), common.Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
