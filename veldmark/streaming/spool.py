"""A spool folder as a stream: files that arrive are converted once, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from veldmark.sources import documents

FILES = "path string, modificationTime timestamp, length long, content binary"


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, per_batch: int = 1000, max_bytes: int = documents.MAX_INPUT_BYTES) -> StreamingQuery:
    """Convert every file of ``folder`` that is there, exactly once over restarts, then stop. Larger files get an error row.

    The two branches of `documents.limited` are two sources: a checkpoint from when there was one can't be continued.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(folder)
    docs = documents.limited(files, max_bytes)
    return documents.convert(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
