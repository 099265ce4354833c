"""Shared helpers: reading tables, the scratch folder, connected components."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The session's ``spark.checkpoint.dir`` is used as it is. Only where it is unset on one machine (tests) a folder of our own
    is made and set; on a cluster that is an error, since executors do not see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veldmark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage and to be read more than once.

    Results that are not yet computed read them, so they stay until the session ends, or until `drop`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/veldmark-{name}-{uuid.uuid4().hex}"
        self.n = 0
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._veldmark_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that no later step reads."""
        path = getattr(df, "_veldmark_path", None)
        if path:
            delete(self.spark, path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row that is the same in every read of it.

    The numbers of a plain scan depend on its files alone. A plan that shuffles or samples is written first, since rows may
    come in another order when a lost part of it is made again.
    """
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if re.search(r"Exchange|Join|Aggregate|Window|Sort|Sample|Limit|Pandas|Python|Arrow|ExistingRDD|InMemory(Table|Relation)", plan):
        df = Scratch(df.sparkSession, "numbered").save(df, "rows")
    return df.withColumn(name, F.monotonically_increasing_id())


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it if ``df`` has such a column."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def default_path(name: str) -> str:
    """A vocabulary file of the public tokenizers on this machine; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds. Both are a minimum per node (combined before the
    shuffle) and an equi-join that adaptive execution may split where a node has very many edges.
    The edges never leave the cluster; each round's edges are written to the shared folder.
    """
    cur = scratch.save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "cc",
    )
    seen = None
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.where("u <> v").distinct(), "cc-large")
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        joined = large.join(low, F.col("u") == F.col("k"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select(F.col("k").alias("u"), F.col("m").alias("v"))
        )
        new = scratch.save(small.distinct(), "cc-small")
        stat = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(cur)
        scratch.drop(large)
        cur = new
        if seen == tuple(stat):
            break
        seen = tuple(stat)
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Bytes of a batch between the JVM and Python; a worker holds a few times as much.
BATCH_BYTES = 8 << 20


def lean(df: DataFrame) -> DataFrame:
    """``df``, in whose session Arrow batches have at most `BATCH_BYTES` from now on, whatever the length of its texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = df.sparkSession.conf.get(name)
    except Exception:
        return df  # a version without this setting
    plain = re.fullmatch(r"([0-9]+)b?", now)
    if not plain or not 0 < int(plain[1]) <= BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, size: int):
    """Inside, what is computed has Arrow batches of at most ``size`` bytes; afterwards the session has its own setting again."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = spark.conf.get(name)
    except Exception:
        now = None  # a version without this setting
    plain = re.fullmatch(r"([0-9]+)b?", now or "")
    change = now is not None and not (plain and 0 < int(plain[1]) <= size)
    if change:
        spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if change:
            spark.conf.set(name, now)


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where the C library can do that."""
    import ctypes

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def batches(frames, max_rows: int = 2000, max_chars: int = 4_000_000, text: str = "text"):
    """Cut pandas frames into slices of bounded rows and text; what is freed, but kept for later, goes back at the end."""
    yield from _slices(frames, max_rows, max_chars, text)
    give_back()


def _slices(frames, max_rows: int, max_chars: int, text: str):
    for pdf in frames:
        size = pdf[text].str.len().fillna(0).to_numpy()
        start = total = 0
        for i, n in enumerate(size):
            if i > start and (total + n > max_chars or i - start >= max_rows):
                yield pdf.iloc[start:i]
                start, total = i, 0
            total += n
        if start < len(pdf):
            yield pdf.iloc[start:]
