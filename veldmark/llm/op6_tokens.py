"""Token-ID output: shards of independent zstandard frames, with a seek table and checksums.

A shard file holds frames of whole documents, each compressed alone, and after them two skippable
frames: a document index (a record of fixed size for each document, in order) and the seek table of the zstandard seekable format
(compressed size, decompressed size and the low 32 bits of XXH64 of every frame's contents, then a footer with the frame count
and the magic number), so any zstandard reader can decompress the file, readers of the seekable format find its frames, and a reader of this
module fetches one document by its record, which a search by doc_id finds in a few reads, and its frame only.

Documents are dealt to shards by ranges of doc_id and sorted there, so the shards in order hold
the ids in ascending doc_id order (nulls first; rows of the same doc_id by text). The number of shards follows the size of the input.
Null text is an empty document (the end id alone); an empty table gives an empty manifest; further columns are not read. A shard is named
after its partition and the attempt; only shards named in the returned manifest count, so a lost or repeated task leaves no
half-written shard behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.llm import common, tokens

# Fixed values of the zstandard format and its seekable extension.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC, HAS_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

#: A document's record: doc_id, whether it is null, its frame, the ids before it there, its ids.
RECORD = struct.Struct("<q?III")
#: Contents of a frame, and input of a shard, in bytes on average.
FRAME_BYTES, SHARD_BYTES = 1 << 16, 64 << 20

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_frames int"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class ShardWriter:
    """Writes one shard front to back; holds one frame and the records of the shard."""

    def __init__(self, path: str, frame_bytes: int = FRAME_BYTES):
        import zstandard

        system, local = _open(path)
        system.create_dir(local.rsplit("/", 1)[0], recursive=True)
        self.out, self.frame_bytes, self.packer = system.open_output_stream(local, compression=None), frame_bytes, zstandard.ZstdCompressor(level=3)
        self.frames, self.records, self.n_docs, self.buffer, self.size = [], bytearray(), 0, [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.records += RECORD.pack(doc_id or 0, doc_id is None, len(self.frames), self.size // 4, len(ids) // 4)
        self.n_docs += 1
        self.buffer.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            data = b"".join(self.buffer)
            packed = self.packer.compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), checksum(data)))
            self.buffer, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(self.records)) + bytes(self.records))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), HAS_CHECKSUM, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()


class ShardReader:
    """Random access to a shard: reads the seek table first, then only the records and frames asked for."""

    def __init__(self, path: str):
        import zstandard

        system, local = _open(path)
        self.file, self.unpacker = system.open_input_file(local), zstandard.ZstdDecompressor()
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUM:
            raise ValueError(f"{path}: no seek table")
        self.frames = list(struct.iter_unpack("<III", self._read(end - 9 - 12 * n, 12 * n)))
        self.starts = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype="int64")])
        kind, size = struct.unpack("<II", self._read(int(self.starts[-1]), 8))
        if kind != SKIPPABLE_INDEX or size % RECORD.size:
            raise ValueError(f"{path}: no document index")
        self.index, self.n_docs = int(self.starts[-1]) + 8, size // RECORD.size
        self.last = (-1, b"")
        self.decompressed = 0

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def records(self, start: int = 0, end: int | None = None):
        """(doc_id, frame, ids before it in the frame, ids) of the documents at these positions, read in blocks."""
        end = self.n_docs if end is None else end
        for a in range(start, end, 4096):
            n = min(4096, end - a)
            for doc, null, *place in RECORD.iter_unpack(self._read(self.index + a * RECORD.size, n * RECORD.size)):
                yield (None if null else doc, *place)

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            data = self.unpacker.decompress(self._read(int(self.starts[i]), self.frames[i][0]), max_output_size=max(1, self.frames[i][1]))
            if checksum(data) != self.frames[i][2]:
                raise ValueError(f"frame {i}: checksum differs")
            self.last = (i, data)
            self.decompressed += 1
        return self.last[1]

    def ids(self, frame: int, start: int, n: int) -> np.ndarray:
        return np.frombuffer(self.frame(frame), dtype="<u4", count=n, offset=4 * start)

    def get(self, position: int) -> tuple[int | None, np.ndarray]:
        """(doc_id, ids) of the document at a position in the shard."""
        doc, *place = next(self.records(position, position + 1))
        return doc, self.ids(*place)

    def first(self, doc_id: int) -> int:
        """The first position whose doc_id is ``doc_id`` or more; nulls come before all others."""
        low, high = 0, self.n_docs
        while low < high:
            middle = (low + high) // 2
            found = next(self.records(middle, middle + 1))[0]
            if found is None or found < doc_id:
                low = middle + 1
            else:
                high = middle
        return low

    def find(self, doc_id: int) -> list[np.ndarray]:
        out = []
        for doc, *place in self.records(self.first(doc_id)):
            if doc != doc_id:
                break
            out.append(self.ids(*place))
        return out

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards under ``folder``; returns the manifest (shard, path, n_docs, n_tokens, n_frames)."""
    vocabulary = path or common.default_path("word_bpe_49k.json")

    def write(frames):
        from pyspark import TaskContext

        words, end = tokens.cache(vocabulary, False), np.array([end_id], dtype="<u4").tobytes()
        shard, out, n_tokens = TaskContext.get().partitionId(), None, 0
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.tok.zst"
        for pdf in common.batches(frames, 2500, 4_000_000):
            out = out or ShardWriter(name, frame_bytes)
            ids = pdf["doc_id"].astype("Int64")
            for doc, data in zip(ids, words.encode(pdf["text"].fillna("").tolist())):
                out.add(None if doc is pd.NA else int(doc), data + end)
                n_tokens += len(data) // 4 + 1
        if out:
            out.close()
            yield pd.DataFrame([(shard, name, out.n_docs, n_tokens, len(out.frames))], columns=["shard", "path", "n_docs", "n_tokens", "n_frames"]).astype({"shard": "int32", "n_frames": "int32"})

    rows = common.lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 56:  # not known from files
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // SHARD_BYTES, 1 << 20))
    dealt = rows.repartitionByRange(shards, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return common.Scratch(docs.sparkSession, "manifest").save(dealt.mapInPandas(write, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Read shards back: doc_id, start (ids before it over all shards), n_tokens, ids_crc32 and, if asked for, ids.

    With ``doc_ids`` only the frames of these documents are decompressed.
    """
    wanted = None if doc_ids is None else set(doc_ids)
    starts = manifest.withColumn("before", F.expr("sum(n_tokens) over (order by shard) - n_tokens"))  # a row for each file
    each = starts.select("path", "before").repartition(max(1, manifest.count()), "path")

    def read(frames):
        for pdf in frames:
            for path, before in zip(pdf["path"], pdf["before"]):
                shard, at, out = ShardReader(path), int(before), []
                for doc, frame, first, n in shard.records():
                    if wanted is None or doc in wanted:
                        ids = shard.ids(frame, first, n)
                        out.append((doc, at, n, zlib.crc32(ids.tobytes()), *([ids.astype("int32")] if with_ids else [])))
                    at += n
                    if len(out) >= 2000:
                        yield _frame(out, with_ids)
                        out = []
                shard.close()
                yield _frame(out, with_ids)

    return each.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _frame(rows: list[tuple], with_ids: bool) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]).astype({"doc_id": "Int64"})


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.Scratch(spark, "tokens").root
    return read_tokens(write_tokens(common.table(spark, sf_dir, "documents"), folder), with_ids=False)
