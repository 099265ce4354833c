"""Exact removal of repeated byte strings, with suffix arrays built by induced sorting.

A byte goes if a string of ``length`` bytes around it also starts earlier (a smaller doc_id, or earlier in the same document).

1. Any window of ``length`` bytes holds the leftmost smallest of its hashed k-grams, its anchor, and equal
   windows have equal anchors. One exchange by the anchors' hash brings equal anchors together; a task sends one row for each
   distinct anchor and surroundings (the bytes of all windows that it stands for) and marks its own later
   ones, so a passage in a third of all documents sends one row a task. Equal surroundings are marked whole.
2. Only anchors with several different surroundings, the edges of repeats, need bytes. Their first occurrences are
   dealt to shards by anchor; each shard gets a suffix array by induced sorting and its permuted common prefixes, and
   neighbouring suffixes that share ``length`` bytes are one class, of which the first start stays. An anchor with
   more than ``GROUP`` surroundings is cut into several shards whose classes are then compared by window hashes.
3. Marks are merged for each document and its bytes are cut.

Anchors and surroundings are compared by 64-bit hashes each. Null text counts as empty; texts shorter than ``length`` lose
nothing; among rows of one doc_id the row read first is the earlier; a null doc_id comes before all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.llm import common
from veldmark.llm.suffix_array import permuted_common_prefixes, suffix_array

GROUP = 4096
SHARD_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Hashes:
    """Hashes of any substring of a byte array, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(12, int(len(data)).bit_length())
        if n not in _TABLES:
            _TABLES.clear()
            inverse = pow(_BASE, -1, 1 << 64)
            both = []
            for x in (_BASE, inverse):
                p = np.full(n + 1, x, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            _TABLES[n] = tuple(both)
        power, self.down = _TABLES[n]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(data: np.ndarray, starts: np.ndarray, length: int, k: int, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray, Hashes]:
    """The anchors of all windows that lie inside one document, and each one's first and last window; documents end at ``starts``."""
    found, size = [], length - k + 1
    h = Hashes(data)
    n = len(data) - length + 1
    for a in range(0, max(n, 0), block):
        b = min(n, a + block)
        at = np.arange(a, b + size - 1)
        low = (h.of(at, at + k) & ~np.uint64((1 << 22) - 1)) | (at - a).astype(np.uint64)
        reach = 1
        while 2 * reach <= size:
            low = np.minimum(low[: len(low) - reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: b - a], low[size - reach : size - reach + b - a])
        window = np.arange(a, b)
        doc = np.searchsorted(starts, window, side="right")
        inside = window + length <= starts[np.minimum(doc, len(starts) - 1)]
        found.append(np.c_[(low[inside] & np.uint64((1 << 22) - 1)).astype(np.int64) + a, window[inside]])
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]]) if len(pairs) else np.zeros(0, np.int64)
    return pairs[new, 0], pairs[new, 1], pairs[np.r_[new[1:], len(pairs)] - 1, 1], h


def merge(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint (start, end) that cover the same bytes."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.c_[spans[first, 0], reach[np.r_[first[1:], True]]]


ROWS = "h long, c long, doc long, pos int, size int, lead int"


def _spans(doc, spans, lead=-1):
    """Marks travel in the rows of anchors: c is null, pos and size are the span."""
    return pd.DataFrame({"h": np.zeros(len(spans), np.int64), "c": pd.array([None] * len(spans), "Int64"), "doc": doc, "pos": spans[:, 0].astype("int32"), "size": (spans[:, 1] - spans[:, 0]).astype("int32"), "lead": np.full(len(spans), lead, "int32")})


def local_rows(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Anchors and marks of each task; see step 1. ``docs``: doc (order number), text."""

    def run(frames):
        for pdf in common.batches(frames, 2000, 2_000_000):
            texts = [t.encode() for t in pdf["text"]]
            docs_ = pdf["doc"].to_numpy()
            order = np.argsort(docs_, kind="stable")
            texts, docs_ = [texts[i] for i in order], docs_[order]
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            at, left, right, hashes = anchors(data, ends, length, k)
            if not len(at):
                continue
            doc = np.searchsorted(ends, at, side="right")
            begin = np.r_[0, ends[:-1]][doc]
            right = right + length
            h = hashes.of(at, at + k)
            c = _mix(hashes.of(left, right) ^ ((at - left).astype(np.uint64) << np.uint64(20)) ^ (right - left).astype(np.uint64))
            rank = np.lexsort((at, c, h))
            first = np.r_[True, (h[rank][1:] != h[rank][:-1]) | (c[rank][1:] != c[rank][:-1])]
            later = np.sort(rank[~first])
            if len(later):  # a task's later equal surroundings are known to repeat
                for i in np.unique(doc[later]):
                    mine = later[np.searchsorted(doc[later], i) : np.searchsorted(doc[later], i, side="right")]
                    spans = merge(np.c_[left[mine] - begin[mine], right[mine] - begin[mine]])
                    yield _spans(docs_[i], spans)
            rank = rank[first]
            yield pd.DataFrame({
                "h": h[rank].view(np.int64), "c": pd.array(c[rank].view(np.int64), "Int64"), "doc": docs_[doc[rank]], "pos": (left - begin)[rank].astype("int32"),
                "size": (right - left)[rank].astype("int32"), "lead": (at - left)[rank].astype("int32"),
            })

    return docs.mapInPandas(run, ROWS)


SHARED = "doc long, pos int, size int, h long, w long, v long"


def compare(surroundings: DataFrame, length: int) -> DataFrame:
    """Marks (w is null) of windows that repeat among the surroundings of an anchor (h, shard, doc, pos, bytes).

    Rows of anchors that are cut into shards also give the first start of each of their windows, with its hash (w, v).
    """

    def shard(pdf: pd.DataFrame):
        pdf = pdf.sort_values(["doc", "pos"], kind="stable")
        parts = [np.frombuffer(b, np.uint8) for b in pdf["bytes"]]
        sizes = np.array([len(p) for p in parts])
        t = np.zeros(sizes.sum() + len(parts) + 1, np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        for p, a in zip(parts, starts):
            t[a : a + len(p)] = p.astype(np.int64) + 2
            t[a + len(p)] = 1  # no common prefix of interest runs over it: see `inside`
        sa = suffix_array(t)
        shared = permuted_common_prefixes(t, sa, length)
        owner = np.repeat(np.arange(len(parts)), sizes + 1)
        offset = np.arange(len(owner)) - starts[owner]
        inside = np.r_[offset + length <= sizes[owner], False]
        ranked = sa[inside[sa]]  # a class of windows is a run: all suffixes between two of it share the window too
        head = np.r_[True, shared[ranked[1:]] < length]
        group = np.cumsum(head) - 1
        doc, pos = pdf["doc"].to_numpy()[owner[ranked]], pdf["pos"].to_numpy()[owner[ranked]] + offset[ranked]
        order = np.lexsort((pos, doc, group))
        lead = order[np.r_[True, group[order][1:] != group[order][:-1]]]
        same = (doc == doc[lead][group]) & (pos == pos[lead][group])
        marks = np.flatnonzero(~same)
        out = []
        if len(marks):
            d, p = doc[marks], pos[marks]
            o = np.lexsort((p, d))
            d, p = d[o], p[o]
            new = np.r_[True, (d[1:] != d[:-1]) | (p[1:] > p[:-1] + length)]
            last = np.r_[new[1:], True]
            out.append(pd.DataFrame({"doc": d[new], "pos": p[new].astype("int32"), "size": (p[last] + length - p[new]).astype("int32"), "h": 0, "w": pd.array([None] * new.sum(), "Int64"), "v": 0}))
        cut = pdf["cut"].to_numpy()[owner[ranked[lead]]]
        if cut.any():
            keep = lead[cut]
            digest = [hashlib.blake2b((t[i : i + length] - 2).astype(np.uint8).tobytes(), digest_size=16).digest() for i in ranked[keep]]
            w = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            out.append(pd.DataFrame({"doc": doc[keep], "pos": pos[keep].astype("int32"), "size": np.full(len(keep), length, "int32"), "h": 0, "w": pd.array(w[:, 0], "Int64"), "v": w[:, 1]}))
        return out

    def run(frames):
        held, held_bytes, last = [], 0, None
        for pdf in frames:
            if not len(pdf):
                continue
            keys = pdf[["h", "shard"]].to_numpy()
            size = np.cumsum(pdf["bytes"].str.len().to_numpy())
            cuts = np.flatnonzero(np.r_[last is None or (keys[0] != last).any(), (keys[1:] != keys[:-1]).any(axis=1)])
            start = done = 0
            for cut in cuts.tolist():  # a shard ends between two anchors only
                here = int(size[cut - 1]) if cut else 0
                if held_bytes + here - done > SHARD_BYTES:
                    yield from shard(pd.concat([*held, pdf.iloc[start:cut]]))
                    held, held_bytes, start, done = [], 0, cut, here
            held.append(pdf.iloc[start:])
            held_bytes += int(size[-1]) - done
            last = keys[-1]
        if held_bytes:
            yield from shard(pd.concat(held))

    dealt = surroundings.repartition("h", "shard").sortWithinPartitions("h", "shard")
    return dealt.mapInPandas(run, SHARED)


def repeated(docs: DataFrame, length: int, k: int, scratch: common.Scratch) -> DataFrame:
    """(doc, pos, size): spans of ``docs`` (doc, text) that repeat an earlier window."""
    rows = local_rows(docs.where(F.octet_length("text") >= length), length, k)
    # one exchange by anchor; marks are dealt evenly by their document
    key = F.when(F.col("c").isNull(), F.xxhash64("doc", "pos")).otherwise(F.col("h"))
    rows = rows.withColumn("h", key)
    order = "partition by h order by c, doc, pos"
    met = rows.withColumn("h0", F.expr(f"lag(h) over ({order})")).withColumn("c0", F.expr(f"lag(c) over ({order})")).withColumn(
        "first", F.expr(f"first_value(struct(c, doc, pos, size)) over ({order})")
    )
    met = met.withColumn("kind", F.expr("case when c is null or (h0 is not null and c0 = c) then 'mark' when h0 is not null and c0 is not null then 'edge' end")).where("kind is not null")
    met = scratch.save(met.select("h", "doc", "pos", "size", "kind", F.expr("if(kind = 'edge', first, null)").alias("first")), "met")
    edges = met.where("kind = 'edge'")
    edges = edges.select("h", "doc", "pos", "size").unionAll(edges.select("h", "first.doc", "first.pos", "first.size")).distinct()
    crowd = edges.groupBy("h").count().where(F.col("count") > GROUP).select(F.col("h").alias("hot"))
    edges = edges.join(crowd, F.col("h") == F.col("hot"), "left").select(
        "h", "doc", "pos", "size", F.col("hot").isNotNull().alias("cut"), F.expr(f"if(hot is null, 0, pmod(xxhash64(doc, pos), 1 + {1 << 16}))").alias("shard")
    )
    wanted = edges.groupBy("doc").agg(F.collect_list(F.struct("h", "pos", "size", "cut", "shard")).alias("asked"))

    def take(frames):
        for pdf in frames:
            out = []
            for doc, text, asked in zip(pdf["doc"], pdf["text"], pdf["asked"]):
                data = text.encode()
                out += [(a["h"], a["shard"], a["cut"], doc, a["pos"], data[a["pos"] : a["pos"] + a["size"]]) for a in asked]
            yield pd.DataFrame(out, columns=["h", "shard", "cut", "doc", "pos", "bytes"]).astype({"pos": "int32"})

    taken = docs.join(wanted, "doc").mapInPandas(take, "h long, shard long, cut boolean, doc long, pos int, bytes binary")
    compared = scratch.save(compare(taken, length), "compared")
    heads = compared.where("w is not null").withColumn("low", F.expr("min(struct(doc, pos)) over (partition by w, v)"))
    more = heads.where("low.doc <> doc or low.pos <> pos").select("doc", "pos", "size")
    return met.where("kind = 'mark'").select("doc", "pos", "size").unionAll(compared.where("w is null").select("doc", "pos", "size")).unionAll(more)


def remove_repeats(docs: DataFrame, length: int = 100, k: int = 50) -> DataFrame:
    """(doc_id, text as kept bytes, n_bytes, n_removed, n_spans, spans) for every row of ``docs`` (doc_id, text)."""
    spark = common.lean(docs).sparkSession
    scratch = common.Scratch(spark, "suffix")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stat = base.agg(F.count("*"), F.count("doc_id")).first()
    unique = stat[0] == stat[1] and not base.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if unique:
        rows = base.withColumn("doc", F.col("doc_id"))
    else:  # an order number for each row, by one range shuffle
        rows = scratch.save(base.withColumn("r", F.monotonically_increasing_id()).repartitionByRange("doc_id", "r").sortWithinPartitions("doc_id", "r").withColumn("doc", F.monotonically_increasing_id()).drop("r"), "ordered")
    marks = scratch.save(repeated(rows.select("doc", "text"), length, k, scratch).groupBy("doc").agg(F.collect_list(F.struct("pos", "size")).alias("marks")), "marks")
    full = rows.join(marks, "doc", "left")

    def cut(frames):
        for pdf in frames:
            out = []
            for doc, text, marks in zip(pdf["doc_id"], pdf["text"], pdf["marks"]):
                data = text.encode()
                spans = [] if marks is None else merge(np.array([(m["pos"], m["pos"] + m["size"]) for m in marks], np.int64)).tolist()
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((doc, kept, len(data), len(data) - len(kept), len(spans), [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "spans"]).astype({"doc_id": "Int64"})

    return full.select("doc_id", "text", "marks").mapInPandas(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
