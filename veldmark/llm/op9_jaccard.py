"""Exact Jaccard join of word shingles by partitioning the universe (pigeonhole), and its components.

Sets are dealt to size bands. For two sets of a band (or of neighbouring bands) that reach the similarity, the symmetric
difference is at most some H that depends on the band alone. The shingles are hashed into segments, and each segment has an
allocation: 1 is an index entry of the whole segment, 2 one of the segment and of its one-deletion neighbourhood. With
allocations that add up to H + 1 + e, two similar sets meet in segments whose allocations, less what differs there, add
up to e + 1 at least. The e spare units are for segments without content: a set is weak if its empty segments (and, at
allocation 2, its segments of one shingle) weigh more than e. Only weak sets leave entries without content, for two sets of which one
is not weak meet in an entry with content anyway. As what two similar sets share counts e + 1 and empty segments only count the weight of
one of them, they have e + 1 less that weight entries in common at least, and a set that meets others in fewer is left out. `allocate` takes the split and the spare units of least cost from the
numbers of sets in the bands, which one pass counts. Candidates are verified on their words.

Entries cross the network packed: a task combines equal ones, sorts them and sends a block of 40 bits and a row for each
to every part. Entries that a task finds twice itself go out as members of their group at once, so that a group of a third of
all rows reaches its part as one row from each task. Equal sets are one node. The members of an entry are first
compared with one of them; once they are known to be connected, further pairs need no comparison. Later rounds compare with another
member, and the last one takes the sets of entries that still join several components: each brings its rarest shingles (`prefixes`),
of which two similar sets share one, and the pairs that meet there, are not yet connected and have sizes that allow the
similarity are compared. So no link between components is lost, while a group of n near copies, or of n texts with one
passage, costs about n comparisons and not n * n.
Before texts are compared, a pair must pass its sizes and a parity sketch as long as its sets, both exact bounds. A text
goes once to each block of at most about 256 partners.

Shingles are compared by 64-bit hashes of their words where sets are counted and equal sets are grouped (by size and two sums of 64
bits) and by the words themselves where pairs are verified. Null and empty texts have no shingles and are linked with nothing;
a text with fewer words than a shingle is one shingle; repeated rows are linked like any copies; an empty table gives no
rows; further columns are not read. A null doc_id never names a component that has others.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldmark.llm import common

#: A band's largest size is this power of the largest ratio of partners' sizes times its smallest.
BAND_POWER = 2.5
#: Index entries that a task of signing holds, and that a part of the exchange gets on average.
HELD, PART = 300_000, 1_000_000
#: Texts and characters that are signed at a time, bytes of an Arrow batch, rows of a frame of entries: a worker holds many times as much.
TEXTS, CHARS, BATCH_BYTES, FRAME = 300, 600_000, 2 << 20, 50_000
#: Cost of a comparison of two sets by size and sketch, in index entries.
COMPARE = 2
#: Partners of a text in one block; rows up to which the list of texts to verify is broadcast (about 40 bytes a row).
BLOCK, BROADCAST_ROWS = 256, 500_000
LOW = (1 << 40) - 1
#: Numbers of the sketches that joins compare: one for all sets, and one for larger sets, on which the first is always full.
SHORT, WIDE = 8, 32


def words(text: str) -> list[bytes]:
    """Words between the white space of ASCII, with A-Z in lower case; bytes know no other case and no other space."""
    return text.encode().lower().split()


def shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def band_starts(percent: int, longest: int = 1 << 40) -> list[int]:
    """Smallest sizes of the bands. A partner of a set is in its band or in a neighbouring one."""
    out = [1]
    while out[-1] < longest:
        out.append(max(out[-1] * 100 // percent + 1, int(out[-1] * (100 / percent) ** BAND_POWER) + 1))
    return out


def tail(mean: float, e: int) -> float:
    """About the probability that a Poisson number exceeds e."""
    if mean > 30:
        return 0.5 * math.erfc((e + 0.5 - mean) / math.sqrt(2 * mean))
    term = total = math.exp(-mean)
    for i in range(1, e + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def steps(most: int) -> list[int]:
    """0 to ``most``, the larger ones in steps of about a tenth."""
    out = [0]
    while out[-1] < most:
        out.append(min(most, max(out[-1] + 1, out[-1] * 11 // 10)))
    return out


def allocate(starts: list[int], percent: int, counts: list[int]) -> list[tuple[int, int, int]]:
    """For each band (segments of allocation 1, segments of allocation 2, spare units).

    ``counts`` has the number of sets of each band; those of the next one may also enter it. The cost of a set is its
    entries and its comparisons with other weak sets in segments without content.
    """
    out = []
    for i, (low, end) in enumerate(zip(starts, starts[1:])):
        n = counts[i] + (counts[i + 1] if i + 1 < len(counts) else 0)
        a = end - 1
        b = a * 100 // percent
        need = (100 - percent) * (a + b) // (100 + percent) + 1
        best = None
        for spare in steps(need // 2 + 2 if n and need > 1 else 0):
            for two in steps(min(64, (need + spare) // 2) if n else 0):
                one = need + spare - 2 * two
                length = low / (one + two)  # the smallest sets of a band have the most empty segments
                empty = math.exp(-length)
                weak = (one + two * (2 + length)) * empty
                q = tail(weak, spare)
                meet = q * q * max(weak, spare + 1) ** 2 / (one + two)
                cost = one + two * (1 + length) + COMPARE * n * meet
                if best is None or cost < best[0]:
                    best = (cost, one, two, spare)
        out.append(best[1:])
    return out


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signer:
    """Distinct shingle hashes, set hashes, parity sketches and index entries of a batch of texts."""

    def __init__(self, k: int, percent: int, plan: list[tuple[int, int, int]], limit: int = 200_000):
        self.k, self.percent, self.limit, self.cache = k, percent, limit, {}
        self.starts = np.array(band_starts(percent))
        self.one, self.two, self.spare = (np.array([p[i] for p in plan]) for i in range(3))

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, shingle hash), distinct."""
        import xxhash

        if len(self.cache) > self.limit:
            self.cache.clear()
        cache, k = self.cache, self.k
        found = [words(t) for t in texts]
        for w in set().union(*([w for w in f if w not in cache] for f in found)):
            cache[w] = xxhash.xxh64_intdigest(w)
        n = np.array([len(f) for f in found])
        h = np.fromiter((x for f in found for x in map(cache.__getitem__, f)), np.uint64, n.sum())
        owner, left = np.repeat(np.arange(len(texts)), n), np.repeat(np.cumsum(n), n) - np.arange(len(h))
        size = np.minimum(n, k)[owner]
        at = np.flatnonzero(left >= size)  # a text of fewer words than k has one
        code, short = np.zeros(len(at), np.uint64), (n < k).any()
        for i in range(k):
            x = h[np.minimum(at + i, max(0, len(h) - 1))]
            code = mix(code + _M1) + (np.where(i < size[at], x, np.uint64(0)) if short else x)
        code, many = mix(code), np.bincount(owner[at], minlength=len(texts))
        own = [np.unique(c) for c in np.split(code, np.cumsum(many)[:-1])]
        return np.repeat(np.arange(len(texts)), [len(c) for c in own]), np.concatenate(own)

    def entries(self, owner: np.ndarray, code: np.ndarray, scheme: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, entry) under each text's scheme (-1: none), and how many of them each text shares with any similar one.

        An entry's lowest bit is that of its scheme, so the entries of a text's two schemes can be told apart.
        """
        use = scheme[owner] >= 0
        owner, code = owner[use], code[use]
        s = scheme.clip(min=0)
        segments = np.where(scheme >= 0, self.one[s] + self.two[s], 0)
        base = np.concatenate([[0], np.cumsum(segments)])
        seg = ((code >> np.uint64(20)) % segments[owner].astype(np.uint64)).astype(np.int64)
        slot, x = base[owner] + seg, mix(code ^ _M2)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, slot, x)
        holds = np.bincount(slot, minlength=base[-1])
        slot_owner = np.repeat(np.arange(len(scheme)), segments)
        place = np.arange(base[-1]) - base[slot_owner]
        salt = mix((s[slot_owner].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + _M3)
        two = place >= self.one[s[slot_owner]]  # segments of allocation 2 come last
        weight = (1 + two) * (holds == 0) + (two & (holds == 1))
        lost = np.bincount(slot_owner, weight, minlength=len(scheme)).astype(np.int64)
        weak = lost > self.spare[s]
        need = np.where(scheme >= 0, np.maximum(1, self.spare[s] - lost), 0)  # one less, as two entries may get one number
        whole = (holds > 0) | weak[slot_owner]
        near = two[slot] & ((holds[slot] > 1) | weak[owner])
        deleted = mix((total[slot[near]] - x[near]) ^ salt[slot[near]])
        found, of = np.concatenate([mix(total ^ salt)[whole], deleted]), np.concatenate([slot_owner[whole], owner[near]])
        return of, (found & ~np.uint64(1)) | (s[of] & 1).astype(np.uint64), need

    def sketches(self, owner: np.ndarray, code: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Parities of the hashes by their low bits, in two to four bits for each shingle and 512 at least."""
        bits = np.maximum(512, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
        base = np.concatenate([[0], np.cumsum(bits)])
        at = base[owner] + (code & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
        odd = (np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8)
        packed = np.packbits(odd, bitorder="little").tobytes()
        return [packed[a // 8 : b // 8] for a, b in zip(base, base[1:])]

    @staticmethod
    def fold(sketch: bytes, numbers: int = SHORT) -> list[int] | None:
        """The sketch as one of so many numbers of 64 bits; none if it is shorter."""
        whole = np.frombuffer(sketch, np.int64)
        return np.bitwise_xor.reduce(whole.reshape(-1, numbers), 0).tolist() if len(whole) >= numbers else None

    def sign(self, texts: list[str]) -> dict:
        owner, code = self.sets(texts)
        n = len(texts)
        size = np.bincount(owner, minlength=n)
        some = np.flatnonzero(size)
        starts = np.searchsorted(owner, some)
        s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        if len(some):
            s1[some], s2[some] = np.add.reduceat(mix(code ^ _M1), starts), np.add.reduceat(mix(code ^ _M3), starts)
        sketch, seen, first = self.sketches(owner, code, size), {}, np.zeros(n, bool)
        for i in some:  # a batch's copies of a set leave entries once
            first[i] = seen.setdefault((s1[i], s2[i], size[i]), i) == i
        band = np.searchsorted(self.starts, size, side="right") - 1
        reach = (self.starts[band] - 1) * 100 // self.percent  # of the largest set of the band below
        low = np.where(first & (band >= 1) & (size <= reach), band - 1, -1)
        a, b = self.entries(owner, code, np.where(first, band, -1)), self.entries(owner, code, low)
        own = (band & 1) == 1
        return {"size": size, "s1": s1.view(np.int64), "s2": s2.view(np.int64), "sketch": sketch, "even": np.where(own, b[2], a[2]), "odd": np.where(own, a[2], b[2]), "owner": np.concatenate([a[0], b[0]]), "entry": np.concatenate([a[1], b[1]])}


INDEX = "part long, kind int, row long, doc_id long, n long, s1 long, s2 long, sketch binary, folded array<long>, wide array<long>, even long, odd long, keys binary, rows binary"
FOUND = "row long, doc_id long, n long, s1 long, s2 long, sketch binary, folded array<long>, wide array<long>, even long, odd long, entry long"


def frame(**columns) -> pd.DataFrame:
    size = max(len(v) for v in columns.values() if not np.isscalar(v))
    out = pd.DataFrame(index=range(size))
    for name in [x.split()[0] for x in INDEX.split(", ")]:
        out[name] = columns.get(name, pd.array([None] * size, dtype="object" if name in ("sketch", "folded", "wide", "keys", "rows") else "Int64"))
    return out


def blocks(keys: np.ndarray, rows: np.ndarray, parts: int):
    """Frames of a task's entries: a block for each part, and entries that the task has twice, with all their rows."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(new) - 1
    twice = np.bincount(group)[group] > 1
    if twice.any():
        k, r = keys[twice], rows[twice]
        cut = range(0, len(k), 100_000)
        yield frame(part=[int(mix(k[i : i + 1])[0] % np.uint64(parts)) for i in cut], kind=2, keys=[k[i : i + 100_000].tobytes() for i in cut], rows=[r[i : i + 100_000].tobytes() for i in cut])
    keys, rows = keys[new], rows[new]
    part, starts = np.unique(keys >> np.uint64(40), return_index=True)
    ends = [*starts[1:], len(keys)]
    low = np.ascontiguousarray((keys & np.uint64(LOW)).view(np.uint8).reshape(-1, 8)[:, :5])
    first = int(rows.min())
    wide = int(rows.max()) - first >= 1 << 32
    delta = (rows - first).astype(np.int64 if wide else np.uint32)
    yield frame(part=part.astype(np.int64), kind=1, row=first, n=8 if wide else 4, keys=[low[a:b].tobytes() for a, b in zip(starts, ends)], rows=[delta[a:b].tobytes() for a, b in zip(starts, ends)])


def meetings(frames):
    """Of sorted rows of `INDEX`: rows of texts, and (entry, row) of the entries that more than one row has."""
    keys, rows, part = [], [], None

    def close():
        if len(keys) > 1:
            k, r = np.concatenate(keys), np.concatenate(rows)
            keys.clear()
            rows.clear()
            order = np.argsort(k, kind="stable")
            k = k[order]
            same = k[1:] == k[:-1]
            shared = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
            entry, row = (k[shared] | np.uint64(part << 40)).view(np.int64), r[order[shared]]
            del k, r, order, same, shared
            for i in range(0, len(entry), FRAME):
                yield shaped(pd.DataFrame({"entry": entry[i : i + FRAME], "row": row[i : i + FRAME]}))

    def shaped(x):
        out = x.reindex(columns=[c.split()[0] for c in FOUND.split(", ")])
        return out if "sketch" in x else out.assign(sketch=None, folded=None, wide=None)

    for pdf in frames:
        texts = pdf[pdf["kind"] == 0]
        if len(texts):
            yield shaped(texts)
        for x in pdf[pdf["kind"] > 0].itertuples():
            if x.kind == 2:
                yield shaped(pd.DataFrame({"entry": np.frombuffer(x.keys, np.int64), "row": np.frombuffer(x.rows, np.int64)}))
                continue
            if x.part != part:
                yield from close()
                keys, rows, part = [], [], int(x.part)
            b = np.zeros((len(x.keys) // 5, 8), np.uint8)
            b[:, :5] = np.frombuffer(x.keys, np.uint8).reshape(-1, 5)
            keys.append(b.view(np.uint64).ravel())
            rows.append(np.frombuffer(x.rows, np.int64 if x.n == 8 else np.uint32).astype(np.int64) + int(x.row))
    yield from close()
    keys, rows = [], []
    common.give_back()


def index(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows of `FOUND`: one for each text (entry null), and (entry, row) of the entries that more than one text has."""
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))  # about the words; steers costs only
    sizes = docs.select(F.floor(4 * F.log(F.coalesce(spaces, F.lit(0)) + 1)).alias("bin")).groupBy("bin").count().collect()
    starts = band_starts(percent)
    counts = [0] * len(starts)
    sized = [(max(1, int(math.exp((r.bin + 0.5) / 4)) - k + 1), r["count"]) for r in sizes]
    for n, c in sized:
        counts[int(np.searchsorted(starts, n, side="right")) - 1] += c
    plan = allocate(starts, percent, counts)
    total = 0
    for n, c in sized:
        i = int(np.searchsorted(starts, n, side="right")) - 1
        for one, two, _ in plan[max(0, i - 1) : i + 1]:
            total += c * (one + two + two * n / (one + two))
    shuffle = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffle, min(1 << 23, int(total // PART) + 1))

    def run(frames):
        signer, held, size = Signer(k, percent, plan), [], 0
        for pdf in common.batches(frames, TEXTS, CHARS):
            x, row = signer.sign(pdf["text"].fillna("").tolist()), pdf["row"].to_numpy()
            place = (mix(row.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            yield frame(part=place, kind=0, row=row, doc_id=pdf["doc_id"].astype("Int64").array, n=x["size"], s1=x["s1"], s2=x["s2"], sketch=x["sketch"], folded=list(map(Signer.fold, x["sketch"])), wide=[Signer.fold(s, WIDE) for s in x["sketch"]], even=x["even"], odd=x["odd"])
            e = x["entry"]
            part = ((e >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            held.append(((part << np.uint64(40)) | (e & np.uint64(LOW)), row[x["owner"]]))
            size += len(e)
            if size > HELD:
                yield from blocks(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), parts)
                held, size = [], 0
        if size:
            yield from blocks(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), parts)
        del signer, held
        common.give_back()

    signed = common.lean(docs).select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, INDEX)
    return signed.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(meetings, FOUND)


def possible(percent: int, a: str, b: str) -> F.Column:
    """Sizes and short sketches (structs of n, folded and wide) allow the similarity; a condition of joins."""
    n, m = F.col(a)["n"], F.col(b)["n"]

    def near(name: str, numbers: int) -> F.Column:
        differ = sum((F.bit_count(F.get(F.col(a)[name], F.lit(i)).bitwiseXOR(F.get(F.col(b)[name], F.lit(i)))) for i in range(numbers)), F.lit(0))
        return differ * (100 + percent) <= (100 - percent) * (n + m)

    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & near("folded", SHORT) & F.coalesce(near("wide", WIDE), F.lit(True))


def plausible(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow; both bounds are exact."""
    x, y = (info.select(F.col("row").alias(c), F.struct("n", "folded", "wide").alias(f"f{c}"), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    p = pairs.join(x, "a").alias("p")
    both = p.join(y.alias("q"), (F.col("p.b") == F.col("q.b")) & possible(percent, "fa", "fb")).select("a", "p.b", "na", "nb", "sa", "sb")

    def run(frames):
        for pdf in frames:
            keep = np.zeros(len(pdf), bool)
            for i, (n, m, s, t) in enumerate(zip(pdf["na"], pdf["nb"], pdf["sa"], pdf["sb"])):
                if len(s) > len(t):
                    s, t = t, s
                x, size = int.from_bytes(t, "little"), len(t)
                while size > len(s):  # a longer sketch folds to a shorter one
                    size //= 2
                    x = (x >> 8 * size) ^ (x & ((1 << 8 * size) - 1))
                keep[i] = (x ^ int.from_bytes(s, "little")).bit_count() * (100 + percent) <= (100 - percent) * (n + m)
            yield pdf.loc[keep, ["a", "b"]]
        common.give_back()

    return both.mapInPandas(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The distinct ``pairs`` (a, b) whose texts reach the similarity; a text a goes once to each block of its partners."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    salted = pairs.join(many, "a").select("a", F.expr("pmod(xxhash64(b), blocks)").alias("salt"), "b")
    uses = salted.select("a", "salt", F.col("b").alias("row")).unionAll(salted.select("a", "salt", F.col("a").alias("row")).distinct())
    if pairs.count() <= BROADCAST_ROWS // 2:
        uses = F.broadcast(uses)
    dealt = texts.join(uses, "row").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("row") != F.col("a"))

    def run(frames):
        centre, own = None, set()
        for pdf in common.batches(frames):
            out = []
            for a, salt, row, text in zip(pdf["a"], pdf["salt"], pdf["row"], pdf["text"]):
                s = shingles(text, k)
                if row == a:
                    centre, own = (a, salt), s
                    continue
                if centre != (a, salt):
                    raise ValueError("the rows of a block are not together")
                both = len(s & own)
                if 100 * both >= percent * (len(s) + len(own) - both):
                    out.append((a, row))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.select("a", "salt", "row", "text").mapInPandas(run, "a long, b long")


def enough(met: DataFrame, same: DataFrame, scratch: common.Scratch) -> DataFrame:
    """``met`` (entry, node) without nodes that meet others in fewer entries of a scheme than a similar set would share with them."""
    shared = met.groupBy("entry").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("entry")
    left = scratch.save(met.join(shared, "entry"), "shared")
    counts = left.groupBy("node", F.expr("entry & 1").alias("bit")).count()
    stay = counts.join(same.select("rep", "even", "odd"), F.col("node") == F.col("rep")).where("count >= if(bit = 0, even, odd)")
    stay = stay.select(F.col("node").alias("who"), F.col("bit").alias("scheme"))
    return left.join(stay, F.expr("node = who and entry & 1 = scheme")).select("entry", "node")


def several(met: DataFrame) -> DataFrame:
    """(entry, rep, size) of the entries of ``met`` (entry, node) with several nodes. Those of the same nodes say the same: one of them stays."""
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    found = met.groupBy("entry").agg(F.min("node").alias("rep"), F.max("node").alias("high"), F.count("*").alias("size"), *marks).where("rep <> high")
    return found.groupBy("size", "x0", "x1").agg(F.min("entry").alias("entry"), F.min("rep").alias("rep")).select("entry", "rep", "size")


def prefixes(texts: DataFrame, nodes: DataFrame, k: int, percent: int, scratch: common.Scratch) -> DataFrame:
    """(entry, node): of each of ``nodes`` (node, n) its rarest shingles, of which two similar sets have one in common.

    Of two sets that reach the similarity each has at least ``percent`` of its shingles in common with the other. With all shingles
    in one order, the first common one therefore stands among the others and one more in both. The order is by the number of
    nodes that have a shingle, so passages that many documents share come last and bring nobody together.
    """

    def run(frames):
        signer = Signer(k, percent, [])
        for pdf in common.batches(frames, TEXTS, CHARS):
            owner, code = signer.sets(pdf["text"].tolist())
            yield pd.DataFrame({"node": pdf["row"].to_numpy()[owner], "entry": code.view(np.int64)})
        del signer
        common.give_back()

    if nodes.count() <= BROADCAST_ROWS:
        nodes = F.broadcast(nodes)  # else all texts would be exchanged
    own = texts.join(nodes.withColumnRenamed("node", "row"), "row").select("row", "text")
    codes = scratch.save(own.mapInPandas(run, "node long, entry long"), "codes")
    often = codes.groupBy("entry").agg(F.count("*").alias("often")).where("often > 1")
    shared = codes.join(often, "entry").join(nodes, "node")
    by = Window.partitionBy("node")
    placed = shared.select("node", "entry", "n", F.row_number().over(by.orderBy("often", "entry")).alias("place"), F.count("*").over(by).alias("many"))
    return placed.where(f"place <= many - ({percent} * n + 99) div 100 + 1").select("entry", "node")


def components(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """(row, doc_id, n_shingles, component_row, component_id) of ``docs`` (row, doc_id, text).

    ``docs`` is read more than once; ``row`` must name the same row each time, as `common.numbered` sees to.
    """
    with common.batch_bytes(docs.sparkSession, BATCH_BYTES):  # every step in Python ends in here
        return _components(docs, k, percent, rounds)


def _components(docs: DataFrame, k: int, percent: int, rounds: int) -> DataFrame:
    scratch = common.Scratch(docs.sparkSession, "jaccard")
    found = scratch.save(index(docs, k, percent), "index")
    info = found.where("entry is null").select("row", "doc_id", "n", "s1", "s2", "sketch", "folded", "wide")
    needs = [F.max(c).alias(c) for c in ("even", "odd")]
    same = scratch.save(found.where("entry is null and n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("rep"), *needs), "same")
    of = scratch.save(info.drop("sketch", "folded", "wide").join(same.drop("even", "odd"), ["s1", "s2", "n"], "left").select("row", "doc_id", "n", "rep"), "of")
    met = found.where("entry is not null").select("entry", "row").join(of.select("row", "rep"), "row")
    met = scratch.save(enough(met.select("entry", F.col("rep").alias("node")).distinct(), same, scratch), "met")
    members = scratch.save(met.join(several(met), "entry"), "members")
    scratch.drop(met)
    texts = docs.select("row", F.coalesce("text", F.lit("")).alias("text"))

    def linked(pairs: DataFrame) -> DataFrame:
        allowed = scratch.save(plausible(pairs.distinct(), info, percent), "allowed")
        return scratch.save(verify(allowed, texts, k, percent), "links")

    links = linked(members.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")))
    members = members.where("size > 2").select("entry", "node")
    for turn in range(1, rounds + 1):
        groups = scratch.save(common.connected_components(links, scratch), "components")
        named = members.join(groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left").select("entry", "node", F.coalesce("component", "node").alias("c"))
        mixed = named.groupBy("entry").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("entry")
        open_ = scratch.save(named.join(mixed, "entry"), "open")
        members = open_
        if open_.isEmpty():
            break
        if turn < rounds:
            by = F.min_by(F.struct("node", "c"), F.xxhash64("node", F.lit(turn)))
            reps = open_.groupBy("entry").agg(by.alias("rep"))
            pairs = open_.join(reps, "entry").where("c <> rep.c").select(F.col("rep.node").alias("a"), F.col("node").alias("b"))
            links = links.unionAll(linked(pairs))
        else:
            of_node = info.select(F.col("row").alias("node"), F.struct("n", "folded", "wide").alias("f"))
            nodes = scratch.save(open_.groupBy("node").agg(F.min("c").alias("c")).join(of_node, "node"), "nodes")
            starting = scratch.save(prefixes(texts, nodes.select("node", "f.n"), k, percent, scratch).join(nodes, "node"), "prefixes")
            mixed = starting.groupBy("entry").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("entry")
            starting = starting.join(mixed, "entry")
            sized = scratch.save(starting.join(several(starting).select("entry"), "entry"), "sized")
            x, y = sized.alias("x"), sized.alias("y")  # one exchange
            meet = (F.col("x.entry") == F.col("y.entry")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")) & possible(percent, "x.f", "y.f")
            pairs = x.join(y, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
            links = links.unionAll(linked(pairs))
            groups = scratch.save(common.connected_components(links, scratch), "components")
    named = of.join(groups, F.col("rep") == F.col("node"), "left").select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "row").alias("component_row"))
    named = scratch.save(named, "rows")
    low = named.groupBy("component_row").agg(F.min("doc_id").alias("component_id"))
    return named.join(low, "component_row")


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component: the smallest doc_id there, or any one row if that is repeated."""
    rows = common.numbered(docs, "__row")
    found = components(rows.select(F.col("__row").alias("row"), "doc_id", "text"), k, percent)
    kept = found.groupBy("component_row").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("kept"))
    gone = common.Scratch(docs.sparkSession, "jaccard").save(found.join(kept, "component_row").where("row <> kept").select(F.col("row").alias("__row")), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(gone, "__row", "left_anti").drop("__row")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.numbered(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "row")
    return components(docs, k=3, percent=90).select("doc_id", "n_shingles", "component_id")
