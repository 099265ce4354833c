"""Benchmark decontamination with DataFrame functions only.

A window is 13 consecutive words of a benchmark item (a shorter item is one window). Any run of n
words holds a whole block of ``(n + 1) // 2`` words that starts at a multiple of that size, so of a document only
these blocks are hashed, one for seven words, and looked up in a broadcast hash table of all the items'
blocks of that length. A hit is then compared word by word with the window it stands for.

The table grows with the benchmark, not with the documents; it is broadcast up to ``BROADCAST_ROWS`` rows and
joined by a shuffle beyond. Null texts have no words, an item without words has no window, repeated
documents are judged one by one, and an empty benchmark contaminates nothing. An empty table stays empty; further columns stay, but one named
``__row`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.llm import common

# Fixed values of the contract: what is no part of a word, and the size of a window.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13

BROADCAST_ROWS = 1_000_000


def words(text: str) -> F.Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), SEPARATORS), "")


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(n, window, items): each distinct window with the ids of its items as strings."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("w")).where("size(w) > 0")
    rows = rows.withColumn("n", F.least(F.size("w"), F.lit(size)))
    each = rows.select("item", "n", F.expr("explode(transform(sequence(0, size(w) - n), s -> slice(w, s + 1, n)))").alias("window"))
    return each.groupBy("n", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, n_words, spans, items) of each row of ``docs`` (row, doc_id, text).

    spans: sorted (start, n) of the occurrences; items: sorted ids of the items that occur.
    """
    known = windows(benchmark, window)
    lengths = sorted(r[0] for r in known.select("n").distinct().collect())  # 13 at most
    blocks = sorted({(n + 1) // 2 for n in lengths})
    table = known.withColumn("b", F.expr("(n + 1) div 2")).select(
        "n", "window", "items", F.col("b").cast("int").alias("kb"), F.expr("explode(sequence(0, n - cast(b as int)))").alias("o")
    ).withColumn("kh", F.expr("xxhash64(slice(window, o + 1, kb))"))
    if known.count() * window <= BROADCAST_ROWS:
        table = F.broadcast(table)
    kept = docs.select("row", "doc_id", words("text").alias("w"))
    parts = ["array(struct(cast(null as int) as b, cast(null as bigint) as h, -1 as at, size(w) as c, cast(array() as array<string>) as ctx))"]
    for b in blocks:
        one = f"struct({b} as b, xxhash64(slice(w, {b} * j + 1, {b})) as h, {b} * j as at, greatest({b} * (j - 1) + 1, 0) as c, slice(w, greatest({b} * (j - 1) + 1, 0) + 1, {b} * (j + 2) - greatest({b} * (j - 1) + 1, 0)) as ctx)"
        parts.append(f"transform(if(size(w) >= {b}, sequence(0, size(w) div {b} - 1), cast(array() as array<int>)), j -> {one})".replace(f"size(w) div {b} - 1", f"cast(size(w) div {b} - 1 as int)"))
    flat = kept.select("row", "doc_id", F.expr(f"inline(concat({', '.join(parts)}))"))
    start = F.col("at") - F.col("o")
    same = (F.col("h") == F.col("kh")) & (F.col("b") == F.col("kb")) & (start >= F.col("c"))
    met = flat.join(table, same, "left").where("at = -1 or (kh is not null and slice(ctx, at - o - c + 1, n) = window)")
    found = met.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("at") == -1, F.col("c"))).cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("at") >= 0, F.struct(start.alias("s"), F.col("n").alias("n"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("at") >= 0, F.col("items")))))).alias("items"),
    )
    return found


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`hits` with n_hit (words inside an occurrence) and contaminated (a twentieth of the words or more)."""
    covered = "aggregate(spans, named_struct('e', 0, 'k', 0), (a, x) -> named_struct('e', greatest(a.e, x.s + x.n), 'k', a.k + greatest(0, x.s + x.n - greatest(a.e, x.s))), a -> cast(a.k as bigint))"
    return hits(docs, benchmark, window).withColumn("n_hit", F.expr(covered)).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` (any columns, with doc_id and text) without contaminated documents, or, with ``remove="spans"``, without the words hit.

    In spans mode each removed word goes with the separators after it; what is left is unchanged.
    """
    with_row = common.numbered(docs, "__row")
    found = annotate(with_row.select(F.col("__row").alias("row"), "doc_id", "text"), benchmark, window)
    if remove == "documents":
        bad = found.where("contaminated").select(F.col("row").alias("__row"))
        return with_row.join(bad, "__row", "left_anti").drop("__row")
    spans = found.where("n_hit > 0").select(F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    joined = with_row.join(spans, "__row", "left")
    word = SEPARATORS_ANY_CASE.replace("[", "[^", 1)
    parts = joined.withColumn("__parts", F.expr(rf"regexp_extract_all(text, r'({word})|({SEPARATORS_ANY_CASE})', 0)"))
    parts = parts.withColumn("__lead", F.expr(f"if(text rlike r'^{word}', 0, 1)"))
    kept = F.expr("concat_ws('', filter(__parts, (x, i) -> i < __lead or not exists(__spans, v -> (i - __lead) div 2 >= v.s and (i - __lead) div 2 < v.s + v.n)))")
    return parts.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(kept)).drop("__row", "__spans", "__parts", "__lead").select(docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = annotate(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


ORACLE = {
    "op8_decontaminate": rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), s as (
  select item, least(len(w), 13) as n, w, unnest(range(len(w) - least(len(w), 13) + 1)) as s from b where len(w) > 0
), win as (
  select distinct item, n, array_to_string(w[s + 1 : s + n], ' ') as t from s
), dw as (
  select r, n, s, array_to_string(w[s + 1 : s + n], ' ') as t
  from (select r, n, w, unnest(range(greatest(0, len(w) - n + 1))) as s from d cross join (select distinct n from win))
), hit as (
  select r, s, n, item from dw join win using (n, t)
), cover as (
  select r, count(distinct p) as n_hit from (select distinct r, unnest(range(s, s + n)) as p from (select distinct r, s, n from hit)) group by r
), its as (
  select r, count(distinct item) as n_items, string_agg(item, ',' order by item) as joined from (select distinct r, item from hit) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(joined, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join cover using (r) left join its using (r)
"""
}
