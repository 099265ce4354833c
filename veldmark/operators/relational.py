"""Joins, islands, modes and running totals that document conversion needs, over tables of any size.

Where rows of a key follow one another, ``bucket`` (a Column that does not fall along the order, such as a number divided by a width)
cuts a key into pieces that are worked on alone; only a row for each piece is carried from one to the next. So one key may hold
a large part of all rows. Without a bucket a key is one piece.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def missing(references: DataFrame, targets: DataFrame, key: str, target_key: str) -> DataFrame:
    """References whose target is not there."""
    return references.join(targets.select(F.col(target_key).alias(key)), key, "left_anti")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def usual(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): the value of most rows of a key, the smallest of equally frequent ones. Counts are combined before the exchange."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.v").alias(value), (-F.col("best.m")).alias("n"))


def upper_median(value: str) -> Column:
    """The middle value, the larger of two middle ones."""
    return F.expr(f"percentile_disc(0.5) within group (order by {value} desc)")


def with_largest(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the largest value of their key; an aggregate that is joined back, so no key is one task."""
    return rows.join(rows.groupBy(*keys).agg(F.max(value).alias(name)), keys)


def cell(value: Column, boundaries: Column) -> Column:
    """The number of the cell between sorted boundaries (an array) that a value is in, the last one closed; null outside."""
    n = F.size(boundaries)
    at = F.size(F.filter(boundaries, lambda b: b <= value)) - 1
    return F.when((value >= F.element_at(boundaries, 1)) & (value <= F.element_at(boundaries, -1)), F.least(at, n - 2))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Pairs of rectangles (l, t, r, b; right's columns with the suffix _2) of a key of which right covers ``share`` of left's area."""
    other = right.select(*keys, *(F.col(c).alias(f"{c}_2") for c in right.columns if c not in keys))
    width = F.least("r", "r_2") - F.greatest("l", "l_2")
    height = F.least("b", "b_2") - F.greatest("t", "t_2")
    area = (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))
    return left.join(other, keys).where((width > 0) & (height > 0) & (width * height >= share * area))


def inherited(nodes: DataFrame, depth: int = 128) -> DataFrame:
    """(id, value) of nodes (id, parent, value): a node's own value or that of its nearest ancestor with one.

    Ancestors are followed by doubling steps: a row's pointer is joined with the pointer of the row it points to. Whatever still
    points on after ``depth`` steps is a cycle or too deep and has no row.
    """
    cur = nodes.select("id", F.when(F.col("value").isNull(), F.col("parent")).alias("up"), "value")
    steps = 1
    while steps < depth:
        nxt = cur.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("value").alias("value2"), F.lit(True).alias("there"))
        cur = cur.join(nxt, "up", "left").select("id", F.when(F.col("there"), F.col("up2")).alias("up"), F.coalesce("value", "value2").alias("value"))
        steps *= 2
    return cur.where("up is null").select("id", "value")


def inherited_recursive(nodes: DataFrame) -> DataFrame:
    """The same by a recursive query, for shallow chains."""
    name = f"nodes_{uuid.uuid4().hex}"
    nodes.createOrReplaceTempView(name)
    return nodes.sparkSession.sql(
        f"with recursive chain(id, up, value) as (select id, parent, value from {name} union all "
        f"select c.id, n.parent, n.value from chain c join {name} n on n.id = c.up where c.value is null) "
        "select id, max(value) as value from chain group by id"
    )


def _window(keys: list[str], order: list[str], bucket: Column | None):
    return Window.partitionBy(*keys, *([] if bucket is None else ["__bucket"])).orderBy(*order)


def with_previous(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, bucket: Column | None = None) -> DataFrame:
    """``rows`` with the value of the row before."""
    if bucket is None:
        return rows.withColumn(name, F.lag(value).over(_window(keys, order, None)))
    cut = rows.withColumn("__bucket", bucket)
    last = cut.groupBy(*keys, "__bucket").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    carried = last.withColumn("__before", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__bucket"))).drop("__last")
    inner = cut.withColumn("__lag", F.lag(value).over(_window(keys, order, bucket))).withColumn("__first", F.row_number().over(_window(keys, order, bucket)) == 1)
    return inner.join(carried, [*keys, "__bucket"]).withColumn(name, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__lag"))).drop("__bucket", "__lag", "__before", "__first")


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, bucket: Column | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    if bucket is None:
        return rows.withColumn(name, F.sum(value).over(_window(keys, order, None).rowsBetween(*upto)))
    cut = rows.withColumn("__value", value).withColumn("__bucket", bucket)
    sums = cut.groupBy(*keys, "__bucket").agg(F.sum("__value").alias("__sum"))
    before = sums.withColumn("__before", F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(*upto)) - F.col("__sum")).drop("__sum")
    inner = cut.withColumn(name, F.sum("__value").over(_window(keys, order, bucket).rowsBetween(*upto)))
    return inner.join(before, [*keys, "__bucket"]).withColumn(name, F.col(name) + F.col("__before")).drop("__bucket", "__value", "__before")


def segments(rows: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "segment", bucket: Column | None = None) -> DataFrame:
    """``rows`` with the number, from 1, of their segment; ``starts`` says which rows open one."""
    return running_total(rows, keys, order, starts.cast("long"), name, bucket)


def runs(rows: DataFrame, keys: list[str], number: str, kind: str) -> DataFrame:
    """(keys, kind, first, n): runs of consecutive numbers of one kind, by the difference of a number and its rank."""
    rank = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(number))
    island = rows.withColumn("__island", F.col(number) - rank)
    return island.groupBy(*keys, kind, "__island").agg(F.min(number).alias("first"), F.count("*").alias("n")).drop("__island")


def largest_gap(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, low, high) of the widest gap between neighbouring values of a key, the last of equally wide ones."""
    pairs = rows.select(*keys, value, F.lead(value).over(Window.partitionBy(*keys).orderBy(value)).alias("__next")).where("__next is not null")
    best = F.max(F.struct((F.col("__next") - F.col(value)).alias("gap"), F.col(value).alias("low"), F.col("__next").alias("high")))
    return pairs.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.low", "best.high")


def first_usable(rows: DataFrame, keys: list[str], name: str, usable: Column) -> DataFrame:
    """(keys, first, n, n_usable, rest): the first usable name of a key and the names of the other usable ones."""
    named = F.when(usable, F.col(name))
    found = rows.groupBy(*keys).agg(F.min(named).alias("first"), F.count("*").alias("n"), F.count(named).alias("n_usable"), F.sort_array(F.collect_list(named)).alias("rest"))
    return found.withColumn("rest", F.array_join(F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))), ", "))


def numbered(rows: DataFrame, keys: list[str], order: list[str], pattern: str) -> DataFrame:
    """``rows`` with number and file_name; the pattern pads the number and never cuts it."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("number", at).withColumn("file_name", F.format_string(pattern, "number"))


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an aggregate, which combines rows before the exchange."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col("best")[c].alias(c) for c in rest))


def budget(rows: DataFrame, keys: list[str], order: list[str], amount: Column, maximum: int, bucket: Column | None = None) -> DataFrame:
    """(keys, total, status, actual, maximum): the first running total over the budget, if there is one."""
    with_total = running_total(rows, keys, order, amount, "__total", bucket)
    over = F.min(F.when(F.col("__total") > maximum, F.col("__total")))
    out = with_total.groupBy(*keys).agg(F.max("__total").alias("total"), over.alias("actual"))
    return out.select(*keys, "total", F.when(F.col("actual").isNull(), "ok").otherwise("limit_exceeded").alias("status"), "actual", F.when(F.col("actual").isNotNull(), F.lit(maximum).cast("long")).alias("maximum"))


def in_order(*parts: DataFrame) -> DataFrame:
    """One after another: ``part`` is the place of the table that a row comes from."""
    return reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])


def spine(rows: DataFrame, keys: list[str], position: str, first: int = 1) -> DataFrame:
    """``rows`` with a row for every position from ``first`` to a key's last; what was not there is null."""
    last = rows.groupBy(*keys).agg(F.max(position).alias("__last"))
    every = last.select(*keys, F.explode(F.sequence(F.lit(first).cast("long"), F.col("__last").cast("long"))).alias(position))
    return every.join(rows.withColumn(position, F.col(position).cast("long")), [*keys, position], "left")


def at_position(asked: DataFrame, values: DataFrame, keys: list[str], position: str, order: list[str], value: str) -> DataFrame:
    """``asked`` with the value at a position, from 0, among a key's values in order."""
    placed = values.select(*keys, value, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).alias(position))
    return asked.join(placed, [*keys, position], "left")


def delimiter_scores(docs: DataFrame, delimiters: str = ",;\t|") -> DataFrame:
    """(doc_id, delimiter, often, width, n_records) of texts without quotes and carriage returns (doc_id, text).

    The record width that most records have, among those of two or more fields, the larger of equally frequent ones.
    """
    # a newline at the end closes the last record; blank lines are records
    records = F.split(F.regexp_replace("text", r"\n$", ""), "\n")

    def widths(d: str) -> Column:
        return F.transform("records", lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))) + 1).alias("widths")

    counts = F.array(*(F.struct(F.lit(d).alias("delimiter"), widths(d)) for d in delimiters))
    each = docs.where(F.length("text") > 0).select("doc_id", records.alias("records")).select("doc_id", F.size("records").cast("long").alias("n_records"), F.inline(counts))
    wide = each.select("doc_id", "n_records", "delimiter", F.explode(F.filter("widths", lambda w: w > 1)).alias("width"))
    often = wide.groupBy("doc_id", "n_records", "delimiter", "width").agg(F.count("*").alias("often"))
    best = F.max(F.struct("often", "width")).alias("best")
    return often.groupBy("doc_id", "n_records", "delimiter").agg(best).select("doc_id", "delimiter", "best.often", "best.width", "n_records")
