"""Queries over relations: joins, islands, modes, running totals and page geometry on the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.functions import names
from veldmark.operators import pdf, relational

#: Rows of a key that are worked on at once where rows follow one another.
WIDTH = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    return relational.missing(customers, _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), "custkey", "o_custkey")


def repeated_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.repeated(_table(spark, sf_dir, "part"), "p_name", "p_type")


def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual size of each brand's parts, as the size of most lines is a document's body size."""
    return relational.usual(_table(spark, sf_dir, "part"), ["p_brand"], "p_size")


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a document by brand: sizes against the usual one, weights 0, 400 and 700 in turn."""
    parts = _table(spark, sf_dir, "part")
    body = relational.usual(parts, ["p_brand"], "p_size").select("p_brand", F.col("p_size").cast("float").alias("body"))
    lines = parts.join(body, "p_brand").withColumn("size", F.col("p_size").cast("float")).withColumn("weight", F.element_at(F.array(F.lit(0), F.lit(400), F.lit(700)), (F.col("p_partkey") % 3 + 1).cast("int")))
    big = F.when((F.col("size") / F.col("body")).cast("float") >= F.lit(pdf.STANDARD.heading_level_1_size_ratio).cast("float"), F.col("size"))
    lines = relational.with_largest(lines.withColumn("big", big), ["p_brand", "p_type"], "big", "primary")
    return lines.select("p_partkey", pdf.heading_level_column(F.col("size"), F.col("weight"), F.col("body"), F.col("primary")).alias("level"))


def largest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return relational.with_largest(docs, ["source"], "n_chars", "largest").where("n_chars = largest").select("source", "doc_id", "largest")


def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(relational.upper_median("l_quantity").alias("quantity"), F.count("*").alias("n"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user that are at most six hours apart are a session."""
    second = F.expr("timestampdiff(SECOND, cast('2000-01-01' as timestamp_ntz), cast(ts as timestamp_ntz))")
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", second.alias("s"))
    bucket = F.floor(F.col("s") / (86400 * 30))
    known = relational.with_previous(events, ["user_id"], ["s", "event_id"], "s", "before", bucket)
    starts = F.col("before").isNull() | (F.col("s") - F.col("before") > 6 * 3600)
    found = relational.segments(known, ["user_id"], ["s", "event_id"], starts, "session", bucket)
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), (F.max("s") - F.min("s")).cast("long").alias("seconds"))


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive line numbers of an order with one return flag."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    return relational.runs(lines, ["l_orderkey"], "l_linenumber", "flag").select("l_orderkey", "flag", F.col("first").alias("first_number"), "n")


def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest time between two orders of a customer, in days; the last of equally long ones."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date"))
    return relational.largest_gap(_table(spark, sf_dir, "orders").select("o_custkey", day.alias("day")), ["o_custkey"], "day").select("o_custkey", F.col("low").alias("from_day"), F.col("high").alias("to_day"))


def price_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = F.array(*(F.lit(float(x)) for x in range(10_000, 100_000, 15_000)))
    return _table(spark, sf_dir, "lineitem").groupBy(relational.cell(F.col("l_extendedprice"), edges).alias("cell")).agg(F.count("*").alias("n"))


def item_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order as rectangles; pairs of which one covers a quarter of the other."""
    box = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("l"), (F.col("l_quantity") + F.col("l_linenumber") * 4).alias("r"),
        (F.col("l_suppkey") % 5).alias("t"), (F.col("l_suppkey") % 5 + 2).alias("b"),
    )
    return relational.overlapping(box, box, ["l_orderkey"], 0.25).where("line < line_2").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def dense_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every line number up to an order's last."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return relational.spine(lines, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", F.coalesce("n", F.lit(0)).alias("n"))


def strings_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation at a position among those of a region, or none."""
    asked = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("n_regionkey"), (F.col("c_custkey") % 7).cast("int").alias("at"))
    return relational.at_position(asked, _table(spark, sf_dir, "nation"), ["n_regionkey"], "at", ["n_nationkey"], "n_name").select("c_custkey", "n_name")


def inherited_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a chain of parents of half their number; each seventh has a level of its own."""
    nodes = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 2)).alias("parent"), F.when(F.col("c_custkey") % 7 == 3, F.col("c_nationkey")).alias("value"))
    return relational.inherited(nodes).select(F.col("id").alias("c_custkey"), F.col("value").alias("level"))


def inherited_levels_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over nations by a recursive query."""
    nodes = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 2)).cast("int").alias("parent"), F.when(F.col("n_nationkey") % 4 == 1, F.col("n_regionkey")).alias("value"))
    return relational.inherited_recursive(nodes).select(F.col("id").alias("n_nationkey"), F.col("value").alias("level"))


def first_page_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first usable page of a host, and the names of the others."""
    pages = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "url")
    return relational.first_usable(pages, ["host"], "url", F.col("url").contains("?")).select("host", F.col("first").alias("first_url"), "n", "n_usable", "rest")


def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://[^/]+\.([a-z]+)/", 1).alias("domain"), "page_id")
    return relational.numbered(pages, ["domain"], ["page_id"], "image-%03d.png").select("page_id", "domain", F.col("number").cast("long").alias("number"), "file_name")


def character_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source in order, up to the first that takes the source over 30,000 characters."""
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return relational.budget(docs, ["source"], ["doc_id"], F.col("n_chars"), 30_000, F.floor(F.col("doc_id") / WIDTH))


def first_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of a kind and user, as a warning is given once for a code and page."""
    events = _table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value")
    return relational.first_of_each(events, ["event_type", "user_id"], ["event_id"]).select("event_type", "user_id", "event_id", "value")


def navigation_then_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))
    return relational.in_order(region, _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")))


def csv_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where("text not like '%\"%' and instr(text, '\\r') = 0")
    return relational.delimiter_scores(docs)


def glyph_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of customers' names as glyphs; words are the islands between white space."""
    text = F.concat_ws("  ", "c_name", "c_mktsegment")
    glyphs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.split(text, "")).alias("idx", "text"))
    words = pdf.with_words(glyphs).where("word is not null").groupBy("doc_id", "word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda g: g["text"]), "").alias("text"))
    return words.select(F.col("doc_id").alias("c_custkey"), F.col("word").cast("long").alias("word"), "text")


def _text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as lines of pages: a source is a document, its documents are pages."""
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    height = F.size("lines").cast("float").alias("height")
    at = F.col("line").cast("float")
    return docs.select("doc_id", "page", height, F.posexplode("lines").alias("line", "text")).withColumns({"t": at, "b": (at + 1).cast("float")})


def chrome_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that do not repeat on the edges of several pages, by page."""
    return pdf.without_chrome(_text_lines(spark, sf_dir)).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def merged_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document joined to paragraphs: a line that begins in lower case goes on with the one before."""
    lines = _text_lines(spark, sf_dir).where("text <> ''").select("page", "line", "text")
    goes_on = F.col("text").rlike(r"^\p{Ll}")
    bucket = F.floor(F.col("line") / WIDTH)
    parts = relational.segments(lines, ["page"], ["line"], ~goes_on, "paragraph", bucket)
    text = F.array_join(F.sort_array(F.collect_list(F.struct("line", "text")))["text"], "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?<=\p{L})-\n(?=\p{Ll})", ""), "\n", " ")
    return parts.groupBy("page", "paragraph").agg(text.alias("text")).select(F.col("page").alias("doc_id"), "paragraph", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("md5"))


def chrome_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_lines(spark, sf_dir).groupBy(names.chrome_key("text").alias("key")).agg(F.countDistinct("doc_id").alias("n_sources")).where("n_sources > 1 and key <> ''")


def pdf_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each region, written glyph by glyph: its name as a heading, its nations as a numbered list."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), F.expr("row_number() over (partition by n_regionkey order by n_nationkey)").alias("row"), "n_name")
    lines = n.select("page", "row", F.concat(F.col("row").cast("string"), F.lit(". "), F.col("n_name")).alias("text"), F.lit(10.0).alias("size")).unionAll(
        _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("page"), F.lit(0).alias("row"), F.col("r_name").alias("text"), F.lit(20.0).alias("size"))
    )
    glyphs = lines.select("page", "row", "size", F.posexplode(F.split(F.concat("text", F.lit("\n")), "")).alias("i", "text")).select(
        F.lit("regions").alias("doc_id"), "page", (F.col("row") * 1000 + F.col("i")).alias("idx"), "text", (20 + F.col("i") * F.col("size") / 2).alias("l"), (60 + F.col("row") * 14 + F.when(F.col("row") > 0, 20).otherwise(0)).alias("t"),
        (20 + (F.col("i") + 1) * F.col("size") / 2).alias("r"), (60 + F.col("row") * 14 + F.when(F.col("row") > 0, 20).otherwise(0) + F.col("size")).alias("b"), F.col("size").alias("font_size"), F.lit(400).alias("font_weight"),
    )
    pages = _table(spark, sf_dir, "region").select(F.lit("regions").alias("doc_id"), F.col("r_regionkey").alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    none = pages.where("false")
    rules = none.selectExpr("doc_id", "page", "'line' as kind", "width as l", "width as t", "width as r", "width as b")
    links = none.selectExpr("doc_id", "page", "width as l", "width as t", "width as r", "width as b", "'' as target")
    images = none.selectExpr("doc_id", "page", "0 as idx", "width as l", "width as t", "width as r", "width as b", "0 as px_w", "0 as px_h", "cast(null as binary) as rgba")
    return pdf.reconstruct(pages, pdf.with_words(glyphs), rules, links, images).select("doc_id", "status", "markdown", "n_blocks", F.col("page_count").cast("long").alias("page_count"))


QUERIES = [
    customers_without_orders, repeated_part_names, body_sizes, heading_levels, largest_documents, upper_medians, event_sessions, line_runs, order_gaps, price_cells, item_overlaps, dense_lines,
    strings_by_position, inherited_levels, inherited_levels_recursive, first_page_by_host, numbered_pages, character_budgets, first_warnings, navigation_then_spine, csv_delimiters, glyph_words,
    chrome_removal, merged_paragraphs, chrome_key_counts, pdf_regions,
]

_USUAL = "select p_brand, p_size, n from (select p_brand, p_size, count(*) as n, row_number() over (partition by p_brand order by count(*) desc, p_size) as k from part group by p_brand, p_size) where k = 1"
_LINES = "select source as doc_id, doc_id as page, unnest(string_split(coalesce(text, ''), chr(10))) as text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as line, len(string_split(coalesce(text, ''), chr(10))) as h from documents"
_KEY = r"lower(trim(regexp_replace(text, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')))"

SQL = {
    "customers_without_orders": "select c_custkey as custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "repeated_part_names": "select p_name, p_type, count(*) as n from part group by p_name, p_type having count(*) > 1",
    "body_sizes": _USUAL,
    "heading_levels": f"""
with u as ({_USUAL}), l as (select part.*, cast(part.p_size as float) / cast(u.p_size as float) as ratio, ([0, 400, 700])[p_partkey % 3 + 1] as weight from part join u using (p_brand)),
p as (select *, max(case when ratio >= 1.8::float then p_size end) over (partition by p_brand, p_type) as prime from l)
select p_partkey, case when ratio >= 1.8::float then case when p_size < prime and weight <> 400 then 2 else 1 end
  when weight = 0 and ratio >= 1.35::float then case when prime is null and ratio >= 1.6::float then 1 else 2 end
  when weight = 700 and ratio >= 1.35::float then 2 end as level from p""",
    "largest_documents": "select source, doc_id, n_chars as largest from documents qualify n_chars = max(n_chars) over (partition by source)",
    "upper_medians": "select l_returnflag, l_linenumber, (list_sort(list(l_quantity)))[count(*) // 2 + 1] as quantity, count(*) as n from lineitem group by l_returnflag, l_linenumber",
    "event_sessions": """
with e as (select user_id, event_id, datediff('second', timestamp '2000-01-01', ts) - case when ts < date_trunc('second', ts) then 1 else 0 end as s from events),
g as (select *, case when s - lag(s) over (partition by user_id order by s, event_id) <= 21600 then 0 else 1 end as f from e),
n as (select *, sum(f) over (partition by user_id order by s, event_id rows unbounded preceding) as session from g)
select user_id, cast(session as bigint) as session, count(*) as n, min(event_id) as first_id, cast(max(s) - min(s) as bigint) as seconds from n group by user_id, session""",
    "line_runs": """
with l as (select l_orderkey, l_linenumber, max(l_returnflag) as flag from lineitem group by all),
g as (select *, case when lag(l_linenumber) over (partition by l_orderkey, flag order by l_linenumber) = l_linenumber - 1 then 0 else 1 end as f from l),
i as (select *, sum(f) over (partition by l_orderkey, flag order by l_linenumber) as island from g)
select l_orderkey, flag, min(l_linenumber) as first_number, count(*) as n from i group by l_orderkey, flag, island""",
    "order_gaps": """
with d as (select o_custkey, datediff('day', date '1990-01-01', cast(o_orderdate as date)) as day from orders), g as (select *, lead(day) over (partition by o_custkey order by day) as nxt from d)
select o_custkey, cast(day as int) as from_day, cast(nxt as int) as to_day from g where nxt is not null qualify row_number() over (partition by o_custkey order by nxt - day desc, day desc) = 1""",
    "price_cells": "select case when l_extendedprice between 10000 and 85000 then least(cast(floor((l_extendedprice - 10000) / 15000) as int), 4) end as cell, count(*) as n from lineitem group by 1",
    "item_overlaps": """
with b as (select l_orderkey, l_linenumber as line, l_quantity as l, l_quantity + l_linenumber * 4 as r, l_suppkey % 5 as t, l_suppkey % 5 + 2 as b from lineitem)
select x.l_orderkey, count(*) as n from b x join b y on x.l_orderkey = y.l_orderkey and x.line < y.line and y.l < x.r and x.l < y.r and y.t < x.b and x.t < y.b
where (least(x.r, y.r) - greatest(x.l, y.l)) * (least(x.b, y.b) - greatest(x.t, y.t)) >= 0.25 * (x.r - x.l) * (x.b - x.t) group by x.l_orderkey""",
    "dense_lines": """
with m as (select l_orderkey, max(l_linenumber) as m from lineitem group by 1), s as (select l_orderkey, unnest(generate_series(1, m)) as l_linenumber from m)
select l_orderkey, s.l_linenumber, count(l.l_quantity) as n from s left join lineitem l using (l_orderkey, l_linenumber) group by 1, 2""",
    "strings_by_position": "select c_custkey, (select l[c_custkey % 7 + 1] from (select list(n_name order by n_nationkey) as l from nation where n_regionkey = c_nationkey % 5)) as n_name from customer",
    "inherited_levels": """
with recursive c(id, up, level) as (select c_custkey, c_custkey, cast(null as int) from customer union all
select c.id, c.up // 2, null from c where c.up > 0 and c.up % 7 <> 3)
select c.id as c_custkey, max(case when c.up % 7 = 3 then k.c_nationkey end) as level from c join customer k on k.c_custkey = c.up group by c.id""",
    "inherited_levels_recursive": """
with recursive c(id, up) as (select n_nationkey, n_nationkey from nation union all select id, up // 2 from c where up > 0 and up % 4 <> 1)
select id as n_nationkey, max(case when up % 4 = 1 then n_regionkey end) as level from c join nation on n_nationkey = up group by id""",
    "first_page_by_host": """
with p as (select regexp_extract(url, '^https?://([^/]+)', 1) as host, url, strpos(url, '?') > 0 as usable from pages), m as (select host, min(url) filter (usable) as f, count(*) as n, count(*) filter (usable) as u, list(url order by url) filter (usable) as l from p group by host)
select host, f as first_url, n, u as n_usable, coalesce(array_to_string(l[2:], ', '), '') as rest from m""",
    "numbered_pages": r"with d as (select page_id, regexp_extract(url, '^https?://[^/]+\.([a-z]+)/', 1) as domain from pages), n as (select *, row_number() over (partition by domain order by page_id) as number from d) select page_id, domain, number, format('image-{:03d}.png', number) as file_name from n",
    "character_budgets": """
with r as (select source, sum(n_chars) over (partition by source order by doc_id) as s from documents), t as (select source, cast(max(s) as bigint) as total, cast(min(case when s > 30000 then s end) as bigint) as actual from r group by source)
select source, total, case when actual is null then 'ok' else 'limit_exceeded' end as status, actual, case when actual is not null then cast(30000 as bigint) end as maximum from t""",
    "first_warnings": "select event_type, user_id, event_id, value from events qualify row_number() over (partition by event_type, user_id order by event_id) = 1",
    "navigation_then_spine": "select r_name as name, r_regionkey as key, 0 as part from region union all select n_name, n_nationkey, 1 from nation",
    "csv_delimiters": r"""
with d as (select doc_id, case when ends_with(text, chr(10)) then left(text, len(text) - 1) else text end as text from documents where text not like '%"%' and strpos(text, chr(13)) = 0 and text <> ''),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, len(string_split(text, chr(10))) as n_records from d),
w as (select doc_id, n_records, delimiter, len(string_split(line, delimiter)) as width from l, (values (','), (';'), (chr(9)), ('|')) as v(delimiter)),
c as (select doc_id, n_records, delimiter, width, count(*) as often from w where width > 1 group by all)
select doc_id, delimiter, often, cast(width as int) as width, n_records from c qualify row_number() over (partition by doc_id, delimiter order by often desc, width desc) = 1""",
    "glyph_words": r"with w as (select c_custkey, regexp_extract_all(c_name || '  ' || c_mktsegment, '\S+') as w from customer) select c_custkey, unnest(range(1, len(w) + 1)) as word, unnest(w) as text from w",
    "chrome_removal": f"""
with l as ({_LINES}), e as (select *, {_KEY} as k, line <= cast(h as float) * 0.08::float as top, line + 1 >= cast(h as float) * 0.92::float as bottom from l),
f as (select *, first_value(line) over (partition by doc_id, k order by page, line) as t0 from e where top or bottom),
r as (select doc_id, k from f group by doc_id, k having count(distinct page) >= 2 and min(bottom) = max(bottom) and max(abs(line - t0)) <= 3)
select doc_id, page, count(*) as n from e where not ((top or bottom) and (doc_id, k) in (select doc_id, k from r)) group by doc_id, page""",
    "merged_paragraphs": rf"""
with l as ({_LINES}), x as (select page, line, text, sum(case when regexp_matches(text, '^\p{{Ll}}') then 0 else 1 end) over (partition by page order by line) as paragraph from l where text <> ''),
p as (select page, paragraph, regexp_replace(regexp_replace(string_agg(text, chr(10) order by line), '(\p{{L}})-\n(\p{{Ll}})', '\1\2', 'g'), '\n', ' ', 'g') as text from x group by page, paragraph)
select page as doc_id, cast(paragraph as bigint) as paragraph, len(text) as n_chars, md5(text) as md5 from p""",
    "chrome_key_counts": f"select {_KEY} as key, count(distinct doc_id) as n_sources from ({_LINES}) group by 1 having count(distinct doc_id) > 1 and key <> ''",
    "pdf_regions": "select 'regions' as doc_id, 'ok' as status, string_agg('# ' || r_name || chr(10) || chr(10) || l, chr(10) || chr(10) order by r_regionkey) || chr(10) as markdown, 2 * count(*)::int as n_blocks, count(*) as page_count from region join (select n_regionkey, string_agg(k || '. ' || replace(n_name, '_', '\\_'), chr(10) order by k) as l from (select *, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation) group by 1) on n_regionkey = r_regionkey",
}
