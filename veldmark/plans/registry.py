"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.functions import gfm, names, paths
from veldmark.operators import ocr
from veldmark.plans import tables
from veldmark.sources import documents

ESCAPED = r"regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({c}, '([\\`*_~\[\]<>#!])', '\\\1', 'g'), '&', '&amp;'), '(?m)^( {{0,3}})([-+])(\s)', '\1\\\2\3', 'g'), '(?m)^( {{0,3}})(-{{3,}}|={{3,}})(\s*)$', '\1\\\2\3', 'g'), '(?m)^( {{0,3}}[0-9]+)([.)])(\s)', '\1\\\2\3', 'g')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("page.html").alias("path"), F.col("url").alias("source_url"), F.encode("html", "utf-8").alias("content"))
    return documents.spread(pages)


def _inputs(rows: DataFrame, key, text, path=None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(F.col(key).cast("string").alias("doc_id"), (none if path is None else path).alias("path"), none.alias("source_url"), F.encode(text, "utf-8").alias("content"))


def pages_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page converted; a row with its status."""
    return documents.convert(_pages(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("page_id"), "status", "title", "markdown", "n_blocks", F.size("warnings").alias("n_warnings"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.titles(_pages(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("page_id"), "title")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each page's Markdown tree, resolved against its URL."""
    return documents.links(_pages(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("page_id"), "ord", "url")


def detected_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by content alone: JSON of events, pages, and nations written as CSV and as XML."""
    n = _table(spark, sf_dir, "nation")
    lines = F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(",", "n_nationkey", "n_name"))))
    csv = n.groupBy("n_regionkey").agg(F.concat(F.lit("key,name\n"), lines).alias("text"))
    xml = n.withColumn("text", F.concat(F.lit("<nation>"), F.col("n_name"), F.lit("</nation>")))
    every = [_inputs(_table(spark, sf_dir, "events"), "event_id", "props"), _inputs(_table(spark, sf_dir, "pages"), "page_id", "html"), _inputs(csv, "n_regionkey", "text"), _inputs(xml, "n_nationkey", "text")]
    docs = documents.spread(every[0].unionAll(every[1]).unionAll(every[2]).unionAll(every[3]))
    return documents.convert(docs).groupBy("format", "status").agg(F.count("*").alias("n"))


def json_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.spread(_inputs(_table(spark, sf_dir, "events"), "event_id", "props", F.lit("x.json")))
    return documents.convert(docs).select(F.col("doc_id").cast("long").alias("event_id"), "status", "markdown")


def xml_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as XML with an attribute, an element and its text."""
    text = F.format_string('<supplier key="%d">\n  <name>%s</name>\n  <nation>%d</nation>\n</supplier>', "s_suppkey", "s_name", "s_nationkey")
    docs = _inputs(_table(spark, sf_dir, "supplier").withColumn("text", text), "s_suppkey", "text", F.lit("x.xml"))
    return documents.convert(docs).select(F.col("doc_id").cast("long").alias("s_suppkey"), "status", "markdown")


def csv_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region as CSV with semicolons, some fields quoted."""
    row = F.struct("n_nationkey", F.format_string('%d;"%s"', "n_nationkey", "n_name").alias("line"))
    text = F.concat(F.lit("key;name\n"), F.concat_ws("\n", F.sort_array(F.collect_list(row))["line"]))
    docs = _inputs(_table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(text.alias("text")), "n_regionkey", "text", F.lit("x.csv"))
    return documents.convert(docs).select(F.col("doc_id").cast("int").alias("n_regionkey"), "status", "markdown")


def escape_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", gfm.escape_text("text").alias("escaped"))


def escape_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", gfm.escape_destination(F.concat(F.col("url"), F.lit(" (x)"))).alias("destination"))


def nation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table block for each region: rows ordered inside an aggregate, no window."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    row = gfm.table_row(F.col("n_nationkey").cast("string"), gfm.escape_text("n_name", True))
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("rows"))
    return rows.select("r_name", F.concat_ws("\n", F.lit("| key | name |"), F.lit("| --- | --- |"), F.col("rows.row")).alias("markdown"))


def part_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", gfm.heading((F.col("p_partkey") % 6 + 1).cast("int"), gfm.escape_text("p_name")).alias("markdown"))


def part_code_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.repeat(F.lit("`"), (F.col("p_partkey") % 4).cast("int")), F.col("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", gfm.code_span(text).alias("span"))


def device_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of part sizes: LPT and COM with one digit other than 0 are devices, whatever follows the first dot."""
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("LPT"), size, F.lit(" . "))).otherwise(F.concat(F.lit("com"), size, F.lit("."), F.col("p_name")))
    return _table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), paths.reserved_component(name).alias("reserved"))


def page_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by the extension that a page's URL has, or that a part's type would be."""
    urls = _table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^https?://[^/]*|[?#].*$", "").alias("path"))
    ext = F.element_at(F.array(*map(F.lit, ["HTM", "csv", "JSON", "xml", "bin", "jpg", "pptx"])), (F.col("p_size") % 7 + 1).cast("int"))
    parts = _table(spark, sf_dir, "part").select(F.concat(F.lit("/in.d/"), F.col("p_name"), F.lit("."), ext).alias("path"))
    return urls.unionAll(parts).groupBy(paths.extension_format("path").alias("format")).agg(F.count("*").alias("n"))


def unsafe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("java\tScript :"), F.col("url"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit(" DATA:"), F.col("url"))).otherwise(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", url.alias("url"), paths.unsafe_link(url).alias("unsafe"))


def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web URLs without user names; every other page's URL is given one, or another scheme."""
    user = F.regexp_replace("url", "://", "://user@")
    url = F.when(F.col("page_id") % 4 == 1, user).when(F.col("page_id") % 4 == 2, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", paths.web_url(url).alias("valid"), paths.preview_link(url).alias("preview"), paths.pdf_safe_scheme(url).alias("pdf_safe"), paths.external_reference(url).alias("external"), paths.safe_relative(url).alias("relative"))


def asset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and size of each page as an asset, and how many pages have the same contents."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.format_string("page-%03d.html", "page_id").alias("file_name"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("n_bytes"))
    return pages.join(pages.groupBy("sha256").agg(F.count("*").alias("n_same")), "sha256").select("page_id", "file_name", "sha256", "n_bytes", "n_same")


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of `ocr.lines`: an order stands for an image, its items for words at places made of their numbers, shipped ones for level 5."""
    words = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(400).alias("image_width"), F.lit(100).alias("image_height"), F.when(F.col("l_linestatus") == "F", 5).otherwise(4).alias("level"),
        F.lit(1).alias("page"), (F.col("l_suppkey") % 2).alias("block"), F.lit(1).alias("par"), F.floor(F.col("l_linenumber") / 3).alias("line"), F.col("l_linenumber").alias("word"),
        (F.col("l_quantity") * 10).cast("long").alias("left"), F.col("l_linenumber").alias("top"), (F.col("l_partkey") % 50).alias("width"), (F.col("l_suppkey") % 7 + 1).alias("height"),
        F.round(F.col("l_discount") * 1000).alias("conf"), F.col("l_returnflag").alias("text"),
    )
    found = ocr.lines(words)
    return found.select(F.col("doc_id").alias("l_orderkey"), "block", F.col("line").cast("int").alias("line"), "text", F.round(F.col("confidence") * 1000).cast("long").alias("confidence"), "left", "top", "right", "bottom", "n_words")


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", gfm.code_block(F.coalesce("text", F.lit(""))).alias("markdown"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", gfm.quote(text).alias("markdown"), gfm.escape_title(text).alias("title"))


def nation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered list of the nations of each region, keys on a line of their own."""
    item = F.struct("n_nationkey", F.concat_ws("\n", "n_name", F.col("n_nationkey").cast("string")).alias("item"))
    rows = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(item))["item"].alias("items"))
    return rows.select("n_regionkey", gfm.list_block(F.col("items"), 3).alias("markdown"), gfm.list_block(F.col("items")).alias("bullets"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", names.markdown_name(F.concat(F.col("url"), F.lit(" .MD "))).alias("file_name"), names.export_name("url").alias("export"), names.print_title("url").alias("title"))


def cell_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells named by two letters and a row, read back."""
    name = F.concat(F.char(65 + F.col("p_size") % 26), F.char(65 + F.col("p_partkey") % 26), (F.col("p_partkey") + 1).cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", names.a1(name)["column"].alias("column_index"), names.a1(name)["row"].alias("row_number"), names.a1(F.lower(name)).isNull().alias("refused"))


def percent_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", paths.percent_path(F.coalesce("text", F.lit(""))).alias("path"))


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", names.text_key("text").alias("ocr_key"), names.chrome_key("text").alias("chrome_key"))


def percent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts as per cent, with and without decimals."""
    rows = _table(spark, sf_dir, "lineitem").select("l_discount").distinct()
    return rows.select(names.percent_display("l_discount", F.lit(0)).alias("whole"), names.percent_display("l_discount", F.lit(2)).alias("decimals"))


def find_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "conversations").select("conv_id", "turn", names.find("text", F.lit("THE")).alias("found"))
    return found.select("conv_id", "turn", F.size("found").cast("long").alias("n"), F.element_at("found", -1)["end"].cast("long").alias("last_end")).where("n > 0")


def html_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents and pages in which a tokenizer finds markup."""
    every = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("name"), F.col("text").alias("text")).unionAll(_table(spark, sf_dir, "pages").select(F.lit("pages").alias("name"), "html"))
    return every.groupBy("name", paths.html_signal("text").alias("signal")).agg(F.count("*").alias("n"))


def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of more than 4,000 characters are over the budget."""
    over = F.col("n_chars") > 4000
    return _table(spark, sf_dir, "documents").select("doc_id", F.when(over, "limit_exceeded").alias("error_code"), F.when(over, "input_chars").alias("limit_name"), F.when(over, F.col("n_chars")).alias("actual"), F.when(over, 4000).alias("maximum"))


QUERIES = [
    pages_to_markdown, page_titles, page_links, detected_formats, json_to_markdown, xml_to_markdown, csv_to_markdown, escape_documents, escape_urls, nation_table, nation_lists, part_headings,
    part_code_spans, code_blocks, quotes, device_names, page_formats, unsafe_links, url_policy, asset_manifest, ocr_lines, file_names, cell_names, percent_paths, percent_values, text_keys, find_matches, html_signals, budget_status,
    *tables.QUERIES,
]

_SPAN = "repeat('`', p_partkey % 4) || p_name"
SQL = {
    "escape_documents": f"select doc_id, {ESCAPED.format(c='text')} as escaped from documents",
    "escape_urls": r"select page_id, replace(regexp_replace(url || ' (x)', '([\\()])', '\\\1', 'g'), ' ', '%20') as destination from pages",
    "nation_table": f"select r_name, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || {ESCAPED.format(c='n_name')} || ' |', chr(10) order by n_nationkey) as markdown from nation join region on n_regionkey = r_regionkey group by r_name",
    "part_headings": f"select p_partkey, repeat('#', cast(p_partkey % 6 + 1 as int)) || ' ' || {ESCAPED.format(c='p_name')} as markdown from part",
    "part_code_spans": f"select p_partkey, case when p_partkey % 4 = 0 then '`' || p_name || '`' else repeat('`', p_partkey % 4 + 1) || ' ' || {_SPAN} || ' ' || repeat('`', p_partkey % 4 + 1) end as span from part",
    "device_names": "select p_partkey, case when p_partkey % 2 = 0 then 'LPT' || p_size || ' . ' else 'com' || p_size || '.' || p_name end as name, p_size between 1 and 9 as reserved from part",
    "page_formats": r"with e(ext, format) as (values ('htm', 'html'), ('html', 'html'), ('csv', 'csv'), ('json', 'json'), ('xml', 'xml'), ('jpg', 'jpeg'), ('pptx', 'pptx')), p as (select nullif(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '/[^/]*\.([^/.]+)$', 1), '') as ext from pages where regexp_matches(url, '^https?://[^/]+/') union all select (['htm', 'csv', 'json', 'xml', 'bin', 'jpg', 'pptx'])[p_size % 7 + 1] from part) select format, count(*) as n from p left join e using (ext) group by format",
    "unsafe_links": r"with u as (select page_id, case page_id % 3 when 0 then 'java' || chr(9) || 'Script :' || url when 1 then ' DATA:' || url else url end as url from pages) select page_id, url, regexp_matches(lower(url), '^\s*(j\s*a\s*v\s*a\s*s\s*c\s*r\s*i\s*p\s*t|d\s*a\s*t\s*a)\s*:') as unsafe from u",
    "url_policy": "with u as (select page_id, case page_id % 4 when 1 then replace(url, '://', '://user@') when 2 then 'ftp' || substr(url, strpos(url, '://')) else url end as url from pages) select page_id, page_id % 4 in (0, 3) as valid, case when page_id % 4 in (0, 3) then url end as preview, url like 'http%' as pdf_safe, strpos(url, ':') > 0 as external, strpos(url, ':') = 0 as relative from u",
    "page_links": r"""with h as (select page_id, regexp_extract(url, '^(https?://[^/]+)', 1) as host, regexp_extract_all(html, '<a href="([^"]*)"', 1) as l from pages), e as (select page_id, host, unnest(l) as href, unnest(range(len(l))) as ord from h) select page_id, cast(ord as int) as ord, host || array_to_string(list_transform(string_split(href, ''), lambda c: case when regexp_matches(c, '^[!-~]$') then c else url_encode(c) end), '') as url from e""",
    "detected_formats": "select format, 'ok' as status, count(*) as n from (select case when json_valid(props) then 'json' end as format from events union all select case when html like '<!DOCTYPE html>%' then 'html' end from pages union all select 'csv' from (select distinct n_regionkey from nation) union all select 'xml' from nation) group by format",
    "json_to_markdown": r"""select event_id, 'ok' as status, regexp_replace(props, '^\{"(\w+)": (.*)\}$', '- **\1**: `\2`') || chr(10) as markdown from events""",
    "xml_to_markdown": "select s_suppkey, 'ok' as status, '- **supplier** (**key**: `' || s_suppkey || '`)' || chr(10) || chr(10) || '  - **name**: ' || replace(s_name, '#', '\\#') || chr(10) || chr(10) || '  - **nation**: ' || s_nationkey || chr(10) as markdown from supplier",
    "csv_to_markdown": "select n_regionkey, 'ok' as status, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '_', '\\_') || ' |', chr(10) order by n_nationkey) || chr(10) as markdown from nation group by n_regionkey",
    "code_blocks": r"select doc_id, f || chr(10) || t || case when ends_with(t, chr(10)) then '' else chr(10) end || f as markdown from (select doc_id, t, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: len(x))), 0))::int) as f from (select doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') as t from documents))",
    "quotes": r"""select conv_id, turn, array_to_string(list_transform(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: case when x = '' then '>' else '> ' || x end), chr(10)) as markdown, replace(replace(coalesce(text, ''), '\', '\\'), '"', '\"') as title from conversations""",
    "nation_lists": "with n as (select n_regionkey, n_name, n_nationkey, 2 + row_number() over (partition by n_regionkey order by n_nationkey) as i from nation) select n_regionkey, string_agg(i || '. ' || n_name || chr(10) || repeat(' ', len(i || '. ')::int) || n_nationkey, chr(10) order by i) as markdown, string_agg('- ' || n_name || chr(10) || '  ' || n_nationkey, chr(10) order by i) as bullets from n group by n_regionkey",
    "file_names": r"""with n as (select page_id, url, regexp_replace(trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', ' ', 'g'), ' +', ' ', 'g')), '[. ]+$', '') as n from pages) select page_id, n || '.md' as file_name, regexp_replace(n, '\.html$', '', 'i') || '.html' as export, trim(substr(trim(regexp_replace(url, '[/\\:\s]+', ' ', 'g')), 1, 120), ' .') as title from n""",
    "cell_names": "select p_partkey, cast((p_size % 26 + 1) * 26 + p_partkey % 26 as bigint) as column_index, p_partkey + 1 as row_number, true as refused from part",
    "percent_paths": "select conv_id, turn, array_to_string(list_transform(string_split(coalesce(text, ''), ''), lambda c: case when regexp_matches(c, '^[A-Za-z0-9/._-]$') then c when c = '~' then '%7E' else url_encode(c) end), '') as path from conversations",
    "percent_values": "select cast(cast(round(l_discount * 100) as int) as varchar) || '%' as whole, format('{:.2f}%', l_discount * 100) as decimals from (select distinct l_discount from lineitem)",
    "text_keys": r"select conv_id, turn, lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) as ocr_key, lower(trim(regexp_replace(text, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) as chrome_key from conversations",
    "find_matches": "select conv_id, turn, cast((len(text) - len(replace(lower(text), 'the', ''))) / 3 as bigint) as n, cast(len(text) - strpos(reverse(lower(text)), 'eht') + 1 as bigint) as last_end from conversations where lower(text) like '%the%'",
    "html_signals": "select name, signal, count(*) as n from (select 'documents' as name, regexp_matches(coalesce(text, ''), '<([!?]|/[^\\x{0}]|[a-zA-Z][^>]*>)') as signal from documents union all select 'pages', html like '%<!%' from pages) group by name, signal",
    "budget_status": "select doc_id, case when n_chars > 4000 then 'limit_exceeded' end as error_code, case when n_chars > 4000 then 'input_chars' end as limit_name, case when n_chars > 4000 then n_chars end as actual, case when n_chars > 4000 then 4000 end as maximum from documents",
    "asset_manifest": "select page_id, format('page-{:03d}.html', page_id) as file_name, sha256(html) as sha256, cast(strlen(html) as bigint) as n_bytes, count(*) over (partition by html) as n_same from pages",
    "page_titles": r"select page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')), '') as title from pages",
    "ocr_lines": "with w as (select *, l_suppkey % 2 as block, l_linenumber // 3 as line, least(cast(l_quantity * 10 as bigint), 400) as x0, least(cast(l_quantity * 10 as bigint) + l_partkey % 50, 400) as x1, l_linenumber as y0, l_linenumber + l_suppkey % 7 + 1 as y1 from lineitem where l_linestatus = 'F') select l_orderkey, block, line, string_agg(l_returnflag, ' ' order by l_linenumber, l_returnflag) as text, cast(round(avg(round(l_discount * 1000)) * 10) as bigint) as confidence, min(x0) as \"left\", min(y0) as top, max(x1) as \"right\", max(y1) as bottom, count(*) as n_words from w where x1 > x0 group by l_orderkey, block, line",
    **tables.SQL,
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
