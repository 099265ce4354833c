"""Names and keys as Column expressions: file names, titles of print jobs, keys of repeated text, cells of a sheet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from veldmark.operators.office import percent_display as _percent

# Sizes and defaults of names.
GRAPHEMES, NAME_BYTES, TITLE_CHARS = 117, 240, 120
DOCUMENT, UNTITLED = "Documento", "Untitled PDF"


def _trim_end(c: Column) -> Column:
    return F.regexp_replace(c, r"[. ]+$", "")


def markdown_name(c: Column | str) -> Column:
    """A safe file name with the extension md: forbidden marks become blanks, at most 117 graphemes and 240 bytes."""
    c = F.regexp_replace(c, r'[\p{Cc}<>:"/\\|?*]', " ")
    c = _trim_end(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", ""))
    c = _trim_end(F.regexp_replace(c, r"(?i)\.md$", ""))
    c = F.when(c == "", DOCUMENT).otherwise(c)
    start = F.struct(F.lit("").alias("s"), F.lit(True).alias("open"))

    def grow(a: Column, x: Column) -> Column:
        fits = a["open"] & (F.octet_length(a["s"]) + F.octet_length(x) + 3 <= NAME_BYTES)
        return F.struct(F.when(fits, F.concat(a["s"], x)).otherwise(a["s"]).alias("s"), fits.alias("open"))

    short = F.aggregate(F.slice(F.regexp_extract_all(c, F.lit(r"(\X)"), F.lit(1)), 1, GRAPHEMES), start, grow, lambda a: a["s"])
    return F.concat(F.when(short == "", DOCUMENT).otherwise(short), F.lit(".md"))


def export_name(c: Column | str) -> Column:
    """The name of an HTML export of a document."""
    c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)\.html$", ""), r"(?i)\.md$", "")
    return F.concat(F.regexp_replace(markdown_name(c), r"(\.md)+$", ""), F.lit(".html"))


def print_title(c: Column | str) -> Column:
    """The title of a print job: blanks collapsed, no path marks, at most 120 characters, no blanks or dots around."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(F.coalesce(c, F.lit(UNTITLED)), r"(?U)[\p{Cc}/\\:\s]+", " ")
    c = F.substring(F.regexp_replace(c, "^ | $", ""), 1, TITLE_CHARS)
    c = F.regexp_replace(c, r"^[ .]+|[ .]+$", "")
    return F.when(c == "", UNTITLED).otherwise(c)


def chrome_key(c: Column | str) -> Column:
    """Text of headers and footers as it is compared between pages."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", ""))


def text_key(c: Column | str) -> Column:
    """Letters and digits alone, in lower case: recognised text as it is compared with glyphs."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def a1(c: Column | str) -> Column:
    """(column from 0, row from 1) of a cell's name; null if it is none."""
    c = F.col(c) if isinstance(c, str) else c
    letters, row = F.regexp_extract(c, r"^([A-Z]{1,12})[1-9][0-9]{0,17}$", 1), F.regexp_extract(c, r"^[A-Z]{1,12}([1-9][0-9]{0,17})$", 1)
    column = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda a, x: a * 26 + F.ascii(x) - 64)
    return F.when(letters != "", F.struct((column - 1).alias("column"), F.when(row != "", row).cast("long").alias("row")))


@F.pandas_udf(StringType())
def percent_display(value: pd.Series, decimals: pd.Series) -> pd.Series:
    """A share as per cent. Ties of the exact binary value go to even, which the JVM's formatter does not do."""
    return pd.Series([None if pd.isna(v) else _percent(float(v), int(d)) for v, d in zip(value, decimals)])


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def find(text: pd.Series, query: pd.Series) -> pd.Series:
    """Matches without regard to case that do not overlap, at their places in the original text."""

    def matches(t, q):
        needle = (q or "").lower()
        if not t or not needle:
            return []
        folded, place = [], []
        for i, c in enumerate(t):
            low = c.lower()
            folded.append(low)
            place += [i] * len(low)
        low, out, at = "".join(folded), [], 0
        while (at := low.find(needle, at)) >= 0:
            out.append({"start": place[at], "end": place[at + len(needle) - 1] + 1})
            at += len(needle)
        return out

    return pd.Series([matches(t, q) for t, q in zip(text, query)])
