"""GitHub-flavoured Markdown as Column expressions: escaping, headings, code spans, table rows.

They run inside whole-stage code generation; the tree emitter in `veldmark.operators.emit` follows the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALWAYS = r"([\\`*_~\[\]<>#!])"


def escape_text(c: Column | str, table: bool = False) -> Column:
    """Text made literal. Marks that only count at a line's start are escaped there alone."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"([\\`*_~\[\]<>#!|])" if table else _ALWAYS, r"\\$1")
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.regexp_replace(c, r"(?mU)^( {0,3})([-+])(?=\s)", r"$1\\$2")
    c = F.regexp_replace(c, r"(?mU)^( {0,3})(-{3,}|={3,})(?=\s*$)", r"$1\\$2")
    c = F.regexp_replace(c, r"(?mU)^( {0,3}[0-9]+)([.)])(?=\s)", r"$1\\$2")
    return F.replace(c, F.lit("\n"), F.lit("<br>")) if table else c


def escape_destination(c: Column | str, table: bool = False) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, r"([\\()|])" if table else r"([\\()])", r"\\$1")
    for code in [*range(0x21), 0x7F]:
        c = F.replace(c, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return c


def escape_title(c: Column | str, table: bool = False) -> Column:
    return F.regexp_replace(c, r'([\\"|])' if table else r'([\\"])', r"\\$1")


def heading(level: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)


def longest_run(c: Column | str, mark: str) -> Column:
    runs = F.regexp_extract_all(c, F.lit(f"({mark}+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def code_span(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    fence = F.repeat(F.lit("`"), longest_run(c, "`") + 1)
    pad = F.when(c.rlike("^[` ]|[` ]$") & ~c.rlike("^ +$"), F.lit(" ")).otherwise(F.lit(""))
    return F.when(c == "", F.lit("<code></code>")).otherwise(F.concat(fence, pad, c, pad, fence))


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def line_endings(c: Column | str) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def code_block(c: Column | str, language: str = "") -> Column:
    """A fenced block; the fence is longer than any run of its mark in the text."""
    mark = "~" if "`" in language else "`"
    text = line_endings(c)
    fence = F.repeat(F.lit(mark), F.greatest(F.lit(3), longest_run(text, mark) + 1))
    return F.concat(fence, F.lit(language + "\n"), text, F.when(text.endswith("\n"), "").otherwise("\n"), fence)


def quote(c: Column | str) -> Column:
    lines = F.split(line_endings(c), "\n")
    return F.array_join(F.transform(lines, lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")


def list_block(items: Column, start: int | None = None) -> Column:
    """A list of the texts in an array, numbered from ``start`` if there is one; later lines of an item are indented."""

    def item(text: Column, i: Column) -> Column:
        lead = F.lit("- ") if start is None else F.concat((i + start).cast("string"), F.lit(". "))
        return F.concat(lead, F.regexp_replace(text, F.lit(r"\n(?=[^\n])"), F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.length(lead)))))

    return F.array_join(F.transform(items, item), "\n")
