"""The conversion for users of SQL: a table function of one document."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from veldmark.sources import documents

ROW = "status string, error_code string, format string, title string, markdown string, n_blocks int, n_warnings int"


class ToMarkdown:
    """A row for each document (content, path, source URL), as `veldmark.sources.documents.convert_one` gives it."""

    def eval(self, content: bytes, path: str, source_url: str):
        kind = documents.format_of(path, bytes(content)) if content is not None else None
        row = documents.convert_one("", kind, content, source_url, path)
        yield row["status"], row["error_code"], row["format"], row["title"], row["markdown"], row["n_blocks"], len(row["warnings"])


def register(spark: SparkSession, name: str = "to_markdown") -> None:
    """``select t.* from docs, lateral to_markdown(content, path, url) t``."""
    spark.udtf.register(name, udtf(ToMarkdown, returnType=ROW))
