"""Documents in, Markdown rows out.

One row in (doc_id, path, source_url, content), one row out with a status: errors are data, and no document fails a job. The
work is one narrow `mapInPandas`, so a scan goes to the sink without a shuffle and Spark can split it as finely as its files.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.functions.paths import extension_format, magic_format
from veldmark.operators import archive, emit, epub, html, images, office, structured
from veldmark.operators.errors import DEFAULT, FormatError, Limits, within
from veldmark.operators.model import Document

FIELDS = {
    "doc_id": "string", "format": "string", "status": "string", "error_code": "string", "title": "string", "markdown": "string", "n_blocks": "int",
    "warnings": "array<struct<code:string,message:string,page:int>>", "error_message": "string", "limit_name": "string", "actual": "long", "maximum": "long",
    "author": "string", "subject": "string", "page_count": "int", "properties": "map<string,string>",
    "assets": "array<struct<asset_id:string,file_name:string,media_type:string,sha256:string,data:binary>>",
}
RESULT = ", ".join(map(" ".join, FIELDS.items()))
MAX_INPUT_BYTES = DEFAULT.input_bytes

#: What a status row says of an error; nothing of the document is repeated.
MESSAGES = {
    "unsupported_format": "input format is not supported", "unsupported_input": "input uses an unsupported feature", "corrupt_input": "input is corrupt or structurally invalid",
    "encrypted_input": "encrypted input is not supported", "format_conflict": "input bytes do not match the extension", "ambiguous_format": "input format is ambiguous",
    "pdfium_unavailable": "the PDF runtime is unavailable", "conversion_failed": "conversion failed", "emit_error": "conversion failed",
}


def scan(spark: SparkSession, path: str, max_bytes: int = MAX_INPUT_BYTES) -> DataFrame:
    """Files of a folder; the length is checked before any content is read, larger files have a ``limit_actual`` instead."""
    return limited(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), max_bytes)


def limited(files: DataFrame, max_bytes: int) -> DataFrame:
    """A row for each of ``files``. The larger ones are a branch of their own that does not ask for content, so it is not read."""
    fields = [F.col("path").alias("doc_id"), "path", F.lit(None).cast("string").alias("source_url")]
    small = files.where(F.col("length") <= max_bytes).select(*fields, "content", F.lit(None).cast("long").alias("limit_actual"))
    return small.unionByName(files.where(F.col("length") > max_bytes).select(*fields, F.lit(None).cast("binary").alias("content"), F.col("length").alias("limit_actual"))).withColumn("limit_maximum", F.lit(max_bytes).cast("long"))


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` in as many partitions as there are cores, if a scan of few row groups gives less."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(2 * cores) if docs._jdf.rdd().getNumPartitions() < cores else docs


def with_format(docs: DataFrame) -> DataFrame:
    """Strong magic must agree with the extension; text formats are settled by their readers."""
    ext, magic = extension_format("path"), magic_format("content")
    container = ext.isin("zip", "epub", "docx", "pptx", "xlsx")
    kind = F.when(magic == "zip", F.when(container, ext).when(ext.isNull(), "ambiguous_format").otherwise("format_conflict")).when(
        magic.isNotNull(), F.when(ext.isNull() | (ext == magic), magic).otherwise("format_conflict")
    ).when(ext.isin("pdf", "png", "jpeg") | container, "format_conflict").otherwise(ext)
    return docs.withColumn("format", kind)


#: Formats by extension and by first bytes, as `veldmark.functions.paths` has them as expressions.
EXTENSIONS = {"pdf": "pdf", "html": "html", "htm": "html", "csv": "csv", "json": "json", "xml": "xml", "zip": "zip", "epub": "epub", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "png": "png", "jpg": "jpeg", "jpeg": "jpeg"}
MAGIC = {b"%PDF-": "pdf", images.PNG: "png", images.JPEG: "jpeg", b"PK\3\4": "zip", b"PK\5\6": "zip", b"PK\7\x08": "zip"}


def format_of(path: str | None, content: bytes) -> str | None:
    """`with_format` for one document."""
    ext = EXTENSIONS.get((path or "").replace("\\", "/").rpartition("/")[2].rpartition(".")[2].lower()) if "." in (path or "") else None
    magic = next((kind for head, kind in MAGIC.items() if content.startswith(head)), None)
    packed = ext in ("zip", "epub", "docx", "pptx", "xlsx")
    if magic == "zip":
        return ext if packed else "format_conflict" if ext else "ambiguous_format"
    if magic:
        return magic if ext in (None, magic) else "format_conflict"
    return "format_conflict" if packed or ext in ("pdf", "png", "jpeg") else ext


def is_html(content: bytes) -> bool:
    """Whether a tokenizer finds a tag, a comment or a document type."""
    return bool(re.search(r"<(?:[!?]|/.|[a-zA-Z][^>]*>)", content.decode("utf-8"), re.S))


def settle(kind: str | None, content: bytes, limits: Limits = DEFAULT) -> str:
    """The format of a document, by its content where magic and extension (``kind``) leave it open."""
    if kind in ("ambiguous_format", "format_conflict"):
        raise FormatError(MESSAGES[kind], kind)
    if kind in (None, "csv", "json", "xml"):
        content.decode("utf-8")
        found, code = structured.detect(content, kind, limits)
        if found:
            return found
        if kind or code != "unsupported_format" or not is_html(content):
            raise FormatError(MESSAGES[code], code)
        return "html"
    if kind == "html" and not is_html(content):
        raise FormatError(MESSAGES["format_conflict"], "format_conflict")
    return kind


def read(kind: str, content: bytes, source_url: str | None = None, path: str | None = None, limits: Limits = DEFAULT, ocr_lines: list | None = None) -> Document:
    """The document of ``content`` in the format ``kind``."""
    within("input_bytes", len(content), limits.input_bytes)
    if kind in ("png", "jpeg"):
        return images.convert(content, path, limits, ocr_lines)
    return READERS[kind](content, source_url, path, limits)


def _html(content, source_url, path, limits):
    walker = html.Converter(source_url, limits, path=path)
    title, blocks = walker.document(content.decode("utf-8"))
    return Document(blocks, "html", title, assets=walker.assets, warnings=walker.warnings)


def _structured(kind: str, blocks_of):
    def run(content, source_url, path, limits):
        blocks, properties, warnings = blocks_of(content, limits)
        return Document(blocks, kind, properties=properties, warnings=[(*w, None) for w in warnings])

    return run


def _zip(content, source_url, path, limits):
    return archive.convert(content, lambda inner, entry, url: read(inner, entry.data, url, limits=limits), limits)


def _pdf(content, source_url, path, limits):
    raise FormatError("pages of a PDF are read from their geometry", "pdfium_unavailable")


def _package(convert_package):
    return lambda content, source_url, path, limits: convert_package(content, limits)


#: Readers by format: (content, source_url, path, limits) to a `Document` or a `FormatError`. Others may be put in their place.
READERS = {
    "html": _html, "csv": _structured("csv", structured.csv_blocks), "json": _structured("json", structured.json_blocks), "xml": _structured("xml", structured.xml_blocks), "zip": _zip, "pdf": _pdf,
    "docx": _package(office.docx), "pptx": _package(office.pptx), "xlsx": _package(office.xlsx), "epub": _package(epub.convert),
}


def failure(doc_id, kind: str | None, code: str, limit: tuple = (None, None, None)) -> dict:
    name, actual, maximum = limit
    message = f"limit {name} exceeded: actual {actual}, maximum {maximum}" if name else MESSAGES.get(code, "conversion failed")
    return dict.fromkeys(FIELDS) | {"doc_id": doc_id, "format": kind, "status": "error", "error_code": code, "n_blocks": 0, "warnings": [], "error_message": message, "limit_name": name, "actual": actual, "maximum": maximum, "properties": {}, "assets": []}


def convert_one(doc_id, kind: str | None, content: bytes | None, source_url: str | None, path: str | None = None, limits: Limits = DEFAULT, prefix: str | None = None) -> dict:
    """A row of `RESULT`. Every error, also an unforeseen one, is the row's status."""
    try:
        if content is None:
            raise FormatError("no content")
        content = bytes(content)
        within("input_bytes", len(content), limits.input_bytes)
        kind = settle(kind, content, limits)
        d = read(kind, content, source_url, path, limits)
        assets = [{"asset_id": a.id, "file_name": a.file_name, "media_type": a.media_type, "sha256": hashlib.sha256(a.data).hexdigest(), "data": a.data} for a in d.assets]
        return {
            "doc_id": doc_id, "format": d.source_format, "status": "ok", "error_code": None, "title": d.title, "markdown": emit.markdown(d.blocks, assets=d.assets, prefix=prefix), "n_blocks": len(d.blocks),
            "warnings": [{"code": c, "message": m, "page": p} for c, m, p in d.warnings], "error_message": None, "limit_name": None, "actual": None, "maximum": None,
            "author": d.author, "subject": d.subject, "page_count": d.page_count, "properties": dict(sorted(d.properties.items())), "assets": assets,
        }
    except FormatError as e:
        return failure(doc_id, None if kind in ("ambiguous_format", "format_conflict") else kind, e.code, (e.limit, e.actual, e.maximum))
    except UnicodeDecodeError:
        return failure(doc_id, kind, "corrupt_input")
    except emit.EmitError:
        return failure(doc_id, kind, "emit_error")
    except Exception:
        return failure(doc_id, kind, "conversion_failed")


def stem(path: str) -> str:
    """A file's name without its extension."""
    name = path.replace("\\", "/").rpartition("/")[2]
    return name.rpartition(".")[0] or name


def convert(docs: DataFrame, limits: Limits = DEFAULT, asset_prefix: str | None = None) -> DataFrame:
    """``docs`` (doc_id, path, source_url, content, and limit_actual and limit_maximum if they are there) to `RESULT` rows.

    In ``asset_prefix`` the text {stem} stands for the name of the document's file.
    """
    for name in ("limit_actual", "limit_maximum"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("long"))

    def run(frames):
        for pdf in frames:
            rows = []
            for doc_id, kind, url, path, content, actual, maximum in zip(*(pdf[c] for c in ("doc_id", "format", "source_url", "path", "content", "limit_actual", "limit_maximum"))):
                if not pd.isna(actual):
                    rows.append(failure(str(doc_id), None, "limit_exceeded", ("input_bytes", int(actual), int(maximum))))
                else:
                    rows.append(convert_one(str(doc_id), kind if isinstance(kind, str) else None, content, url if isinstance(url, str) else None, path if isinstance(path, str) else None, limits, asset_prefix and asset_prefix.replace("{stem}", stem(path) if isinstance(path, str) else "")))
            out = pd.DataFrame(rows)
            yield out.astype({"n_blocks": "Int32", "page_count": "Int32", "actual": "Int64", "maximum": "Int64"})

    return with_format(docs).select("doc_id", "format", "source_url", "path", "content", "limit_actual", "limit_maximum").mapInPandas(run, RESULT)


def titles(docs: DataFrame) -> DataFrame:
    """(doc_id, title) of HTML documents (doc_id, content), read to the end of the title only."""

    def run(frames):
        for pdf in frames:
            found = [html.title(bytes(c).decode("utf-8", "replace")) if c is not None else None for c in pdf["content"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype(str), "title": found})

    return docs.select("doc_id", "content").mapInPandas(run, "doc_id string, title string")


def _links(items: list):
    """The destinations of all links in a tree of blocks or inlines, in order."""
    for x in items:
        if isinstance(x, tuple) and x and x[0] == "link":
            yield x[1]
        if isinstance(x, (tuple, list)):
            yield from _links(x)


def links(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, url) of the links of HTML documents (doc_id, source_url, content); documents that fail have none."""

    def run(frames):
        for pdf in frames:
            out = []
            for doc_id, url, content in zip(pdf["doc_id"], pdf["source_url"], pdf["content"]):
                try:
                    found = _links(read("html", bytes(content), url if isinstance(url, str) else None).blocks)
                    out += [(str(doc_id), i, x) for i, x in enumerate(found)]
                except (FormatError, UnicodeDecodeError, TypeError):
                    continue
            yield pd.DataFrame(out, columns=["doc_id", "ord", "url"]).astype({"ord": "int32"})

    return docs.select("doc_id", "source_url", "content").mapInPandas(run, "doc_id string, ord int, url string")
