"""Markdown files with their assets, published from the executors, and the envelope that reports each document.

A document is staged beside its target and moved into place, assets first and Markdown last, so a reader who sees the Markdown sees
its assets. What a failed move has put aside goes back. A task that runs again finds its own output and reports it as done. On
a store without atomic moves a reader may see the assets alone for a while, never the Markdown alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldmark.operators.errors import FormatError

MANIFEST, MANIFEST_SCHEMA, ENVELOPE_SCHEMA = ".veldmark-assets.json", "veldmark.assets/v1", "veldmark.convert/v1"
PUBLISHED = "doc_id string, status string, error_code string, markdown_path string, assets_path string"
DEVICE = re.compile(r"(?:con|prn|aux|nul|clock\$|conin\$|conout\$|globalroot|(?:com|lpt)[1-9¹²³])")

# Exit codes of a conversion by what failed.
EXIT_OK, EXIT_USAGE, EXIT_INPUT, EXIT_CONVERSION, EXIT_OUTPUT, EXIT_CANCELLED = 0, 2, 3, 4, 5, 6
EXIT_CODES = {
    **dict.fromkeys(("invalid_output", "invalid_assets_path", "source_output_alias", "unsafe_path", "invalid_request"), EXIT_USAGE),
    **dict.fromkeys(("input_io", "input_changed", "input_symlink", "input_not_regular", "ambiguous_format", "format_conflict"), EXIT_INPUT),
    **dict.fromkeys(("output_exists", "unowned_assets", "invalid_manifest", "invalid_asset_name", "duplicate_asset_name", "output_io"), EXIT_OUTPUT),
    "cancelled": EXIT_CANCELLED,
}


def canonical(name: str) -> str:
    """The form in which two file names are the same."""
    return unicodedata.normalize("NFKC", name).lower()


def safe_basename(name: str) -> bool:
    device = DEVICE.fullmatch(name.rstrip(" .").partition(".")[0].rstrip(" ").lower())
    return not (not name or name in (".", "..") or re.search(r"[/\\:\x00-\x1f\x7f]", name) or name.endswith((".", " ")) or canonical(name) == MANIFEST or device)


def check_assets(names: list[str]) -> None:
    """Every name is a plain file name, and no two are the same but for case or form."""
    if not all(map(safe_basename, names)):
        raise FormatError("an asset's name is no plain file name", "invalid_asset_name")
    if len({*map(canonical, names)}) < len(names):
        raise FormatError("two assets have one name", "duplicate_asset_name")


def check_target(markdown: str, source: str | None = None, assets: str | None = None) -> tuple[str, str]:
    """(Markdown path, assets folder) of a target that may be written: `.md`, not the source nor above it, assets beside it."""
    head, _, name = markdown.rpartition("/")
    if not name.endswith(".md") or not safe_basename(name) or name == ".md":
        raise FormatError("the output is no .md file", "invalid_output")
    derived = f"{head}/{name[:-3]}.assets" if head else f"{name[:-3]}.assets"
    if source is not None and (source == markdown or source == derived or source.startswith(derived + "/")):
        raise FormatError("the output would replace its source", "source_output_alias")
    if assets is not None and assets.rstrip("/") != derived:
        raise FormatError("assets go beside the Markdown", "invalid_assets_path")
    return markdown, derived


def manifest(document: str, assets: list[dict]) -> bytes:
    rows = sorted(({"file_name": a["file_name"], "media_type": a["media_type"], "sha256": a["sha256"]} for a in assets), key=lambda a: a["file_name"])
    return (json.dumps({"schema_version": MANIFEST_SCHEMA, "document": document, "assets": rows}, indent=2, ensure_ascii=False) + "\n").encode()


class Folder:
    """One output folder on any file system that Arrow knows."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.types = fs.FileType
        self.selector = fs.FileSelector

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(path).type != self.types.NotFound

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(path, compression=None) as f:
            return f.read()

    def write(self, path: str, data: bytes) -> None:
        with self.fs.open_output_stream(path, compression=None) as f:
            f.write(data)

    def remove(self, path: str) -> None:
        if self.exists(path):
            (self.fs.delete_dir if self.fs.get_file_info(path).type == self.types.Directory else self.fs.delete_file)(path)

    def owned(self, assets: str, document: str) -> list[dict]:
        """The manifest's rows of an assets folder that holds exactly what its manifest lists."""
        if not self.exists(f"{assets}/{MANIFEST}"):
            raise FormatError("a folder that no publication has made", "unowned_assets")
        try:
            found = json.loads(self.read(f"{assets}/{MANIFEST}"))
            rows = {a["file_name"]: a["sha256"] for a in found["assets"]}
            fine = found["schema_version"] == MANIFEST_SCHEMA and found["document"] == document and len(rows) == len(found["assets"]) and all(map(safe_basename, rows))
        except (ValueError, KeyError, TypeError) as e:
            raise FormatError("a manifest that cannot be read", "invalid_manifest") from e
        if not fine:
            raise FormatError("a manifest of something else", "invalid_manifest")
        there = {f.base_name for f in self.fs.get_file_info(self.selector(assets))}
        if there != {*rows, MANIFEST} or any(hashlib.sha256(self.read(f"{assets}/{n}")).hexdigest() != h for n, h in rows.items()):
            raise FormatError("a folder whose files have changed", "unowned_assets")
        return found["assets"]

    def publish(self, name: str, markdown: str, assets: list[dict], replace: bool) -> tuple[str, str | None]:
        target, folder = check_target(f"{self.root.rstrip('/')}/{name}")
        check_assets([a["file_name"] for a in assets])
        text, listed = markdown.encode(), manifest(name, assets)
        old = [p for p in (folder, target) if self.exists(p)]
        same = target in old and self.read(target) == text and (folder in old) == bool(assets)
        if same and (not assets or (self.exists(f"{folder}/{MANIFEST}") and self.read(f"{folder}/{MANIFEST}") == listed and self.owned(folder, name))):
            return target, folder if assets else None  # a task that ran before has done this
        if old and not replace:
            raise FormatError("the output exists", "output_exists")
        if folder in old:
            self.owned(folder, name)
        stage = f"{self.root.rstrip('/')}/.veldmark-{uuid.uuid4().hex}"
        moved: list[tuple[str, str]] = []
        try:
            self.fs.create_dir(f"{stage}/old")
            self.write(f"{stage}/new.md", text)
            if assets:
                self.fs.create_dir(f"{stage}/new.assets")
                for a in assets:
                    self.write(f"{stage}/new.assets/{a['file_name']}", bytes(a["data"]))
                self.write(f"{stage}/new.assets/{MANIFEST}", listed)
            steps = [(p, f"{stage}/old/{i}") for i, p in enumerate(old)] + [(f"{stage}/new.assets", folder)] * bool(assets) + [(f"{stage}/new.md", target)]
            for a, b in steps:
                self.fs.move(a, b)
                moved.append((a, b))
        except OSError as e:
            for a, b in reversed(moved):
                self.fs.move(b, a)
            raise FormatError("the output could not be written", "output_io") from e
        finally:
            self.remove(stage)
        return target, folder if assets else None


def publish(results: DataFrame, folder: str, replace: bool = False) -> DataFrame:
    """Write ``results`` (doc_id, name, status, error_code, markdown, assets) under ``folder``; a row of `PUBLISHED` for each.

    ``name`` is the Markdown file's name. Rows that failed before are passed on and write nothing.
    """

    def run(frames):
        out = Folder(folder)
        out.fs.create_dir(out.root, recursive=True)
        for pdf in frames:
            rows = []
            for doc_id, name, status, code, markdown, assets in zip(*(pdf[c] for c in ("doc_id", "name", "status", "error_code", "markdown", "assets"))):
                if status != "ok":
                    rows.append((doc_id, status, code, None, None))
                    continue
                try:
                    rows.append((doc_id, "ok", None, *out.publish(name or "", markdown or "", list(assets if assets is not None else []), replace)))
                except FormatError as e:
                    rows.append((doc_id, "error", e.code, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PUBLISHED.split(", ")])

    columns = [F.col("doc_id").cast("string").alias("doc_id"), "name", "status", "error_code", "markdown", "assets"]
    return results.select(*columns).mapInPandas(run, PUBLISHED)


def envelope(results: DataFrame, markdown_path: Column | None = None, assets_path: Column | None = None) -> DataFrame:
    """(doc_id, envelope, exit_code) of rows as `veldmark.sources.documents.convert` gives them; absent fields are left out."""
    fine = F.col("status") == "ok"
    none = F.lit(None).cast("string")
    metadata = F.struct("title", "author", "subject", F.when(fine, F.col("format")).alias("source_format"), "page_count", F.when(F.size("properties") > 0, F.col("properties")).alias("properties"))
    body = F.struct(
        F.lit(ENVELOPE_SCHEMA).alias("schema_version"), F.when(fine, "succeeded").otherwise("failed").alias("status"), F.when(fine, markdown_path if markdown_path is not None else none).alias("markdown_path"),
        F.when(fine, assets_path if assets_path is not None else none).alias("assets_path"), metadata.alias("metadata"), "warnings",
        F.when(~fine, F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message"))).alias("error"),
    )
    codes = F.create_map(*(F.lit(x) for pair in EXIT_CODES.items() for x in pair))
    code = F.when(fine, EXIT_OK).otherwise(F.coalesce(codes[F.col("error_code")], F.lit(EXIT_CONVERSION)))
    return results.select("doc_id", F.to_json(body, {"ignoreNullFields": "true"}).alias("envelope"), code.alias("exit_code"))
