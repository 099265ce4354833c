"""Path and link policy as Column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that Windows keeps for devices, whatever their extension.
RESERVED = r"^(con|prn|aux|nul|clock\$|conin\$|conout\$|globalroot|(com|lpt)[1-9¹²³])$"


def reserved_component(c: Column | str) -> Column:
    """A path component that names a device: trailing spaces and dots off, stem before the first dot, any case."""
    c = F.col(c) if isinstance(c, str) else c
    stem = F.substring_index(F.regexp_replace(c, r"[ .]+$", ""), ".", 1)
    return F.lower(F.regexp_replace(stem, r" +$", "")).rlike(RESERVED)


def reserved_path(c: Column | str) -> Column:
    return F.exists(F.split(c, r"[/\\]"), reserved_component)


def unsafe_link(c: Column | str) -> Column:
    """Scheme javascript or data once white space and control characters are out."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.instr(c, ":") > 0) & F.lower(F.regexp_replace(F.substring_index(c, ":", 1), r"[\s\p{Cntrl}]", "")).isin("javascript", "data")


def safe_relative(c: Column | str) -> Column:
    """An anchor, or a path that stays below the document."""
    c = F.col(c) if isinstance(c, str) else c
    path = F.translate(c, "\\", "/")
    return c.startswith("#") | ~((F.instr(path, ":") > 0) | path.startswith("/") | F.array_contains(F.split(path, "/"), ".."))


def external_reference(c: Column | str) -> Column:
    """A reference with a scheme, or to a host."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "").rlike(r"^//|^[A-Za-z0-9+.-]*:")


def pdf_safe_scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(c, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https", "mailto", "file")


def web_url(c: Column | str) -> Column:
    """An http or https URL with a host and without user or password."""
    c = F.col(c) if isinstance(c, str) else c
    authority = F.regexp_extract(c, r"^https?://([^/?#]*)", 1)
    return authority.rlike(r"^(\[[0-9A-Fa-f:.]+\]|[^\s:@\\\[\]<>^|%]+)(:[0-9]{0,5})?$")


def preview_link(c: Column | str) -> Column:
    """What a preview may follow: an anchor of letters, digits and few marks, or a web URL; null for all else."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^#[\p{L}\p{N}_.:-]+$") | web_url(c), c)


def preview_image(c: Column | str) -> Column:
    """Images of a preview come from the local asset host alone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.lower(c).rlike(r"^asset://localhost([/?#:]|$)"), c)


def unsafe_path(c: Column | str) -> Column:
    """Paths that are no plain local ones: hosts, schemes, drives, devices, network mounts, reserved components."""
    c = F.col(c) if isinstance(c, str) else c
    slash = F.translate(c, "\\", "/")
    return slash.isNull() | F.lower(slash).rlike(r"^//|^/\?\?/|^[a-z]:|^[a-z0-9+.-]+://|^/(device|global\?\?|dosdevices)/|^/(network/servers|net|afs)(/|$)") | reserved_path(slash)


def percent_path(c: Column | str) -> Column:
    """Bytes of UTF-8 as %XX, but for letters, digits and / . - _ of ASCII."""
    c = F.col(c) if isinstance(c, str) else c
    coded = lambda x: F.regexp_replace(F.hex(F.encode(x, "utf-8")), "(..)", "%$1")
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9/._-]+|[^A-Za-z0-9/._-]+)"), F.lit(1)), lambda x: F.when(x.rlike("^[A-Za-z0-9/._-]"), x).otherwise(coded(x))), "")


def html_signal(c: Column | str) -> Column:
    """Whether a tokenizer would find a tag, a comment or a document type in a text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(r"(?s)<(?:[!?]|/.|[a-zA-Z][^>]*>)")


def extension_format(c: Column | str) -> Column:
    """Format by extension, without regard to ASCII case; null for unknown extensions."""
    ext = F.lower(F.regexp_extract(c, r"\.([^./\\]+)$", 1))
    known = {"pdf": "pdf", "html": "html", "htm": "html", "csv": "csv", "json": "json", "xml": "xml", "zip": "zip", "epub": "epub", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "png": "png", "jpg": "jpeg", "jpeg": "jpeg"}
    out = F.lit(None).cast("string")
    for name, kind in known.items():
        out = F.when(ext == name, kind).otherwise(out)
    return out


def magic_format(content: Column | str) -> Column:
    """pdf, png, jpeg or zip by the first bytes; null otherwise."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("255044462D"), "pdf").when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8"), "jpeg")
        .when(head.rlike("^504B(0304|0506|0708)"), "zip")
    )
