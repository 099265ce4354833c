"""ZIP archives, read strictly: every byte belongs to a record, both headers of an entry agree, contents match their digest.

The module also has what packages of parts share: relationships, content types, paths between parts, images as assets.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

from veldmark.operators import images
from veldmark.operators.errors import DEFAULT, FormatError, Limits, within
from veldmark.operators.model import Asset, Document
from veldmark.operators.structured import Node, parse_xml

# Layouts and signatures of a ZIP file.
_END, _CENTRAL, _LOCAL, _SIZES = struct.Struct("<4s4HIIH"), struct.Struct("<4s6H3I5HII"), struct.Struct("<4s5H3IHH"), struct.Struct("<3I")
END, CENTRAL, LOCAL, DESCRIPTOR = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04", b"PK\x07\x08"
STREAMED, UTF8, ENCRYPTED = 1 << 3, 1 << 11, 1 | 1 << 6
ZIP64, AES = 0x0001, 0x9901
FILE, FOLDER, KIND = 0o100000, 0o040000, 0o170000

# Names of packages.
RELATIONSHIPS = "http://schemas.openxmlformats.org/package/2006/relationships"
CONTENT_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
STRICT = "http://purl.oclc.org/ooxml/"


class Entry(NamedTuple):
    name: str
    data: bytes
    method: int


class _Member(NamedTuple):
    name: str
    raw: bytes
    flags: int
    method: int
    sizes: tuple[int, int, int]  # crc, packed, unpacked
    offset: int


class Archive:
    """The entries of an archive in the order of its bytes, folders left out."""

    def __init__(self, content: bytes, limits: Limits = DEFAULT):
        self.content, self.limits = content, limits
        within("input_bytes", len(content), limits.input_bytes)
        members, central = self._directory()
        records = sorted((m.offset, *self._extract(m), m) for m in members)
        if not records:
            raise FormatError("an archive without entries")
        at = 0
        for start, end, _, _ in records:
            if start != at:
                raise FormatError("the records leave a gap or overlap")
            at = end
        if at != central:
            raise FormatError("the records do not reach the directory")
        self.first = records[0][3].name
        self.entries = [Entry(m.name, data, m.method) for _, _, data, m in records if not m.name.endswith("/")]
        self._by_name = {e.name: e for e in self.entries}

    def get(self, name: str) -> bytes | None:
        entry = self._by_name.get(name)
        return entry.data if entry else None

    def need(self, name: str) -> bytes:
        data = self.get(name)
        if data is None:
            raise FormatError(f"{name} is missing")
        return data

    def _unpack(self, layout: struct.Struct, at: int) -> tuple:
        if at < 0 or at + layout.size > len(self.content):
            raise FormatError("a record is cut off")
        return layout.unpack_from(self.content, at)

    def _slice(self, at: int, size: int) -> bytes:
        if at + size > len(self.content):
            raise FormatError("a record is cut off")
        return self.content[at : at + size]

    def _directory(self) -> tuple[list[_Member], int]:
        content, limits = self.content, self.limits
        at = content.rfind(END, max(0, len(content) - _END.size - 0xFFFF))
        while at >= 0 and (at + _END.size > len(content) or at + _END.size + _END.unpack_from(content, at)[7] != len(content)):
            at = content.rfind(END, max(0, len(content) - _END.size - 0xFFFF), at + 3)
        if at < 0:
            raise FormatError("no end record")
        _, disk, central_disk, here, count, size, central, _ = _END.unpack_from(content, at)
        if disk or central_disk or here != count or count == 0xFFFF:
            raise FormatError("several disks or ZIP64")
        within("archive_entries", count, min(limits.archive_entries, limits.input_bytes // 30))
        if central + size != at:
            raise FormatError("the directory does not end at the end record")
        members, names, total, cursor = [], set(), 0, central
        for _ in range(count):
            sign, made, _, flags, method, _, _, crc, packed, unpacked, n, extra, comment, _, _, mode, offset = self._unpack(_CENTRAL, cursor)
            if sign != CENTRAL:
                raise FormatError("no directory record")
            if flags & ENCRYPTED:
                raise FormatError("an entry is encrypted", "encrypted_input")
            if flags & ~(STREAMED | UTF8) or method not in (0, 8) or 0xFFFFFFFF in (packed, unpacked):
                raise FormatError("an entry uses what is not read")
            within("archive_entry_compressed_bytes", packed, min(limits.archive_entry_compressed_bytes, limits.input_bytes))
            within("archive_entry_uncompressed_bytes", unpacked, min(limits.archive_entry_uncompressed_bytes, limits.input_bytes))
            if unpacked > 1024:
                within("archive_expansion_ratio", unpacked, packed * limits.archive_expansion_ratio)
            total = within("archive_total_uncompressed_bytes", total + unpacked, min(limits.archive_total_uncompressed_bytes, limits.input_bytes))
            cursor += _CENTRAL.size
            raw = self._slice(cursor, n)
            check_extra(self._slice(cursor + n, extra))
            self._slice(cursor + n + extra, comment)
            name = entry_name(raw, flags)
            if name in names:
                raise FormatError("two entries have one name")
            names.add(name)
            kind, folder = (mode >> 16) & KIND if made >> 8 == 3 else 0, name.endswith("/")
            if kind not in (0, FILE, FOLDER) or (kind and (kind == FOLDER) != folder) or (mode & 0x10 and not folder):
                raise FormatError("an entry is neither a file nor a folder")
            members.append(_Member(name, raw, flags, method, (crc, packed, unpacked), offset))
            cursor += n + extra + comment
        if cursor != at:
            raise FormatError("the directory has another length than its records")
        return members, central

    def _extract(self, m: _Member) -> tuple[int, bytes]:
        """(end of the record, contents)."""
        sign, _, flags, method, _, _, *sizes, n, extra = self._unpack(_LOCAL, m.offset)
        at = m.offset + _LOCAL.size
        if sign != LOCAL or (flags, method) != (m.flags, m.method) or self._slice(at, n) != m.raw:
            raise FormatError("the headers of an entry disagree")
        if tuple(sizes) != ((0, 0, 0) if flags & STREAMED else m.sizes):
            raise FormatError("the headers of an entry disagree")
        check_extra(self._slice(at + n, extra))
        crc, packed, unpacked = m.sizes
        at += n + extra
        body = self._slice(at, packed)
        end = at + packed
        if flags & STREAMED:
            fits = [x for x in (end, end + 4) if (x == end or self.content[end:x] == DESCRIPTOR) and self.content[x : x + 12] == _SIZES.pack(*m.sizes)]
            if len(fits) != 1:
                raise FormatError("the sizes after an entry are missing or ambiguous")
            end = fits[0] + 12
        if m.method:
            inflate = zlib.decompressobj(-15)
            try:
                data = inflate.decompress(body, unpacked + 1)
            except zlib.error as e:
                raise FormatError("a broken deflate stream") from e
            within("archive_entry_uncompressed_bytes", len(data), unpacked)
            if not inflate.eof or inflate.unused_data or inflate.unconsumed_tail:
                raise FormatError("a deflate stream ends elsewhere")
        else:
            data = body
        if len(data) != unpacked or zlib.crc32(data) != crc:
            raise FormatError("contents do not match their digest")
        return end, data


def check_extra(extra: bytes) -> None:
    while extra:
        if len(extra) < 4:
            raise FormatError("an extra field is cut off")
        kind, size = struct.unpack_from("<HH", extra)
        if len(extra) < 4 + size or kind in (ZIP64, AES):
            raise FormatError("an extra field is cut off or not read")
        extra = extra[4 + size :]


def _drive(path: str) -> bool:
    return len(path) > 1 and path[1] == ":" and path[0].isascii() and path[0].isalpha()


def entry_name(raw: bytes, flags: int) -> str:
    """The name with plain slashes and no empty or dot parts; names that leave the archive are errors."""
    try:
        name = raw.decode("utf-8" if flags & UTF8 else "ascii").replace("\\", "/")
    except UnicodeDecodeError as e:
        raise FormatError("a name is not in its character set") from e
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if "\0" in name or name.startswith("/") or _drive(name) or ".." in parts or not parts:
        raise FormatError("an unsafe name")
    return "/".join(parts) + ("/" if name.endswith("/") else "")


def resolve(base: str, target: str) -> str:
    """The part that a relative ``target`` in part ``base`` names."""
    target = target.replace("\\", "/")
    if "\0" in target or target.startswith("/") or ":" in target:
        raise FormatError("an unsafe target")
    parts = base.split("/")[:-1]
    for p in target.split("/"):
        if p == "..":
            if not parts:
                raise FormatError("a target leaves the package")
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    if not parts:
        raise FormatError("a target names nothing")
    return "/".join(parts)


def part_name(path: str) -> str:
    """A package-absolute name without its first slash."""
    path = path.replace("\\", "/")
    parts = path.split("/")
    if "\0" in path or path.startswith("/") or ":" in path or ".." in parts:
        raise FormatError("an unsafe part name")
    name = "/".join(p for p in parts if p not in ("", "."))
    if not name:
        raise FormatError("an empty part name")
    return name


def attribute(node: Node, name: str) -> str:
    value = node.get(name)
    if not value:
        raise FormatError(f"{node.local} has no {name}")
    return value


class Relationship(NamedTuple):
    kind: str
    target: str
    external: bool


def relationships(archive: Archive, path: str) -> dict[str, Relationship]:
    """Relationships by id, of a part of relationships that may be missing."""
    data = archive.get(path)
    if data is None:
        return {}
    root, out = parse_xml(data), {}
    if not root.named(RELATIONSHIPS, "Relationships"):
        raise FormatError("the root of relationships has another name")
    for node in root.elements():
        mode = node.get("TargetMode")
        if not node.named(RELATIONSHIPS, "Relationship") or mode not in (None, "Internal", "External"):
            raise FormatError("a foreign relationship")
        id_ = attribute(node, "Id")
        if id_ in out:
            raise FormatError("two relationships have one id")
        out[id_] = Relationship(attribute(node, "Type"), attribute(node, "Target"), mode == "External")
    return out


class ContentTypes:
    """Media types by part, else by extension."""

    def __init__(self, root: Node):
        self.defaults, self.overrides = {}, {}
        for node in root.elements():
            if node.named(CONTENT_TYPES, "Default"):
                table, key = self.defaults, attribute(node, "Extension").lower()
                if not (key.isascii() and key.isalnum()):
                    raise FormatError("an extension is not of letters and digits")
            elif node.named(CONTENT_TYPES, "Override"):
                name = attribute(node, "PartName")
                if not name.startswith("/"):
                    raise FormatError("a part name is not absolute")
                table, key = self.overrides, part_name(name[1:])
            else:
                raise FormatError("a foreign content type")
            if key in table:
                raise FormatError("two content types for one name")
            table[key] = attribute(node, "ContentType")

    def of(self, part: str) -> str | None:
        _, dot, extension = part.rpartition(".")
        return self.overrides.get(part) or (self.defaults.get(extension.lower()) if dot else None)


def _transitional(root: Node) -> Node:
    if (root.uri or "").startswith(STRICT):
        raise FormatError("the strict profile is not read", "unsupported_input")
    return root


def office_package(archive: Archive, main: str, media_type: str) -> ContentTypes:
    """Content types of a package whose one main part is ``main`` with that type."""
    root = _transitional(parse_xml(archive.need("[Content_Types].xml")))
    if not root.named(CONTENT_TYPES, "Types"):
        raise FormatError("the root of content types has another name")
    types = ContentTypes(root)
    if types.of(main) != media_type:
        raise FormatError("the main part has another content type")
    data = archive.get("_rels/.rels")
    if data is not None:
        rels = _transitional(parse_xml(data))
        if any((n.get("Type") or "").startswith(STRICT) for n in rels.elements(RELATIONSHIPS, "Relationship")):
            raise FormatError("the strict profile is not read", "unsupported_input")
    found = [r for r in relationships(archive, "_rels/.rels").values() if r.kind == f"{OFFICE}/officeDocument"]
    if len(found) != 1 or found[0].external or resolve("", found[0].target) != main:
        raise FormatError("not one local main part")
    _transitional(parse_xml(archive.need(main)))
    return types


class ImageParts:
    """Image parts as assets of a document, each part once, numbered in the order of first use."""

    def __init__(self, archive: Archive, types: ContentTypes, document: Document):
        self.archive, self.types, self.document, self.ids = archive, types, document, {}

    def add(self, part: str) -> str:
        if part not in self.ids:
            n = within("assets", len(self.ids) + 1, self.archive.limits.assets)
            data, media_type = self.archive.need(part), self.types.of(part)
            kind = images.embedded(data, media_type, self.archive.limits)
            if part.rpartition(".")[2].lower() not in images.EXTENSIONS[kind] or "." not in part:
                raise FormatError("an image has another extension than its type")
            self.ids[part] = f"asset-{n:03d}"
            self.document.assets.append(Asset(self.ids[part], f"image-{n:03d}-{part.rpartition('/')[2]}", media_type, data))
        return self.ids[part]


#: Formats of entries that an archive's conversion reads, by extension.
INNER = {"csv": "csv", "json": "json", "xml": "xml", "html": "html", "htm": "html"}


def inner_format(name: str) -> str | None:
    stem, dot, extension = name.rpartition("/")[2].rpartition(".")
    return INNER.get(extension.lower()) if dot and stem else None


def convert(content: bytes, convert_inner, limits: Limits = DEFAULT) -> Document:
    """The first entry by name that can be converted; ``convert_inner`` (format, entry, base URL) makes its document.

    An archive inside the archive is an error. Without such an entry the document lists the names.
    """
    archive = Archive(content, limits)
    if any(e.data.startswith((LOCAL, END)) for e in archive.entries):
        raise FormatError("an archive inside an archive", "unsupported_format")
    entries = sorted(archive.entries, key=lambda e: e.name.encode())
    usable = [e for e in entries if inner_format(e.name)]
    count = {"entry_count": str(len(entries))}
    if not usable:
        return Document([("list", False, None, [[("paragraph", [("text", e.name)])] for e in entries])], "zip", properties=count)
    first, kind = usable[0], inner_format(usable[0].name)
    document = convert_inner(kind, first, f"zip://local/{first.name}")
    document.source_format = f"zip ({kind})"
    document.properties |= count | {"selected_entry": first.name, "convertible_entry_count": str(len(usable))}
    if len(usable) > 1:
        rest = ", ".join(e.name for e in usable[1:])
        document.warn("additional_archive_entries_skipped", f"converted {first.name}; additional supported archive entries skipped: {rest}")
    return document
