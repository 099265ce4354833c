"""PNG and JPEG files checked to their last byte, without decoding pixels, and the text in their metadata."""

from __future__ import annotations

import re
import struct
import zlib
from typing import NamedTuple

from veldmark.operators.errors import DEFAULT, FormatError, Limits, within
from veldmark.operators.model import Asset, Document

PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"

# Fixed values of the two formats.
EXTENSIONS = {"png": ("png",), "jpeg": ("jpg", "jpeg")}
MEDIA_TYPES = {"png": "image/png", "jpeg": "image/jpeg"}
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
SEMANTIC = {"title", "description", "comment", "caption", "subject", "author"}
EXIF = {0x010E: "exif.description", 0x010F: "exif.make", 0x0110: "exif.model", 0x0132: "exif.datetime"}


class Image(NamedTuple):
    kind: str
    width: int
    height: int
    metadata: dict[str, str]
    semantic: bool


def check_size(width: int, height: int, limits: Limits) -> None:
    within("image_width", width, limits.image_width)
    within("image_height", height, limits.image_height)
    within("image_pixels", width * height, limits.image_pixels)


class _Text:
    """Metadata of an image within its budget."""

    def __init__(self, limits: Limits):
        self.limits, self.used, self.found, self.semantic = limits, 0, {}, False

    def spend(self, n: int) -> None:
        self.used = within("image_metadata_bytes", self.used + n, self.limits.image_metadata_bytes)

    def keyword(self, key: str, value: str) -> None:
        if not key or len(key.encode()) > 79 or key.strip() != key:
            raise FormatError("a keyword is empty, too long or padded")
        self.found[f"png.{key}"] = value
        self.semantic |= key.lower() in SEMANTIC and bool(value.strip())


def chunks(content: bytes, limits: Limits):
    """(kind, data, end) of the chunks of a PNG, digests checked."""
    at, n = len(PNG), 0
    while at < len(content):
        n = within("image_chunks", n + 1, limits.image_segments)
        if at + 12 > len(content):
            raise FormatError("a chunk is cut off")
        size, kind = struct.unpack_from(">I4s", content, at)
        end = at + 12 + size
        if end > len(content) or zlib.crc32(content[at + 4 : end - 4]) != struct.unpack_from(">I", content, end - 4)[0]:
            raise FormatError("a chunk is cut off or does not match its digest")
        yield kind, content[at + 8 : end - 4], end
        at = end


def _split(data: bytes) -> tuple[bytes, bytes]:
    head, zero, rest = data.partition(b"\0")
    if not zero:
        raise FormatError("a text without a separator")
    return head, rest


def _inflate(data: bytes, most: int) -> bytes:
    """At most ``most`` + 1 bytes of a zlib stream."""
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(data, most + 1)
    except zlib.error as e:
        raise FormatError("a broken zlib stream") from e
    if len(out) <= most and not stream.eof:
        raise FormatError("a zlib stream is cut off")
    return out


def png(content: bytes, limits: Limits = DEFAULT) -> Image:
    text, header, packed, palette, seen, ended = _Text(limits), None, [], 0, [], False
    for kind, data, end in chunks(content, limits):
        if (kind == b"IHDR") != (not seen):
            raise FormatError("the header is not the first chunk, or comes twice")
        before = b"IDAT" in seen
        if kind == b"IHDR":
            if len(data) != 13:
                raise FormatError("a header of another length")
            width, height, depth, color, method, filters, interlace = header = struct.unpack(">II5B", data)
            if not width or not height or depth not in DEPTHS.get(color, ()) or method or filters or interlace > 1:
                raise FormatError("a header that the format does not know")
            check_size(width, height, limits)
            if interlace:
                raise FormatError("interlaced images are not read", "unsupported_input")
        elif kind == b"PLTE":
            palette = len(data) // 3
            most = 1 << depth if color == 3 else 256
            if before or {b"PLTE", b"tRNS"} & {*seen} or color in (0, 4) or len(data) % 3 or not 1 <= palette <= most or palette > 256:
                raise FormatError("a palette that does not fit")
        elif kind == b"tRNS":
            fits = {0: len(data) == 2, 2: len(data) == 6, 3: 1 <= len(data) <= palette}.get(color, False)
            if before or kind in seen or not fits:
                raise FormatError("a transparency that does not fit")
        elif kind == b"IDAT":
            if (before and seen[-1] != b"IDAT") or (color == 3 and not palette):
                raise FormatError("image data out of place")
            packed.append(data)
        elif kind == b"tEXt":
            text.spend(len(data))
            key, value = _split(data)
            text.keyword(key.decode("latin-1"), value.decode("latin-1"))
        elif kind == b"zTXt":
            key, value = _split(data)
            if value[:1] != b"\0":
                raise FormatError("a compression that is not known")
            value = _inflate(value[1:], limits.image_metadata_bytes)
            text.spend(len(value))
            text.keyword(key.decode("latin-1"), value.decode("latin-1"))
        elif kind == b"iTXt":
            text.spend(len(data))
            key, value = _split(data)
            if value[:2] != b"\0\0":
                raise FormatError("a compressed text is not read")
            value = _split(_split(value[2:])[1])[1]
            try:
                text.keyword(key.decode(), value.decode())
            except UnicodeDecodeError as e:
                raise FormatError("a text is not UTF-8") from e
        elif kind == b"IEND":
            if data or end != len(content):
                raise FormatError("bytes after the end")
            ended = True
        elif kind[:1].isupper():
            raise FormatError("a chunk that must be understood is not known")
        seen.append(kind)
    if not ended or not packed:
        raise FormatError("no image data or no end")
    row = (width * CHANNELS[color] * depth + 7) // 8 + 1
    _rows(packed, row, row * height)
    return Image("png", width, height, text.found, text.semantic)


def _rows(packed: list[bytes], row: int, size: int) -> None:
    """The stream holds exactly ``size`` bytes, and each row begins with a known filter."""
    stream, done = zlib.decompressobj(), 0
    try:
        for i, data in enumerate(packed):
            while data:
                out = stream.decompress(data, 1 << 20)
                starts = range(-done % row, len(out), row)
                if done + len(out) > size or any(out[k] > 4 for k in starts):
                    raise FormatError("image data longer than declared, or an unknown filter")
                done += len(out)
                data = stream.unconsumed_tail
            if stream.eof and (stream.unused_data or any(packed[i + 1 :])):
                raise FormatError("bytes after the image data")
        done += len(stream.flush())
    except zlib.error as e:
        raise FormatError("a broken zlib stream") from e
    if done != size or not stream.eof:
        raise FormatError("image data of another size than declared")


_MARKER, _ENTROPY = re.compile(rb"\xff+([^\xff])", re.S), re.compile(rb"([^\xff]+|\xff\x00)|\xff+([\xd0-\xd7])")


class _Scans:
    """What the scans of a JPEG have covered so far."""

    def __init__(self, progressive: bool, components: bytes):
        self.progressive, self.components, self.done = progressive, components, {}

    def add(self, data: bytes) -> None:
        count = data[0] if data else 0
        if not 1 <= count <= len(self.components) or len(data) != 4 + 2 * count:
            raise FormatError("a scan header of another length")
        names, tables = data[1 : 1 + 2 * count : 2], data[2 : 2 + 2 * count : 2]
        if len({*names}) < count or not {*names} <= {*self.components} or any(t >> 4 > 3 or t & 15 > 3 for t in tables):
            raise FormatError("a scan of components or tables that are not there")
        first, last, high, low = data[-3], data[-2], data[-1] >> 4, data[-1] & 15
        if not self.progressive:
            if (first, last, high, low) != (0, 63, 0, 0) or any(n in self.done for n in names):
                raise FormatError("a scan that a sequential image can't have")
            self.done.update((n, 0) for n in names)
            return
        if first > last or last > 63 or (first == 0) != (last == 0) or (first and count > 1) or max(high, low) > 13 or high not in (0, low + 1):
            raise FormatError("a scan that a progressive image can't have")
        for key in [(n, k) for n in names for k in range(first, last + 1)]:
            if self.done.get(key) != (high or None):
                raise FormatError("a scan refines what is not there, or comes twice")
            self.done[key] = low

    def complete(self) -> bool:
        return all(((c, 0) if self.progressive else c) in self.done for c in self.components)


def jpeg(content: bytes, limits: Limits = DEFAULT) -> Image:
    text, at, n, scans, size, interval, pending, scanned = _Text(limits), 2, 0, None, (0, 0), 0, False, 0
    comments = 0
    while True:
        m = _MARKER.match(content, at)
        if not m:
            raise FormatError("no marker, or cut off")
        marker, at = m[1][0], m.end()
        if marker == 0xD9:
            break
        if marker == 0x01:
            continue
        if marker == 0 or 0xD0 <= marker <= 0xD8:
            raise FormatError("a marker out of place")
        if marker == 0xDA and scans is None:
            raise FormatError("a scan before its frame")
        n = within("image_segments", n + 1, limits.image_segments)
        length = int.from_bytes(content[at : at + 2], "big")
        if at + 2 > len(content) or length < 2 or at + length > len(content):
            raise FormatError("a segment is cut off")
        data, at = content[at + 2 : at + length], at + length
        if marker == 0xDA:
            scans.add(data)
            at, scanned, pending = _entropy(content, at, interval), scanned + 1, False
        elif marker == 0xDD:
            if len(data) != 2:
                raise FormatError("a restart interval of another length")
            interval, pending = int.from_bytes(data, "big"), True
        elif marker in (0xC0, 0xC2):
            if scans is not None:
                raise FormatError("two frames")
            size, scans, pending = *_frame(data, marker == 0xC2), False
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise FormatError("a coding that is not read", "unsupported_format")
        elif marker == 0xFE:
            text.spend(len(data))
            comments += 1
            text.found["jpeg.comment" + (f".{comments}" if comments > 1 else "")] = data.decode("utf-8", "replace")
        elif marker == 0xE1 and data.startswith(b"Exif\0\0"):
            text.spend(len(data))
            text.found |= exif(data[6:])
    if pending or not scanned or at != len(content) or not scans.complete() or 0 in size:
        raise FormatError("cut off, incomplete, or bytes after the end")
    semantic = any((k.startswith("jpeg.comment") or k == "exif.description") and v.strip() for k, v in text.found.items())
    return Image("jpeg", *size, text.found, semantic)


def _frame(data: bytes, progressive: bool) -> tuple[tuple[int, int], _Scans]:
    count = data[5] if len(data) > 5 else 0
    if not 1 <= count <= 4 or data[0] != 8 or len(data) != 6 + 3 * count:
        raise FormatError("a frame header of another length")
    names, sampling, tables = data[6::3], data[7::3], data[8::3]
    if len({*names}) < count or any(not (1 <= s >> 4 <= 4 and 1 <= s & 15 <= 4) for s in sampling) or max(tables) > 3:
        raise FormatError("a component that the format does not know")
    height, width = struct.unpack_from(">HH", data, 1)
    return (width, height), _Scans(progressive, names)


def _entropy(content: bytes, at: int, interval: int) -> int:
    """The end of a scan's coded data; its restart markers come in turn and only where there is an interval."""
    turn, coded = 0, False
    while m := _ENTROPY.match(content, at):
        if m[2]:
            if not interval or m[2][0] != 0xD0 + turn:
                raise FormatError("a restart marker out of turn")
            turn = (turn + 1) % 8
        coded |= m[1] is not None
        at = m.end()
    marker = _MARKER.match(content, at)
    if not coded or not marker or marker[1] == b"\0":
        raise FormatError("a scan without data, or cut off, or stuffing after fill bytes")
    return at


def exif(data: bytes) -> dict[str, str]:
    """Texts of the first directory of a TIFF block."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    try:
        if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise FormatError("no TIFF header")
        at = struct.unpack_from(order + "I", data, 4)[0]
        out = {}
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            entry = at + 2 + 12 * i
            tag, kind, count, start = struct.unpack_from(order + "HHII", data, entry)
            if kind != 2 or not count:
                continue
            start = entry + 8 if count <= 4 else start
            if start + count > len(data):
                raise FormatError("a text is cut off")
            value = data[start : start + count].removesuffix(b"\0").decode()
            if tag in EXIF:
                out[EXIF[tag]] = value
        return out
    except (struct.error, UnicodeDecodeError) as e:
        raise FormatError("a directory is cut off, or no UTF-8") from e


def parse(content: bytes, limits: Limits = DEFAULT) -> Image:
    if content.startswith(PNG):
        image = png(content, limits)
    elif content.startswith(JPEG):
        image = jpeg(content, limits)
    else:
        raise FormatError("neither PNG nor JPEG", "unsupported_format")
    check_size(image.width, image.height, limits)
    return image


def embedded(content: bytes, media_type: str | None, limits: Limits = DEFAULT) -> str:
    """The kind of an image inside a package, whose type must be that of its bytes."""
    reader = {"image/png": png, "image/jpeg": jpeg}.get(media_type)
    if reader is None or not content.startswith(PNG if reader is png else JPEG):
        raise FormatError("an image of another type than declared")
    image = reader(content, limits)
    check_size(image.width, image.height, limits)
    return image.kind


def encode(width: int, height: int, rgba: bytes) -> bytes:
    """A PNG of eight-bit RGBA pixels."""
    if len(rgba) != 4 * width * height:
        raise FormatError("pixels of another number than declared", "conversion_failed")
    rows = b"".join(b"\0" + rgba[4 * width * y : 4 * width * (y + 1)] for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG + chunk(b"IHDR", struct.pack(">II5B", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def convert(content: bytes, path: str | None, limits: Limits = DEFAULT, ocr_lines: list[tuple[str, float]] | None = None) -> Document:
    """The image as its document's asset; without text in its metadata, recognised lines (text, confidence) come first.

    ``ocr_lines`` is None where no recognition has run, and empty where it found nothing.
    """
    within("input_bytes", len(content), limits.input_bytes)
    image = parse(content, limits)
    name = (path or "").replace("\\", "/").rpartition("/")[2]
    if name.rpartition(".")[2].lower() not in EXTENSIONS[image.kind] or "." not in name:
        raise FormatError("an image has another extension than its bytes")
    policy = "semantic_metadata_present" if image.semantic else "deferred_no_pixel_decode" if ocr_lines is None else "local_on_device"
    properties = {**image.metadata, "width": str(image.width), "height": str(image.height), "ocr_policy": policy}
    if image.kind == "png":
        properties["png.interlace_profile"] = "non_interlaced_only"
    asset = Asset("asset-001", f"image-001.{EXTENSIONS[image.kind][0]}", MEDIA_TYPES[image.kind], content)
    out = Document([], image.kind, title=name, properties=properties, assets=[asset])
    if not image.semantic and ocr_lines is None:
        out.warn("ocr_deferred", "the image has no text in its metadata and was not recognised")
    elif not image.semantic:
        out.blocks += [("paragraph", [("text", text)]) for text, _ in ocr_lines]
        if not ocr_lines:
            out.warn("ocr_no_text_found", "recognition found no text in the image")
        elif min(c for _, c in ocr_lines) < 0.5:
            out.warn("ocr_low_confidence", "recognition was unsure of a line")
    out.blocks.append(("image", asset.id, name))
    return out
