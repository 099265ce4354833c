"""Archives and images built byte by byte for the tests."""

import struct
import zlib

CONTENT = "http://schemas.openxmlformats.org/package/2006/content-types"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(entries, flags=0, comment=b"", streamed=()):
    """entries: (name, data, stored, external attributes)."""
    body, central = b"", b""
    for name, data, *rest in entries:
        stored, mode = (rest + [False, 0o100644 << 16][len(rest):])[:2]
        raw = name.encode()
        own = flags | (0 if raw.isascii() else 1 << 11) | (1 << 3 if name in streamed else 0)
        z = zlib.compressobj(9, zlib.DEFLATED, -15)
        packed, method = (data, 0) if stored else (z.compress(data) + z.flush(), 8)
        sizes = (zlib.crc32(data), len(packed), len(data))
        at = len(body)
        body += struct.pack("<4s5H3IHH", b"PK\3\4", 20, own, method, 0, 0, *((0, 0, 0) if name in streamed else sizes), len(raw), 0) + raw + packed
        body += b"PK\7\x08" + struct.pack("<3I", *sizes) if name in streamed else b""
        central += struct.pack("<4s6H3I5HII", b"PK\1\2", 3 << 8 | 20, 20, own, method, 0, 0, *sizes, len(raw), 0, 0, 0, 0, mode, at) + raw
    end = struct.pack("<4s4HIIH", b"PK\5\6", 0, 0, len(entries), len(entries), len(central), len(body), len(comment)) + comment
    return body + central + end


def package(main, media_type, parts, defaults=(("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml"), ("png", "image/png")), extra=()):
    types = "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in defaults) + f'<Override PartName="/{main}" ContentType="{media_type}"/>'
    entries = [("[Content_Types].xml", f'<Types xmlns="{CONTENT}">{types}</Types>'.encode()), ("_rels/.rels", rels([("r1", f"{R}/officeDocument", main, False)]))]
    return zipped([*entries, *((n, d if isinstance(d, bytes) else d.encode()) for n, d in parts.items()), *extra])


def rels(items):
    rows = "".join(f'<Relationship Id="{i}" Type="{t}" Target="{to}"{" TargetMode=" + chr(34) + "External" + chr(34) if ext else ""}/>' for i, t, to, ext in items)
    return f'<Relationships xmlns="{RELS}">{rows}</Relationships>'.encode()


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width=2, height=2, color=6, depth=8, texts=(), rows=None, interlace=0, extra=b""):
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = rows if rows is not None else (b"\0" + bytes((width * channels * depth + 7) // 8)) * height
    head = chunk(b"IHDR", struct.pack(">II5B", width, height, depth, color, 0, 0, interlace))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(chunk(*t) for t in texts) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def segment(marker, data):
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


def jpeg(width=3, height=2, components=3, progressive=False, before=b"", scans=None, end=b"\xff\xd9"):
    frame = struct.pack(">BHHB", 8, height, width, components) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(components))
    if scans is None:
        scans = scan(range(1, components + 1)) + b"\x12"
    return b"\xff\xd8" + before + segment(0xC2 if progressive else 0xC0, frame) + scans + end


def scan(ids, first=0, last=63, approximation=0):
    ids = list(ids)
    return segment(0xDA, bytes([len(ids), *(x for i in ids for x in (i, 0)), first, last, approximation]))
