"""HTML to block trees: the conversion walk over the tree that `veldmark.operators.dom` builds."""

from __future__ import annotations

import base64
import binascii
import os
import re
from urllib.parse import unquote, unquote_to_bytes

from veldmark.functions import urls
from veldmark.operators.dom import BLOCKS, HEADINGS, RAW, VOID, WS, Element, parse, title, tokens  # noqa: F401
from veldmark.operators.errors import DEFAULT, Limits, within
from veldmark.operators.model import Asset

CLOSES_P = BLOCKS | HEADINGS | {"pre", "listing", "form", "table", "hr", "li", "dd", "dt"}
# Elements that run with text, and elements that show nothing.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "del", "em", "i", "ins", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u"}
HIDDEN = {"head", "script", "style", "template", "noscript"}

#: Types of images by extension.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "avif": "image/avif"}


def data_image(src: str) -> tuple[str, str, bytes] | str:
    """(media type, extension, bytes) of a data URL."""
    head, comma, body = src[5:].partition(",")
    head, encoded = re.subn(r";\s*base64\s*$", "", head.strip(), flags=re.I)
    kind = head.partition(";")[0].strip().lower()
    extension = next((k for k, v in IMAGE_TYPES.items() if v == kind), None)
    if not comma or extension is None:
        return "invalid_asset_skipped"
    data = unquote_to_bytes(re.sub(r"[\t\n\r]", "", body).partition("#")[0])
    if encoded:
        data = re.sub(rb"[ \t\n\f\r]", b"", data)
        data = data[: -2 if data.endswith(b"==") else -1 if data.endswith(b"=") else None] if len(data) % 4 == 0 else data
        try:
            if b"=" in data:
                return "invalid_asset_skipped"
            data = base64.b64decode(data + b"=" * (-len(data) % 4), validate=True)
        except (binascii.Error, ValueError):
            return "invalid_asset_skipped"
    return head.strip(), extension, data


def walk(e: Element):
    for c in e.children:
        if not isinstance(c, str):
            yield c
            yield from walk(c)


def raw_text(e) -> str:
    return e if isinstance(e, str) else "".join(raw_text(c) for c in e.children if visible(c))


def visible(e) -> bool:
    if isinstance(e, str):
        return True
    if e.name in HIDDEN or "hidden" in e.attrs or e.attrs.get("aria-hidden", "").strip().lower() == "true":
        return False
    for declaration in e.attrs.get("style", "").lower().split(";"):
        name, _, value = (x.strip() for x in declaration.partition(":"))
        if (name, value.removesuffix("!important").strip()) in (("display", "none"), ("visibility", "hidden")):
            return False
    return True


def text_of(e) -> str:
    return e if isinstance(e, str) else "".join(map(text_of, e.children))


def unsafe(url: str) -> bool:
    """Scheme javascript or data, once white space and control characters are out."""
    scheme, colon, _ = url.lstrip().partition(":")
    return bool(colon) and re.sub(r"[\x00-\x20\x7f-\x9f]", "", scheme).lower() in ("javascript", "data")


class Converter:
    """Block tree of a document, with its assets and warnings (code, message, page).

    ``asset_refs`` has the asset ids of image sources that are known already; ``path`` is the file's own, under whose folder local
    images are read.
    """

    def __init__(self, source_url: str | None = None, limits: Limits = DEFAULT, asset_refs: dict[str, str] | None = None, path: str | None = None):
        self.source_url = self.base = source_url
        self.limits, self.asset_refs, self.assets, self.asset_bytes, self.warnings = limits, {} if asset_refs is None else asset_refs, [], 0, []
        local = unquote(path.removeprefix("file://").removeprefix("file:")) if path else ""
        self.folder = os.path.dirname(os.path.realpath(local)) if local.startswith("/") and os.path.isfile(local) else None
        self.file_url = f"file://{local}" if local.startswith("/") else None

    def warn(self, code: str, message: str) -> None:
        self.warnings.append((code, message, None))

    def resolve(self, url: str) -> str:
        url = url.strip()
        for base in (self.base, self.source_url):
            try:
                if base:
                    return str(urls.join(base, url))
            except ValueError:
                pass
        return url

    def set_base(self, href: str) -> None:
        """The document's base, unless it is unsafe or nothing can be relative to it."""
        if unsafe(href):
            return
        for base in (None, self.source_url, self.file_url):
            try:
                url = urls.join(base, href)
            except ValueError:
                continue
            if url.path.startswith("/"):
                self.base = str(url)
            return

    def document(self, text: str) -> tuple[str | None, list]:
        tree = parse(text, self.limits)
        nodes = list(walk(tree))
        title = next((" ".join(text_of(e).split()) for e in nodes if e.name == "title"), "")
        base = next((e.attrs["href"].strip() for e in nodes if e.name == "base" and e.attrs.get("href", "").strip()), None)
        if base:
            self.set_base(base)
        return title or None, self.container(tree)

    # blocks

    def container(self, e: Element) -> list:
        out, pending = [], []

        def flush():
            nonlocal pending
            out.extend(self.paragraphs(pending))
            pending = []

        for c in e.children:
            if isinstance(c, str) or c.name in INLINE:
                if visible(c):
                    pending.append(c)
            elif visible(c):
                flush()
                out += self.block(c)
        flush()
        return out

    def block(self, e: Element) -> list:
        if e.name in HEADINGS:
            inl = self.inline_run(e.children)
            return [("heading", int(e.name[1]), inl)] if inl else []
        if e.name == "p":
            return self.paragraphs(e.children)
        if e.name in ("ul", "ol"):
            items = [b for c in e.children if not isinstance(c, str) and c.name == "li" and visible(c) and (b := self.container(c))]
            start = e.attrs.get("start", "").strip() if e.name == "ol" else ""
            return [("list", e.name == "ol", int(start) if re.fullmatch(r"\+?[0-9]{1,19}", start) else None, items)]
        if e.name == "table":
            return self.table(e)
        if e.name == "blockquote":
            inner = self.container(e)
            return [("quote", inner)] if inner else []
        if e.name == "pre":
            code = next((x for x in walk(e) if x.name == "code" and visible(x)), None)
            names = code.attrs.get("class", "").split() if code is not None else []
            text = raw_text(e)
            return [("code", next((n[9:] for n in names if n.startswith("language-") and n[9:]), None), text)]
        if e.name == "hr":
            return [("rule",)]
        if e.name == "img":
            return self.image(e)
        return self.container(e)

    def paragraphs(self, nodes: list) -> list:
        """Inline content; an image splits it, and the formatting around the image is lost."""
        out, run = [], []

        def flush():
            if inl := self.inline_run(run):
                out.append(("paragraph", inl))
            run.clear()

        def add(c):
            if not isinstance(c, str) and visible(c):
                if c.name == "img":
                    flush()
                    out.extend(self.image(c))
                    return
                if any(x.name == "img" and visible(x) for x in walk(c)):
                    for x in c.children:
                        add(x)
                    return
                if c.name not in INLINE and c.name in CLOSES_P | {"table"}:
                    flush()
                    out.extend(self.block(c))
                    return
            run.append(c)

        for c in nodes:
            add(c)
        flush()
        return out

    def table(self, e: Element) -> list:
        def rows(x):
            for c in x.children:
                if not isinstance(c, str) and visible(c):
                    if c.name == "tr":
                        yield c
                    else:
                        yield from rows(c)

        found = [[c for c in r.children if not isinstance(c, str) and c.name in ("td", "th") and visible(c)] for r in rows(e)]
        width = max(map(len, found), default=0)
        if not width:
            return []
        first = next(r for r in found if r)
        aligns = []
        for c in first:
            style = re.search(r"(?:^|;)\s*text-align\s*:([^;]*)", c.attrs.get("style", "").lower())
            a = c.attrs["align"].strip().lower() if "align" in c.attrs else style[1].strip() if style else ""
            aligns.append(a if a in ("left", "right", "center") else "none")
        cells = [[self.inline_run(c.children) for c in r] for r in found]
        return [("table", aligns + ["none"] * (width - len(aligns)), [r + [[]] * (width - len(r)) for r in cells])]

    def image(self, e: Element) -> list:
        """The image as an asset; one that is not loaded leaves its alternative text."""
        alt, src = e.attrs.get("alt", "").strip(), e.attrs.get("src", "").strip()
        if not alt:
            self.warn("missing_image_alt", "an image has no alternative text")
        if src in self.asset_refs:
            return [("image", self.asset_refs[src], alt)]
        found = self.load(src)
        if isinstance(found, str):
            self.warn(found, f"image {src} was not loaded" if src else "an image has no source")
            return [("paragraph", [("text", alt)])] if alt else []
        media_type, extension, data = found
        n = within("assets", len(self.assets) + 1, self.limits.assets)
        self.asset_bytes = within("asset_bytes", self.asset_bytes + len(data), self.limits.input_bytes)
        self.assets.append(Asset(f"html-image-{n:03d}", f"image-{n:03d}.{extension}", media_type, data))
        return [("image", f"html-image-{n:03d}", alt)]

    def load(self, src: str) -> tuple[str, str, bytes] | str:
        """(media type, extension, bytes), or the code of the warning. Nothing outside the file's own folder is read."""
        if src[:5].lower() == "data:":
            return data_image(src)
        try:
            url = urls.join(None, src)
        except ValueError:
            if not src or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", src):
                return "invalid_asset_skipped"
            if src.startswith("//"):
                return "external_asset_skipped"
            try:
                url = urls.join(self.base or self.file_url, src)
            except ValueError:
                return "invalid_asset_skipped"
        if url.scheme != "file":
            return "external_asset_skipped"
        path = os.path.realpath(unquote(url.path))
        if url.host or self.folder is None or not os.path.exists(path):
            return "invalid_asset_skipped"
        if not path.startswith(self.folder.rstrip("/") + "/"):
            return "external_asset_skipped"
        extension = {"jpeg": "jpg"}.get(kind := os.path.splitext(path)[1][1:].lower(), kind)
        if extension not in IMAGE_TYPES or not os.path.isfile(path):
            return "invalid_asset_skipped"
        within("asset_bytes", self.asset_bytes + os.path.getsize(path), self.limits.input_bytes)
        try:
            with open(path, "rb") as f:
                return IMAGE_TYPES[extension], extension, f.read()
        except OSError:
            return "invalid_asset_skipped"

    # inlines

    def inline_run(self, nodes: list) -> list:
        return trim(self.inlines(nodes))

    def inlines(self, nodes: list) -> list:
        out: list = []
        for c in nodes:
            if isinstance(c, str):
                out += [("space",) if x[0] in WS else ("text", x) for x in re.findall(r"[ \t\n\f\r]+|[^ \t\n\f\r]+", c)]
            elif not visible(c):
                continue
            elif c.name == "br":
                out.append(("break",))
            elif c.name == "img":
                out += self.inlines([c.attrs.get("alt", "")])
            elif c.name == "code":
                raw = raw_text(c)
                body = raw.strip(WS)
                if body:
                    out += [("space",)] * (raw[0] in WS) + [("code", body)] + [("space",)] * (raw[-1] in WS)
                elif raw:
                    out.append(("space",))
            elif c.name in ("strong", "b", "em", "i", "a"):
                inner = self.inlines(c.children)
                before, after = bool(inner) and inner[0] == ("space",), bool(inner) and inner[-1] == ("space",)
                body = trim(inner)
                wrapped = body
                if c.name == "a":
                    href = c.attrs.get("href", "").strip()
                    if href and unsafe(href):
                        self.warn("invalid_link_skipped", f"link {href} is not safe")
                    elif href and body:
                        wrapped = [("link", self.resolve(href), c.attrs.get("title", "").strip() or None, body)]
                elif body:
                    wrapped = [("strong" if c.name in ("strong", "b") else "em", body)]
                out += [("space",)] * before + wrapped + [("space",)] * after
            else:
                out += self.inlines(c.children)
        return out


def trim(items: list) -> list:
    """Spaces collapsed, none at the ends or beside a break; each left one is a text of its own."""
    out: list = []
    for x in items:
        if x == ("space",) or x == ("text", " "):
            if out and out[-1] != ("text", " ") and out[-1] != ("break",):
                out.append(("text", " "))
        else:
            if x == ("break",) and out and out[-1] == ("text", " "):
                out.pop()
            out.append(x)
    while out and out[-1] == ("text", " "):
        out.pop()
    return out
