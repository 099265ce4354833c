"""EPUB packages: the spine in order, after the navigation."""

from __future__ import annotations

import re
from html import escape
from typing import NamedTuple

from veldmark.operators import html, images
from veldmark.operators.archive import Archive, attribute, resolve
from veldmark.operators.errors import DEFAULT, FormatError, Limits, within
from veldmark.operators.model import Asset, Document
from veldmark.operators.structured import Node, parse_xml

# Namespaces and types of the format.
CONTAINER, OPF = "urn:oasis:names:tc:opendocument:xmlns:container", "http://www.idpf.org/2007/opf"
DC, XHTML = "http://purl.org/dc/elements/1.1/", "http://www.w3.org/1999/xhtml"
MIMETYPE, PACKAGE, PAGE = b"application/epub+zip", "application/oebps-package+xml", "application/xhtml+xml"


class Item(NamedTuple):
    path: str
    media_type: str
    nav: bool


def percent_path(path: str) -> str:
    return re.sub(rb"[^A-Za-z0-9/._-]", lambda m: b"%%%02X" % m[0][0], path.encode()).decode()


def external(reference: str) -> bool:
    """A reference with a scheme, or to a host."""
    reference = reference.strip()
    return reference.startswith("//") or bool(re.match(r"[A-Za-z0-9+.-]*:", reference))


def root_path(path: str) -> str:
    path = path.replace("\\", "/")
    if "\0" in path or ":" in path or path.startswith("/") or ".." in path.split("/"):
        raise FormatError("an unsafe package path")
    return "/".join(p for p in path.split("/") if p not in ("", "."))


class Book:
    def __init__(self, content: bytes, limits: Limits):
        self.package, self.limits = Archive(content, limits), limits
        mimetype = next((e for e in self.package.entries if e.name == "mimetype"), None)
        if self.package.first != "mimetype" or mimetype is None or mimetype.method or mimetype.data != MIMETYPE:
            raise FormatError("the first entry is not the stored media type")
        path, root = self.opf()
        self.document = Document([], "epub", properties={"spine_order": "package", "external_resolution": "disabled"})
        metadata = root.child(OPF, "metadata")
        for field, name in (("title", "title"), ("author", "creator")):
            text = next((n.text() for n in metadata.below(DC, name)), "") if metadata is not None else ""
            setattr(self.document, field, text if text.strip() else None)
        manifest, spine = root.child(OPF, "manifest"), root.child(OPF, "spine")
        if manifest is None or spine is None:
            raise FormatError("no manifest or no spine")
        self.items = self.manifest(manifest, path)
        self.by_path = {i.path: i for i in self.items.values()}
        self.refs: dict[str, str] = {}  # the private source of an image part -> asset id
        self.used = 0
        navs, pages = [i for i in self.items.values() if i.nav], []
        if len(self.by_path) < len(self.items) or len(navs) > 1:
            raise FormatError("two items have one path, or two are the navigation")
        for ref in spine.elements(OPF, "itemref"):
            item = self.items.get(attribute(ref, "idref"))
            if item is None or item.media_type != PAGE:
                raise FormatError("the spine names an item that is not there or no page")
            pages.append(item)
        if not pages:
            raise FormatError("an empty spine")
        self.document.page_count = within("pages", len(pages), limits.pages)
        if navs:
            self.document.blocks.append(("heading", 2, [("text", "Navigation")]))
        for item in [*navs, *pages]:
            self.page(item)

    def opf(self) -> tuple[str, Node]:
        container = parse_xml(self.package.need("META-INF/container.xml"))
        if not container.named(CONTAINER, "container"):
            raise FormatError("the root of the container has another name")
        found = next((n for n in container.below(CONTAINER, "rootfile") if n.get("media-type") in (None, PACKAGE)), None)
        if found is None:
            raise FormatError("no package")
        path = root_path(attribute(found, "full-path"))
        root = parse_xml(self.package.need(path))
        if not root.named(OPF, "package"):
            raise FormatError("the root of the package has another name")
        return path, root

    def manifest(self, node: Node, base: str) -> dict[str, Item]:
        out: dict[str, Item] = {}
        for n in node.elements(OPF, "item"):
            id_, path = attribute(n, "id"), resolve(base, attribute(n, "href"))
            if id_ in out:
                raise FormatError("two items have one id")
            self.package.need(path)
            out[id_] = Item(path, attribute(n, "media-type"), "nav" in (n.get("properties") or "").split())
        return out

    def page(self, item: Item) -> None:
        root = parse_xml(self.package.need(item.path))
        if not root.named(XHTML, "html") or any(n.uri != XHTML for n in _all(root)):
            raise FormatError("a page has elements of another language")
        walker = html.Converter(f"epub://local/{percent_path(item.path)}", limits=self.limits, asset_refs=self.refs)
        _, blocks = walker.document(self.clean(root, item.path))
        self.document.blocks += blocks
        self.document.warnings += walker.warnings

    def clean(self, node: Node, path: str) -> str:
        """The page as HTML without scripts' attributes, bases and links outside; images have private sources."""
        name, attributes = node.local.lower(), []
        for qname, value in node.attributes:
            key = qname.lower().rpartition(":")[2]
            if key.startswith("on") or (name, key) == ("base", "href") or ((name, key) == ("a", "href") and external(value)):
                continue
            if (name, key) == ("img", "src"):
                value = self.image(value, path)
            attributes.append(f' {qname.lower()}="{escape(value)}"')
        head = f"<{name}{''.join(attributes)}>"
        if name in html.VOID:
            return head
        raw = name in html.RAW and name not in ("title", "textarea")
        body = "".join((c if raw else escape(c, False)) if isinstance(c, str) else self.clean(c, path) for c in node.children)
        return f"{head}{body}</{name}>"

    def image(self, source: str, path: str) -> str:
        target = source.partition("#")[0]
        if external(source) or not target.strip():
            raise FormatError("an image outside the package")
        item = self.by_path.get(resolve(path, target))
        if item is None:
            raise FormatError("an image that the manifest does not name")
        private = f"veldmark-asset:{percent_path(item.path)}"
        if private not in self.refs:
            n, data = within("assets", len(self.refs) + 1, self.limits.assets), self.package.need(item.path)
            self.used = within("asset_bytes", self.used + len(data), self.limits.input_bytes)
            extension = images.EXTENSIONS[images.embedded(data, item.media_type, self.limits)][0]
            self.refs[private] = f"epub-image-{n:03d}"
            self.document.assets.append(Asset(self.refs[private], f"image-{n:03d}.{extension}", item.media_type, data))
        return private


def _all(node: Node):
    yield node
    for c in node.elements():
        yield from _all(c)


def convert(content: bytes, limits: Limits = DEFAULT) -> Document:
    return Book(content, limits).document
