"""Word, PowerPoint and Excel packages of the transitional profile."""

from __future__ import annotations

import re

from veldmark.operators import archive as packages
from veldmark.operators.archive import Archive, ImageParts, Relationship, attribute, relationships, resolve
from veldmark.operators.errors import DEFAULT, FormatError, Limits, within
from veldmark.operators.model import Document
from veldmark.operators.structured import Node, parse_xml

# Namespaces, relationship kinds and main content types.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
R = packages.OFFICE
CORE = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
DC = "http://purl.org/dc/elements/1.1/"
IMAGE, SLIDE, NOTES, WORKSHEET = f"{R}/image", f"{R}/slide", f"{R}/notesSlide", f"{R}/worksheet"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"
PROFILE = {"ooxml_profile": "transitional_only"}

# Budgets of style inheritance and of worksheets.
STYLES, STYLE_DEPTH = 4_096, 128
ROWS, DENSE_ROWS, COLUMNS, CELLS = 1_048_576, 100_000, 16_384, 1_000_000


def part(package: Archive, path: str, uri: str, name: str) -> Node:
    root = parse_xml(package.need(path))
    if not root.named(uri, name):
        raise FormatError(f"the root of {path} has another name")
    return root


def optional_part(package: Archive, path: str, uri: str, name: str) -> Node | None:
    return part(package, path, uri, name) if package.get(path) is not None else None


def safe_relative(target: str) -> bool:
    """An anchor, or a path that stays below the document."""
    path = target.replace("\\", "/")
    return target.startswith("#") or not (":" in path or path.startswith("/") or ".." in path.split("/"))


def number(text: str | None, most: int) -> int | None:
    """An unsigned number up to ``most``, as attributes write it."""
    return int(text) if text and re.fullmatch(r"\+?[0-9]+", text) and int(text) <= most else None


def image_target(rels: dict[str, Relationship], id_: str, base: str) -> str:
    rel = rels.get(id_)
    if rel is None or rel.external or rel.kind != IMAGE:
        raise FormatError("an image has no local image part")
    return resolve(base, rel.target)


def grid(rows: list[list]) -> tuple:
    return "table", ["none"] * max(map(len, rows)), rows


# Word


def style_levels(package: Archive) -> dict[str, int]:
    """Heading level by style: its outline level or its name, else that of the style it is based on."""
    root = optional_part(package, "word/styles.xml", W, "styles")
    if root is None:
        return {}
    own, parent = {}, {}
    for style in root.below(W, "style"):
        id_ = style.get("styleId", W)
        if id_ is None:
            continue
        outline = next((number(n.get("val", W), 254) for n in style.below(W, "outlineLvl")), None)
        name, based = style.child(W, "name"), style.child(W, "basedOn")
        label = (name.get("val", W) if name is not None else None) or id_
        named = re.fullmatch(r"(?:heading|title)(\+?[0-9]+)", re.sub(r"[ -]", "", label.lower()))
        level = outline + 1 if outline is not None else int(named[1]) if named else None
        own[id_] = level if level is not None and level <= 6 else None
        parent[id_] = based.get("val", W) if based is not None else None
        within("docx_styles", len(own), STYLES)
    known: dict[str, tuple[int | None, int]] = {}
    for id_ in own:
        path = []
        while id_ not in known and id_ is not None:
            if id_ in path:
                raise FormatError("styles are based on each other")
            path.append(id_)
            within("docx_style_inheritance_depth", len(path), STYLE_DEPTH)
            if own.get(id_) is not None:
                break
            id_ = parent.get(id_)
        level, depth = known.get(id_) or (own.get(id_), 0)
        for style in reversed(path):
            depth = within("docx_style_inheritance_depth", depth + 1, STYLE_DEPTH)
            known[style] = level, depth
    return {id_: level for id_, (level, _) in known.items() if level is not None}


def numbering(package: Archive) -> dict[tuple[str, int], tuple[bool, int]]:
    """(ordered, first number) by (numId, level)."""
    root = optional_part(package, "word/numbering.xml", W, "numbering")
    if root is None:
        return {}

    def value(node: Node, name: str, default):
        found = node.child(W, name)
        text = found.get("val", W) if found is not None else None
        return default if text is None else text

    levels: dict[str, dict] = {}
    for abstract in root.elements(W, "abstractNum"):
        levels[abstract.get("abstractNumId", W)] = {
            number(lvl.get("ilvl", W), 1 << 32) or 0: (value(lvl, "numFmt", "bullet") != "bullet", n if (n := number(value(lvl, "start", "1"), 1 << 64)) is not None else 1)
            for lvl in abstract.elements(W, "lvl")
        }
    return {(num.get("numId", W), i): kind for num in root.elements(W, "num") for i, kind in levels.get(value(num, "abstractNumId", None), {}).items()}


class Word:
    """The conversion of one Word package."""

    MAIN = "word/document.xml"

    def __init__(self, content: bytes, limits: Limits):
        self.package = Archive(content, limits)
        types = packages.office_package(self.package, self.MAIN, DOCX)
        body = part(self.package, self.MAIN, W, "document").child(W, "body")
        if body is None:
            raise FormatError("no body")
        self.levels, self.lists = style_levels(self.package), numbering(self.package)
        self.rels = relationships(self.package, "word/_rels/document.xml.rels")
        self.document = Document([], "docx", properties=dict(PROFILE))
        self.images = ImageParts(self.package, types, self.document)
        self.core()
        self.body(body)

    def core(self) -> None:
        root = optional_part(self.package, "docProps/core.xml", CORE, "coreProperties")
        if root is not None:
            for field, name in (("title", "title"), ("author", "creator"), ("subject", "subject")):
                text = next((n.text() for n in root.below(DC, name)), "")
                setattr(self.document, field, text if text.strip() else None)

    def body(self, body: Node) -> None:
        """Blocks in order; a run of list paragraphs becomes nested lists by their levels."""
        out, open_lists = self.document.blocks, []  # (level, ordered, items)
        for node in body.elements():
            if node.named(W, "tbl"):
                open_lists.clear()
                out += self.table(node)
            elif node.named(W, "p"):
                kind, blocks = self.paragraph(node)
                if kind is None:
                    open_lists.clear()
                    out += blocks
                    continue
                level, ordered, start = kind
                while open_lists and (open_lists[-1][0] > level or (open_lists[-1][0] == level and open_lists[-1][1] != ordered)):
                    open_lists.pop()
                if not open_lists or open_lists[-1][0] < level:
                    items: list = []
                    (open_lists[-1][2][-1] if open_lists else out).append(("list", ordered, start if ordered else None, items))
                    open_lists.append((level, ordered, items))
                open_lists[-1][2].append(blocks)
            else:
                open_lists.clear()

    def paragraph(self, node: Node) -> tuple[tuple[int, bool, int] | None, list]:
        """((list level, ordered, start) or None, blocks)."""
        properties, level, kind = node.child(W, "pPr"), None, None
        if properties is not None:
            at = {n.local: n for n in reversed(properties.elements(W, "pStyle", "outlineLvl", "numPr"))}
            if "pStyle" in at:
                level = self.levels.get(at["pStyle"].get("val", W))
            if level is None and "outlineLvl" in at:
                outline = number(at["outlineLvl"].get("val", W), 5)
                level = outline + 1 if outline is not None else None
            if "numPr" in at:
                depth, id_ = at["numPr"].child(W, "ilvl"), at["numPr"].child(W, "numId")
                depth = number(depth.get("val", W), 1 << 32) if depth is not None else None
                found = self.lists.get((id_.get("val", W), depth)) if id_ is not None else None
                kind = (depth, *found) if found else None
        inlines, pictures = self.inlines([c for c in node.elements() if not c.named(W, "pPr")])
        text = ("heading", level, inlines) if level is not None and kind is None else ("paragraph", inlines)
        return kind, [text] * bool(inlines) + [("image", i, "") for i in pictures]

    def inlines(self, nodes: list[Node]) -> tuple[list, list[str]]:
        """(inlines, asset ids of the pictures) of runs, links and whatever holds them."""
        out, pictures = [], []
        for node in nodes:
            if node.named(W, "r"):
                made = self.run(node, pictures)
            else:
                made, found = self.inlines(node.elements())
                pictures += found
                if node.named(W, "hyperlink"):
                    made = self.link(node, made)
            out += made
        return out, pictures

    def run(self, node: Node, pictures: list[str]) -> list:
        out, properties = [], node.child(W, "rPr")
        for c in node.elements():
            if c.uri == W and c.local in ("t", "delText", "instrText"):
                out.append(("text", c.text()))
            elif c.named(W, "tab"):
                out.append(("text", "\t"))
            elif c.uri == W and c.local in ("br", "cr"):
                out.append(("break",))
            elif c.uri == W and c.local in ("drawing", "pict"):
                for blip in c.below(A, "blip"):
                    if (id_ := blip.get("embed", R)) is not None:
                        pictures.append(self.images.add(image_target(self.rels, id_, self.MAIN)))
            elif not c.named(W, "rPr"):
                made, found = self.inlines([c])
                out += made
                pictures += found
        for mark, kind in (("b", "strong"), ("i", "em")):
            if properties is not None and properties.child(W, mark) is not None:
                out = [(kind, out)]
        return out

    def link(self, node: Node, label: list) -> list:
        anchor, id_ = node.get("anchor", W), node.get("id", R)
        rel = self.rels.get(id_)
        target = f"#{anchor}" if anchor is not None else rel.target if rel else None
        if rel and rel.external:
            self.document.warn("external_link_skipped", "an external link was kept as text", once=True)
        elif target is not None and safe_relative(target):
            return [("link", target, None, label)]
        elif target is not None or id_ is not None:
            self.document.warn("invalid_link_skipped", "a link that is unsafe or leads nowhere was kept as text", once=True)
        return label

    def table(self, table: Node) -> list:
        rows, pictures = [], []
        for row in table.elements(W, "tr"):
            rows.append([])
            for cell in row.elements(W, "tc"):
                content: list = []
                for p in cell.elements(W, "p"):
                    made, found = self.inlines([c for c in p.elements() if not c.named(W, "pPr")])
                    content += [("break",)] * bool(content) + made
                    pictures += found
                rows[-1].append(content)
        return [grid(rows)] * bool(rows) + [("image", i, "") for i in pictures]


def docx(content: bytes, limits: Limits = DEFAULT) -> Document:
    return Word(content, limits).document


# PowerPoint


class Slides:
    """The conversion of one PowerPoint package."""

    MAIN = "ppt/presentation.xml"

    def __init__(self, content: bytes, limits: Limits):
        self.package = Archive(content, limits)
        types = packages.office_package(self.package, self.MAIN, PPTX)
        rels = relationships(self.package, "ppt/_rels/presentation.xml.rels")
        paths = []
        for node in part(self.package, self.MAIN, P, "presentation").below(P, "sldId"):
            rel = rels.get(node.get("id", R))
            if rel is None or rel.external or rel.kind != SLIDE:
                raise FormatError("a slide has no local part")
            paths.append(resolve(self.MAIN, rel.target))
        if not paths:
            raise FormatError("no slides")
        within("pages", len(paths), limits.pages)
        self.document = Document([], "pptx", page_count=len(paths), properties=dict(PROFILE))
        self.images = ImageParts(self.package, types, self.document)
        for page, path in enumerate(paths, 1):
            self.document.blocks.append(("heading", 2, [("text", f"Slide {page}")]))
            self.slide(path, page)

    def slide(self, path: str, page: int) -> None:
        root = part(self.package, path, P, "sld")
        folder, _, leaf = path.rpartition("/")
        rels = relationships(self.package, f"{folder}/_rels/{leaf}.rels")
        for node in next(root.below(P, "spTree"), root).elements():
            self.shape(node, rels, path, page)
        notes = [r for r in rels.values() if r.kind == NOTES]
        if len(notes) > 1 or any(r.external for r in notes):
            raise FormatError("several notes, or notes outside the package")
        for rel in notes:
            shapes = part(self.package, resolve(path, rel.target), P, "notes").below(P, "sp")
            text = "\n".join(t for s in shapes if placeholder(s) not in ("hdr", "ftr", "dt", "sldNum") and (t := shape_text(s)))
            if text:
                lines = [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")]
                content = [x for i, line in enumerate(lines) for x in [("break",)] * bool(i) + [("text", line)]]
                self.document.blocks += [("heading", 3, [("text", "Notes")]), ("paragraph", content)]

    def shape(self, node: Node, rels: dict, path: str, page: int) -> None:
        out = self.document.blocks
        if node.named(P, "sp"):
            if content := self.shape_inlines(node, rels, page):
                out.append(("heading", 1, content) if placeholder(node) in ("title", "ctrTitle") else ("paragraph", content))
        elif node.named(A, "tbl") or node.named(P, "graphicFrame"):
            for table in [node] if node.local == "tbl" else node.below(A, "tbl"):
                rows = [[[("text", shape_text(c))] for c in r.elements(A, "tc")] for r in table.elements(A, "tr")]
                out += [grid(rows)] * bool(rows)
        elif node.named(A, "blip") or node.named(P, "pic"):
            for blip in [node] if node.local == "blip" else node.below(A, "blip"):
                if (id_ := blip.get("embed", R)) is not None:
                    out.append(("image", self.images.add(image_target(rels, id_, path)), ""))
        else:
            for c in node.elements():
                self.shape(c, rels, path, page)

    def shape_inlines(self, shape: Node, rels: dict, page: int) -> list:
        out: list = []
        for paragraph in shape.below(A, "p"):
            out += [("break",)] * bool(out)
            for run in paragraph.elements(A, "r", "fld"):
                text = "".join(t.text() for t in run.below(A, "t"))
                if not text:
                    continue
                click = next(run.below(A, "hlinkClick"), None)
                id_ = click.get("id", R) if click is not None else None
                rel = rels.get(id_)
                if rel and not rel.external and safe_relative(rel.target):
                    out.append(("link", rel.target, None, [("text", text)]))
                    continue
                if id_ is not None:
                    code = "external_link_skipped" if rel and rel.external else "invalid_link_skipped"
                    self.document.warn(code, "a link was kept as text", page, once=True)
                out.append(("text", text))
        return out


def placeholder(shape: Node) -> str | None:
    found = next(shape.below(P, "ph"), None)
    return found.get("type") if found is not None else None


def shape_text(shape: Node) -> str:
    return "\n".join(t for p in shape.below(A, "p") if (t := "".join(x.text() for x in p.below(A, "t"))))


def pptx(content: bytes, limits: Limits = DEFAULT) -> Document:
    return Slides(content, limits).document


# Excel

#: Parts and functions that reach outside a workbook.
OUTSIDE = ("externallink", "externaldata", "connections", "querytable", "webquery", "oleobject", "linkeddata", "datamodel")
OUTSIDE_FUNCTIONS = "WEBSERVICE|RTD|IMAGE|STOCKHISTORY"


def check_formula(formula: str) -> None:
    """A formula that reaches outside the workbook is an error; what stands in strings does not count."""
    bare = re.sub(r'"(?:[^"]|"")*"', "", formula)
    if '"' in bare:
        raise FormatError("a string in a formula does not end")
    unquoted = re.sub(r"'(?:[^']|'')*'", "", bare)
    if "'" in unquoted:
        raise FormatError("a sheet name in a formula does not end")
    compact = re.sub(r"[ \t\n\f\r]", "", unquoted).upper()
    if "|" in unquoted or re.search(rf"(?<![A-Z0-9_])(?:{OUTSIDE_FUNCTIONS})\(", compact):
        raise FormatError("a formula asks another program or the network")
    for sheet in re.finditer(r"('(?:[^']|'')*'|[^\s+\-*/^&,=(><:!']*)\s*!", bare):
        if "[" in sheet[1] and "]" in sheet[1]:
            raise FormatError("a formula reads another workbook")


def a1(reference: str) -> tuple[int, int]:
    """(column from 0, row from 1) of a cell's name."""
    m = re.fullmatch(r"([A-Z]{1,13})([1-9][0-9]{0,18})", reference)
    if not m:
        raise FormatError("no cell's name")
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return column - 1, int(m[2])


def percent_display(value: float, decimals: int) -> str:
    """A share as per cent; the exact binary value is rounded, ties to even."""
    return f"{value * 100:.{decimals}f}%"


_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


class Workbook:
    """The conversion of one Excel package."""

    MAIN = "xl/workbook.xml"

    def __init__(self, content: bytes, limits: Limits):
        self.package = Archive(content, limits)
        types = packages.office_package(self.package, self.MAIN, XLSX)
        self.inside(types)
        self.strings, (self.formats, self.custom) = self.shared(), self.styles()
        rels, root, sheets = relationships(self.package, "xl/_rels/workbook.xml.rels"), part(self.package, self.MAIN, S, "workbook"), []
        check_formulas(root)
        for sheet in root.below(S, "sheet"):
            name, rel = sheet.get("name"), rels.get(sheet.get("id", R))
            if name is None or rel is None or rel.external or rel.kind != WORKSHEET:
                raise FormatError("a sheet has no name or no local part")
            sheets.append((name, resolve(self.MAIN, rel.target)))
        if not sheets:
            raise FormatError("no sheets")
        within("pages", len(sheets), limits.pages)
        self.document = Document([], "xlsx", page_count=len(sheets), properties={"formula_policy": "never_execute_use_cached_value", **PROFILE})
        for name, path in sheets:
            self.document.blocks += [("heading", 2, [("text", name)]), self.sheet(path)]

    def inside(self, types: packages.ContentTypes) -> None:
        """Nothing of the workbook is kept elsewhere."""
        kinds = [*types.defaults.values(), *types.overrides.values()]
        for e in self.package.entries:
            if e.name.startswith("xl/") and e.name.endswith(".rels"):
                rels = relationships(self.package, e.name).values()
                kinds += [OUTSIDE[0] if r.external else r.kind for r in rels]
            kinds += [OUTSIDE[0]] * e.name.startswith("xl/externalLinks/")
        if any(word in kind.lower() for kind in kinds for word in OUTSIDE):
            raise FormatError("data from outside the workbook")

    def shared(self) -> list[str]:
        root = optional_part(self.package, "xl/sharedStrings.xml", S, "sst")
        return [] if root is None else ["".join(t.text() for t in si.below(S, "t")) for si in root.elements(S, "si")]

    def styles(self) -> tuple[list[int], dict[int, str]]:
        """(format of each style, codes of the formats of the workbook's own)."""
        root = optional_part(self.package, "xl/styles.xml", S, "styleSheet")
        if root is None:
            return [], {}
        custom = {}
        for n in root.below(S, "numFmt"):
            id_, code = number(n.get("numFmtId"), 1 << 32), n.get("formatCode")
            if id_ is not None and code is not None:
                custom[id_] = code
        cells = root.child(S, "cellXfs")
        return [number(x.get("numFmtId"), 1 << 32) or 0 for x in cells.elements(S, "xf")] if cells is not None else [], custom

    def sheet(self, path: str) -> tuple:
        """A dense table of the cells from A1 to the last row and column with any."""
        root = part(self.package, path, S, "worksheet")
        check_formulas(root)
        check_dimension(root)
        data = root.child(S, "sheetData")
        if data is None:
            raise FormatError("a sheet without data")
        rows, width, count, last = {}, 0, 0, 0
        for row in data.elements(S, "row"):
            at = number(row.get("r"), 1 << 64)
            if at is None:
                raise FormatError("a row without its number")
            if not 1 <= at <= ROWS:
                raise FormatError(f"limit worksheet_rows exceeded: actual {at}, maximum {ROWS}", "limit_exceeded", "worksheet_rows", at, ROWS)
            within("worksheet_rows", at, DENSE_ROWS)
            if at <= last:
                raise FormatError("rows out of order")
            last, cells = at, {}
            for cell in row.elements(S, "c"):
                count = within("worksheet_cells", count + 1, CELLS)
                column, its_row = a1(attribute(cell, "r"))
                if its_row != at or column <= max(cells, default=-1):
                    raise FormatError("a cell in another row, or cells out of order")
                within("worksheet_columns", column + 1, COLUMNS)
                cells[column] = self.cell(cell)
                width = max(width, column + 1)
            rows[at] = cells
        if not rows:
            rows, width, last = {1: {}}, 1, 1
        within("worksheet_cells", last * width, CELLS)
        dense = [[rows.get(r, {}).get(c, []) for c in range(width)] for r in range(1, last + 1)]
        return "table", ["none"] * width, dense

    def cell(self, cell: Node) -> list:
        kind, value, formula = cell.get("t") or "n", cell.child(S, "v"), cell.child(S, "f")
        raw = value.text() if value is not None else ""
        if kind == "s":
            at = number(raw, 1 << 64)
            if at is None or at >= len(self.strings):
                raise FormatError("a string that is not there")
            shown = self.strings[at]
        elif kind == "inlineStr":
            shown = "".join(t.text() for t in cell.below(S, "t"))
        elif kind == "b":
            if raw not in ("0", "1"):
                raise FormatError("a truth value is neither 0 nor 1")
            shown = ("FALSE", "TRUE")[int(raw)]
        elif kind in ("n", "str", "e", "d"):
            shown = self.display(raw, cell)
        else:
            raise FormatError("a cell of an unknown type")
        text = formula.text() if formula is not None else ""
        if not text:
            return [("text", shown)] if shown else []
        return [("code", f"={text}")] + ([("text", f" ({shown})")] if shown else [])

    def display(self, raw: str, cell: Node) -> str:
        style = number(cell.get("s"), 1 << 64)
        kind = self.formats[style] if style is not None and style < len(self.formats) else 0
        code = self.custom.get(kind, "")
        if (kind in (9, 10) or "%" in code) and _FLOAT.fullmatch(raw):
            return percent_display(float(raw), 2 if kind == 10 or "0.00%" in code else 0)
        return raw


def check_formulas(root: Node) -> None:
    for node in root.below(S, "f", "definedName"):
        if text := node.text():
            check_formula(text)


def check_dimension(root: Node) -> None:
    node = root.child(S, "dimension")
    reference = node.get("ref") if node is not None else None
    if reference is None:
        return
    start, _, end = reference.partition(":")
    (left, top), (right, bottom) = a1(start), a1(end or start)
    if top > bottom or left > right:
        raise FormatError("a dimension is reversed")
    within("worksheet_rows", bottom, DENSE_ROWS)
    within("worksheet_columns", right + 1, COLUMNS)
    within("worksheet_dimension_cells", (bottom - top + 1) * (right - left + 1), CELLS)


def xlsx(content: bytes, limits: Limits = DEFAULT) -> Document:
    return Workbook(content, limits).document
