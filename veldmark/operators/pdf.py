"""Markdown from the geometry of PDF pages: glyphs, rules, links and images as tables, in points from the top left corner.

Across pages and documents the work is joins, windows and aggregates over tables. What depends on the order within one page (clusters of
lines, tables, blocks) is a function of that page's rows. Coordinates are 32-bit floats throughout.

Tables: pages (doc_id, page, width, height), glyphs (doc_id, page, idx, text, l, t, r, b, font_size, font_weight, and word after
`with_words`), rules (doc_id, page, kind line or rectangle, l, t, r, b), links (doc_id, page, l, t, r, b, target),
images (doc_id, page, idx, l, t, r, b, px_w, px_h, rgba).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldmark.functions import urls
from veldmark.operators import emit, images
from veldmark.operators.errors import DEFAULT, Limits

PAGE = ["doc_id", "page"]
RECT = ["l", "t", "r", "b"]
ATTACHED = ".,;:!?)]}%"
SAFE = ("http", "https", "mailto", "file")


@dataclass(frozen=True)
class Heuristics:
    """Thresholds of the reconstruction, in points or as ratios. All are finite and positive, counts at least 1."""

    line_y_tolerance_points: float = 2.0
    line_vertical_overlap_ratio: float = 0.3
    line_segment_gap_points: float = 24.0
    word_gap_ratio: float = 0.25
    paragraph_gap_ratio: float = 0.8
    paragraph_indent_tolerance_points: float = 8.0
    column_min_gap_points: float = 48.0
    column_cluster_tolerance_points: float = 24.0
    column_min_lines_per_column: int = 2
    column_ambiguity_span_ratio: float = 0.4
    heading_level_1_size_ratio: float = 1.8
    heading_level_2_size_ratio: float = 1.35
    heading_bold_weight: int = 600
    list_indent_tolerance_points: float = 8.0
    table_alignment_tolerance_points: float = 8.0
    table_row_y_tolerance_points: float = 2.0
    table_max_row_gap_ratio: float = 4.5
    borderless_table_min_rows: int = 3
    table_min_rows: int = 2
    table_min_columns: int = 2
    rule_axis_tolerance_points: float = 2.0
    chrome_edge_ratio: float = 0.08
    chrome_position_tolerance_points: float = 3.0
    chrome_min_pages: int = 2
    link_intersection_ratio: float = 0.25

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if not math.isfinite(value) or value <= 0:
                raise ValueError(f"{f.name} must be finite and positive")
            if f.name in ("line_vertical_overlap_ratio", "column_ambiguity_span_ratio", "link_intersection_ratio") and value > 1:
                raise ValueError(f"{f.name} is a share")
        if self.chrome_edge_ratio >= 0.5 or self.heading_level_2_size_ratio >= self.heading_level_1_size_ratio:
            raise ValueError("edges overlap, or heading sizes are out of order")


STANDARD = Heuristics()


def placed(rect: str, source_left: Column, source_bottom: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A rectangle (struct l, t, r, b in PDF space, y upwards) as the rotated page shows it, y downwards."""
    f = lambda x: x.cast("float")
    c = {k: f(F.col(rect)[k]) for k in RECT}
    left, right = c["l"] - f(source_left), c["r"] - f(source_left)
    top, bottom = f(height) - (c["t"] - f(source_bottom)), f(height) - (c["b"] - f(source_bottom))
    box = lambda *x: F.struct(*(v.cast("float").alias(k) for k, v in zip(RECT, x)))
    w, h = f(width), f(height)
    return (
        F.when(rotation == 90, box(h - bottom, left, h - top, right)).when(rotation == 180, box(w - right, h - bottom, w - left, h - top))
        .when(rotation == 270, box(top, w - right, bottom, w - left)).otherwise(box(left, top, right, bottom))
    )


def with_words(glyphs: DataFrame) -> DataFrame:
    """``glyphs`` with ``word``: the runs between white space are the islands of a running sum; white space has none."""
    by = Window.partitionBy(*PAGE).orderBy("idx")
    blank = F.col("text").rlike(r"(?U)^\s*$")
    starts = (~blank & F.coalesce(F.lag(blank).over(by), F.lit(True))).cast("int")
    return glyphs.withColumn("__start", starts).withColumn("word", F.when(~blank, F.sum("__start").over(by))).drop("__start")


# Lines


class Box:
    """A rectangle of 32-bit floats."""

    __slots__ = ("l", "t", "r", "b")

    def __init__(self, l, t, r, b):  # noqa: E741
        self.l, self.t, self.r, self.b = np.float32(l), np.float32(t), np.float32(r), np.float32(b)

    @property
    def height(self):
        return self.b - self.t

    @property
    def width(self):
        return self.r - self.l

    def union(self, o: Box) -> Box:
        return Box(min(self.l, o.l), min(self.t, o.t), max(self.r, o.r), max(self.b, o.b))

    def shared(self, o: Box):
        return max(min(self.r, o.r) - max(self.l, o.l), np.float32(0)) * max(min(self.b, o.b) - max(self.t, o.t), np.float32(0))

    def meets(self, o: Box) -> bool:
        return bool(self.l < o.r and self.r > o.l and self.t < o.b and self.b > o.t)


def union(boxes: list[Box]) -> Box:
    out = boxes[0]
    for b in boxes[1:]:
        out = out.union(b)
    return out


class Glyph:
    __slots__ = ("text", "box", "size", "weight")

    def __init__(self, text, box, size, weight):
        self.text, self.box, self.size, self.weight = text, box, np.float32(size), weight


class Line:
    """A line of a page; ``spans`` are (start, end, box) of its glyphs in its text."""

    def __init__(self, text, box, size, weight, spans):
        self.text, self.box, self.size, self.weight, self.spans = text, box, size, weight, spans

    @classmethod
    def of(cls, glyphs: list[Glyph], h: Heuristics) -> Line:
        text, spans, last = "", [], None
        for g in glyphs:
            if not g.text.strip():
                text += " " if text and not text.endswith(" ") else ""
                continue
            apart = last is not None and g.box.l - last.box.r > max(last.size, g.size) * np.float32(h.word_gap_ratio)
            if apart and not text.endswith(" ") and g.text[0] not in ATTACHED:
                text += " "
            spans.append((len(text), len(text) + len(g.text), g.box))
            text, last = text + g.text, g
        seen = [g for g in glyphs if g.text.strip()]
        total = np.float32(0)
        for g in seen:
            total += g.size
        weights = sorted(g.weight for g in seen if g.weight is not None)
        return cls(text.strip(), union([g.box for g in glyphs]), total / np.float32(max(1, len(seen))), weights[len(weights) // 2] if weights else None, spans)

    def after(self, n: int) -> Line:
        """The line without its first ``n`` characters."""
        spans = [(max(0, a - n), max(0, b - n), box) for a, b, box in self.spans if b > n]
        return Line(self.text[n:].lstrip(), union([s[2] for s in spans]) if spans else self.box, self.size, self.weight, spans)


def same_row(a: Box, b: Box, h: Heuristics) -> bool:
    least = min(a.height, b.height)
    overlap = min(a.b, b.b) - max(a.t, b.t)
    return bool((least > 0 and overlap / least >= np.float32(h.line_vertical_overlap_ratio)) or abs(a.t - b.t) <= np.float32(h.line_y_tolerance_points))


_DETACHED = re.compile(r"[-*•]|[0-9]+\.")


def page_lines(units: list[list[Glyph]], h: Heuristics, words: bool = True) -> list[Line]:
    """Lines of a page whose words (or single glyphs) are ``units``: rows by their first member, cut at wide gaps."""
    box = [union([g.box for g in u]) for u in units]
    rows: list[list[int]] = []
    for i in range(len(units)):
        row = next((r for r in rows if same_row(box[r[0]], box[i], h)), None)
        if row is None:
            rows.append([i])
        else:
            row.append(i)
    out = []
    for row in rows:
        row.sort(key=lambda i: box[i].l)
        parts = [[row[0]]]
        for a, b in pairwise(row):
            gap = box[b].l - box[a].r
            marker = _DETACHED.fullmatch("".join(g.text for g in units[a]).strip()) and gap <= max(box[a].height, box[b].height) * np.float32(3)
            if gap > np.float32(h.line_segment_gap_points) and not marker:
                parts.append([])
            parts[-1].append(b)
        for part in parts:
            members = [sorted(units[i], key=lambda g: g.box.l) for i in part]
            out.append(Line.of(spaced(members) if words else [g for u in members for g in u], h))
    return sorted((x for x in out if x.text), key=lambda x: (x.box.t, x.box.l))


def spaced(words: list[list[Glyph]]) -> list[Glyph]:
    """Glyphs of words from left to right with a blank between two words."""
    out = list(words[0])
    for word in words[1:]:
        a, b = out[-1], word[0]
        out.append(Glyph(" ", Box(min(a.box.r, b.box.l), min(a.box.t, b.box.t), max(a.box.r, b.box.l), max(a.box.b, b.box.b)), max(a.size, b.size), None))
        out += word
    return out


LINES = "doc_id string, page int, line int, width float, height float, text string, l float, t float, r float, b float, font_size float, font_weight int, spans array<struct<start:int,end:int,l:float,t:float,r:float,b:float>>"


def _glyphs(pdf: pd.DataFrame) -> list[Glyph]:
    weights = [None if pd.isna(w) else int(w) for w in pdf["font_weight"]]
    return [Glyph(text, Box(*box), size, w) for text, *box, size, w in zip(pdf["text"], pdf["l"], pdf["t"], pdf["r"], pdf["b"], pdf["font_size"], weights)]


def lines(pages: DataFrame, glyphs: DataFrame, h: Heuristics = STANDARD) -> DataFrame:
    """`LINES` of all pages. With a column ``word`` the words are clustered, else the single glyphs."""
    words = "word" in glyphs.columns

    def run(pdf):
        pdf = pdf[~pdf["text"].str.fullmatch(r"[\r\n]*").fillna(True)].sort_values("idx", kind="stable")
        made = _glyphs(pdf)
        if words:
            units: dict = {}
            for w, g in zip(pdf["word"], made):
                if not pd.isna(w):
                    units.setdefault(w, []).append(g)
            found = page_lines(list(units.values()), h)
        else:
            found = page_lines([[g] for g in made], h, False)
        first = pdf.iloc[0] if len(pdf) else None
        rows = [
            (first["doc_id"], first["page"], i, first["width"], first["height"], x.text, x.box.l, x.box.t, x.box.r, x.box.b, x.size, x.weight,
             [{"start": a, "end": e, **{k: float(getattr(box, k)) for k in RECT}} for a, e, box in x.spans])
            for i, x in enumerate(found)
        ]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")]).astype({"font_weight": "Int32"})

    columns = [F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), "idx", "text", *(F.col(c).cast("float").alias(c) for c in [*RECT, "font_size"]), F.col("font_weight").cast("int").alias("font_weight"), *["word"] * words]
    size = pages.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("width").cast("float").alias("width"), F.col("height").cast("float").alias("height"))
    return glyphs.select(*columns).join(size, PAGE).groupBy(*PAGE).applyInPandas(run, LINES)


def without_chrome(found: DataFrame, h: Heuristics = STANDARD) -> DataFrame:
    """Lines without those that repeat at the same place on the same edge of several pages.

    The counts of a text come from one aggregate, so a text on every page is combined before it is exchanged; the anti join is
    on (document, text), which adaptive execution may split.
    """
    key = F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
    low, high = F.lit(h.chrome_edge_ratio).cast("float"), F.lit(1 - h.chrome_edge_ratio).cast("float")
    bottom = F.col("b") >= F.col("height") * high
    marked = found.withColumn("__key", F.when((F.col("t") <= F.col("height") * low) | bottom, key))
    edge = marked.where("__key is not null").select("doc_id", "__key", "page", "line", "t", bottom.alias("bottom"))
    first = F.min_by("t", F.struct("page", "line"))
    near = F.lit(h.chrome_position_tolerance_points).cast("float")
    stats = edge.groupBy("doc_id", "__key").agg(F.countDistinct("page").alias("n"), first.alias("t0"), F.min("t").alias("t1"), F.max("t").alias("t2"), F.min("bottom").alias("b1"), F.max("bottom").alias("b2"))
    again = stats.where((F.col("n") >= h.chrome_min_pages) & (F.col("b1") == F.col("b2")) & (F.col("t2") - F.col("t0") <= near) & (F.col("t0") - F.col("t1") <= near))
    return marked.join(again.select("doc_id", "__key"), ["doc_id", "__key"], "left_anti").drop("__key")


def body_sizes(found: DataFrame) -> DataFrame:
    """(doc_id, body): the font size of most lines, the smallest of equally frequent ones."""
    counts = found.groupBy("doc_id", "font_size").count()
    return counts.groupBy("doc_id").agg(F.min_by("font_size", F.struct(-F.col("count"), F.col("font_size"))).alias("body"))


# Pages

MARKER = re.compile(r"([-*•]) |([0-9]+)\. ")


def heading_level(size, weight, body, primary, h: Heuristics) -> int | None:
    if not body > 0:
        return None
    ratio, bold, second = size / body, (weight or 0) >= h.heading_bold_weight, np.float32(h.heading_level_2_size_ratio)
    if ratio >= np.float32(h.heading_level_1_size_ratio):
        smaller = primary is not None and size < primary - np.finfo(np.float32).eps
        return 2 if smaller and (weight == 0 or bold) else 1
    if weight == 0 and ratio >= second:
        return 1 if primary is None and ratio >= second + np.float32(0.25) else 2
    return 2 if bold and ratio >= second else None


def heading_level_column(size: Column, weight: Column, body: Column, primary: Column, h: Heuristics = STANDARD) -> Column:
    """`heading_level` as an expression over columns of floats; ``primary`` is the largest size of a page's first-level headings."""
    f = lambda x: F.lit(x).cast("float")
    ratio, bold = (size / body).cast("float"), F.coalesce(weight, F.lit(0)) >= h.heading_bold_weight
    second, plain = f(h.heading_level_2_size_ratio), F.coalesce(weight == 0, F.lit(False))
    smaller = F.coalesce(size < (primary - f(float(np.finfo(np.float32).eps))).cast("float"), F.lit(False))
    large = F.when(smaller & (plain | bold), 2).otherwise(1)
    unsure = F.when(primary.isNull() & (ratio >= (second + f(0.25)).cast("float")), 1).otherwise(2)
    return F.when(body > 0, F.when(ratio >= f(h.heading_level_1_size_ratio), large).when(plain & (ratio >= second), unsure).when(bold & (ratio >= second), 2))


class Page:
    """Blocks of one page: (top, left, block), its column boundary and its warnings (code, message)."""

    def __init__(self, found: list[Line], rules: list[tuple[str, Box]], links: list[tuple[Box, str]], width, body, h: Heuristics = STANDARD):
        self.h, self.links, self.warnings, self.width = h, links, [], np.float32(width)
        table = self.table(found, rules)
        if table:
            place, block, used = table
            found = [x for x in found if x not in used]
        self.boundary, found = self.columns(found)
        self.blocks = self.flow(found, body)
        if table:
            at = next((i for i, b in enumerate(self.blocks) if b[0] > place.t), len(self.blocks))
            self.blocks.insert(at, (place.t, place.l, block))

    def warn(self, code: str, message: str) -> None:
        self.warnings.append((code, message))

    def region(self, left) -> int:
        return int(self.boundary is not None and left >= self.boundary)

    def columns(self, found: list[Line]) -> tuple[np.float32 | None, list[Line]]:
        """(where the right column begins, lines in reading order): a split at the widest gap of left edges, if both sides are sound."""
        h, order = self.h, sorted(found, key=lambda x: (x.box.t, x.box.l))
        edges = sorted(x.box.l for x in order)
        gaps = [b - a for a, b in pairwise(edges)]
        if not gaps or max(gaps) < np.float32(h.column_min_gap_points):
            return None, order
        at = max(i for i, g in enumerate(gaps) if g == max(gaps))
        middle = (edges[at] + edges[at + 1]) / np.float32(2)
        sides = [[x for x in order if x.box.l < middle], [x for x in order if x.box.l >= middle]]
        few = min(map(len, sides)) < h.column_min_lines_per_column
        loose = max(edges[at] - edges[0], edges[-1] - edges[at + 1]) > np.float32(h.column_cluster_tolerance_points)
        filled = edges[at + 1] - max(x.box.r for x in sides[0]) < np.float32(h.column_min_gap_points)
        if not (few or loose or filled):
            return middle, [x for side in sides for x in sorted(side, key=lambda x: x.box.t)]
        wide = any(x.box.width / self.width >= np.float32(h.column_ambiguity_span_ratio) for x in order)
        reason = "too few lines in a column" if few else "edges of a column are scattered" if loose else "a line spans the gutter" if wide else "the gutter is not empty"
        self.warn("ambiguous_reading_order", f"a column split was rejected: {reason}")
        return None, order

    def flow(self, found: list[Line], body) -> list[tuple]:
        """Lists, headings and paragraphs: a line joins the group before it or opens one."""
        h = self.h
        big = [x.size for x in found if body > 0 and x.size / body >= np.float32(h.heading_level_1_size_ratio)]
        primary, groups = max(big, default=None), []
        for x in found:
            m = MARKER.match(x.text)
            level = None if m else heading_level(x.size, x.weight, body, primary, h)
            kind = ("list", bool(m[2])) if m else ("heading", level) if level else ("text", None)
            last = groups[-1] if groups else None
            joins = last is not None and last[0] == kind and kind[0] != "heading"
            if joins and m:
                first, _ = last[1][0]
                joins = abs(x.box.l - first.box.l) <= np.float32(h.list_indent_tolerance_points) and (not m[2] or int(m[2]) == int(MARKER.match(first.text)[2]) + len(last[1]))
            elif joins:
                joins = self.continues(last[1][-1][0], x)
            if not joins:
                groups.append((kind, []))
            groups[-1][1].append((x, m))
        return [self.block(kind, members) for kind, members in groups]

    def continues(self, a: Line, b: Line) -> bool:
        h = self.h
        near = b.box.t - a.box.b <= max(a.size, b.size) * np.float32(h.paragraph_gap_ratio)
        return bool(b.box.t >= a.box.t and near and abs(a.box.l - b.box.l) <= np.float32(h.paragraph_indent_tolerance_points))

    def block(self, kind: tuple, members: list) -> tuple:
        first, marker = members[0]
        if kind[0] == "list":
            items = [[("paragraph", self.inlines(x.after(m.end())))] for x, m in members]
            block = ("list", kind[1], int(marker[2]) if kind[1] else None, items)
        elif kind[0] == "heading":
            block = ("heading", kind[1], self.inlines(first))
        else:
            block = ("paragraph", self.joined([x for x, _ in members], True))
        return first.box.t, first.box.l, block

    def joined(self, found: list[Line], hyphens: bool) -> list:
        """Inlines of several lines; a word cut by a hyphen is mended."""
        out: list = []
        for i, x in enumerate(found):
            if i:
                before = found[i - 1].text
                if hyphens and re.search(r"[^\W\d_]-$", before) and x.text[:1].islower():
                    out = unhyphened(out)
                else:
                    out = merged(out, [("text", " ")])
            out = merged(out, self.inlines(x))
        return out

    def inlines(self, line: Line) -> list:
        """The text of a line with its links: from the first to the last glyph that a link covers enough of."""
        ranges = []
        for box, target in self.links:
            if not line.box.meets(box):
                continue
            if not safe_target(target):
                self.warn("invalid_link_skipped", "an unsafe link destination was skipped")
                continue
            hit = [(a, b) for a, b, g in line.spans if g.width * g.height > 0 and g.shared(box) / (g.width * g.height) >= np.float32(self.h.link_intersection_ratio)]
            if hit:
                ranges.append((hit[0][0], hit[-1][1], target))
        out, at = [], 0
        for a, b, target in sorted(ranges):
            if at <= a < b:
                out += [("text", line.text[at:a])] * (a > at) + [("link", target, None, [("text", line.text[a:b])])]
                at = b
        return out + [("text", line.text[at:])] * (at < len(line.text) or not out)

    # tables

    def table(self, found: list[Line], rules: list[tuple[str, Box]]) -> tuple | None:
        """(box, block, lines used)."""
        ruled = self.ruled(found, rules)
        return ruled if ruled is not None else self.borderless(found)

    def ruled(self, found: list[Line], rules: list[tuple[str, Box]]) -> tuple | bool | None:
        """A grid whose axes are drawn from end to end; None if there is none, False if text crosses its inner rules."""
        h, near, two = self.h, np.float32(self.h.rule_axis_tolerance_points), np.float32(2)
        across = [x for k, b in rules for x in ([b.l, b.r] if k == "rectangle" else [(b.l + b.r) / two] * bool(b.width <= near))]
        down = [y for k, b in rules for y in ([b.t, b.b] if k == "rectangle" else [(b.t + b.b) / two] * bool(b.height <= near))]
        xs, ys = distinct(across, near), distinct(down, near)
        if len(xs) <= h.table_min_columns or len(ys) <= h.table_min_rows:
            return None
        drawn = [(b.l, b.r, b.t, b.b, k) for k, b in rules]
        vertical = [(x, t, b) for l, r, t, b, k in drawn for x in ((l, r) if k == "rectangle" else (l,))]  # noqa: E741
        level = [(y, l, r) for l, r, t, b, k in drawn for y in ((t, b) if k == "rectangle" else (t,))]  # noqa: E741
        if not all(covered(vertical, x, ys[0], ys[-1], near) for x in xs) or not all(covered(level, y, xs[0], xs[-1], near) for y in ys):
            return None
        cells: dict = {}
        for x in found:
            cx, cy = (x.box.l + x.box.r) / two, (x.box.t + x.box.b) / two
            crosses = lambda low, high, axes: any(low < a - near and high > a + near for a in axes[1:-1])
            if (ys[0] <= cy <= ys[-1] and crosses(x.box.l, x.box.r, xs)) or (xs[0] <= cx <= xs[-1] and crosses(x.box.t, x.box.b, ys)):
                self.warn("table_degraded", "text crosses an inner rule of a table")
                return False
            if xs[0] <= cx <= xs[-1] and ys[0] <= cy <= ys[-1]:
                at = [min(int(np.searchsorted(axis, c, side="right")) - 1, len(axis) - 2) for axis, c in ((ys, cy), (xs, cx))]
                cells.setdefault(tuple(at), []).append(x)
        rows = [[self.joined(cells.get((i, j), []), False) for j in range(len(xs) - 1)] for i in range(len(ys) - 1)]
        return Box(xs[0], ys[0], xs[-1], ys[-1]), ("table", ["none"] * (len(xs) - 1), rows), [x for c in cells.values() for x in c]

    def borderless(self, found: list[Line]) -> tuple | None:
        h, near = self.h, np.float32(self.h.table_row_y_tolerance_points)
        every: list[list[Line]] = []
        for x in found:
            row = next((r for r in every if abs(r[0].box.t - x.box.t) <= near), None)
            if row is None:
                every.append([x])
            else:
                row.append(x)
        every = [sorted(r, key=lambda x: x.box.l) for r in every]
        rows = [r for r in every if len(r) >= h.table_min_columns]
        if not rows:
            return None
        width, top, bottom = len(rows[0]), rows[0][0].box.t, rows[-1][0].box.t
        pitch = [(b[0].box.t - a[0].box.t, max(x.size for x in a + b)) for a, b in pairwise(rows)]
        if not all(gap <= size * np.float32(h.table_max_row_gap_ratio) for gap, size in pitch):
            return None
        even = all(len(r) == width for r in rows)
        aligned = even and all(abs(x.box.l - y.box.l) <= np.float32(h.table_alignment_tolerance_points) for r in rows for x, y in zip(r, rows[0]))
        apart = even and width > 1 and all(max(r[i].box.r for r in rows) < min(r[i + 1].box.l for r in rows) for i in range(width - 1))
        reason = None
        if not (aligned or apart):
            reason = "aligned text does not repeat in enough rows"
        elif any(len(r) != width and top - near <= r[0].box.t <= bottom + near for r in every):
            reason = "a row of a borderless table is incomplete"
        elif not self.tabular(rows, pitch):
            reason = "aligned text has no columns of one kind"
        if reason:
            self.warn("table_degraded", reason)
            return None
        used = [x for r in rows for x in r]
        return union([x.box for x in used]), ("table", ["none"] * width, [[self.inlines(x) for x in r] for r in rows]), used

    def tabular(self, rows: list[list[Line]], pitch: list[tuple]) -> bool:
        """Columns of one kind below the header, and either numbers beside texts or rows as tight as a paragraph's."""
        if len(rows) < self.h.borderless_table_min_rows or len(rows) < 2:
            return False
        kinds = [{numeric(r[i].text) for r in rows[1:]} for i in range(len(rows[0]))]
        tight = all(gap <= size * np.float32(1 + self.h.paragraph_gap_ratio) for gap, size in pitch)
        return all(len(k) == 1 for k in kinds) and (len(set.union(*kinds)) == 2 or tight)


def numeric(text: str) -> bool:
    return bool(re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", text.strip())) and math.isfinite(float(text))


def safe_target(target: str) -> bool:
    try:
        return urls.join(None, target).scheme in SAFE
    except ValueError:
        return False


def distinct(values: list, near) -> list:
    """Sorted values, each farther than ``near`` from the one kept before it."""
    out: list = []
    for v in sorted(values):
        if not out or abs(v - out[-1]) > near:
            out.append(v)
    return out


def covered(drawn: list[tuple], axis, start, end, near) -> bool:
    """Whether pieces drawn along an axis reach from start to end without a gap."""
    at = start
    for _, a, b in sorted((p for p in drawn if abs(p[0] - axis) <= near), key=lambda p: p[1]):
        if a > at + near:
            return False
        at = max(at, b)
        if at + near >= end:
            return True
    return False


def merged(a: list, b: list) -> list:
    """Inlines one after another, neighbouring texts as one."""
    out = list(a)
    for x in b:
        if out and x[0] == "text" and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + x[1])
        else:
            out.append(x)
    return out


def unhyphened(inlines: list) -> list:
    last = inlines[-1]
    last = (*last[:-1], unhyphened(last[-1])) if last[0] == "link" else ("text", last[1].removesuffix("-"))
    return [*inlines[:-1], last]


# Documents

BLOCKS = "doc_id string, page int, region int, t float, l float, ord int, boundary float, markdown string, warnings array<struct<code:string,message:string,page:int>>"


def blocks(found: DataFrame, rules: DataFrame, links: DataFrame, h: Heuristics = STANDARD) -> DataFrame:
    """`BLOCKS` of every page that has lines (width and body size with them): one row a block, and one of order -1 for the page."""

    def run(key, mine, drawn, linked):
        pdf = mine.sort_values("line")
        made = []
        for x in pdf.itertuples():
            spans = [(s["start"], s["end"], Box(*(s[k] for k in RECT))) for s in x.spans]
            made.append(Line(x.text, Box(x.l, x.t, x.r, x.b), np.float32(x.font_size), None if pd.isna(x.font_weight) else int(x.font_weight), spans))
        rows: list[tuple] = []
        if made:
            boxes = lambda df: [Box(*v) for v in zip(*(df[k] for k in RECT))]
            page = Page(made, list(zip(drawn["kind"], boxes(drawn))), list(zip(boxes(linked), linked["target"])), pdf["width"].iloc[0], np.float32(pdf["body"].iloc[0]), h)
            warnings = [{"code": c, "message": m, "page": int(key[1])} for c, m in page.warnings]
            rows = [(*key, 0, 0.0, 0.0, -1, page.boundary, "", warnings)]
            rows += [(*key, page.region(left), top, left, i, page.boundary, emit.block(b), []) for i, (top, left, b) in enumerate(page.blocks)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in re.split(r", (?=\w+ )", BLOCKS)])

    # two cogroups would exchange lines twice; rules and links are tagged rows of one table instead
    rect = [F.col(c).cast("float").alias(c) for c in RECT]
    key = [F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page")]
    marks = rules.select(*key, *rect, "kind", F.lit(None).cast("string").alias("target")).unionAll(links.select(*key, *rect, F.lit("link").alias("kind"), "target"))

    def both(key, mine, extra):
        return run(key, mine, extra[extra["kind"] != "link"], extra[extra["kind"] == "link"])

    return found.groupBy(*PAGE).cogroup(marks.groupBy(*PAGE)).applyInPandas(both, BLOCKS)


def numbered_images(drawn: DataFrame, page_blocks: DataFrame) -> DataFrame:
    """``drawn`` with region and number in reading order; a document's images are numbered through all its pages."""
    edge = page_blocks.where("ord = -1").select(*PAGE, "boundary")
    region = F.coalesce(F.col("l").cast("float") >= F.col("boundary"), F.lit(False)).cast("int")
    by = Window.partitionBy("doc_id").orderBy("page", "region", "t", "l", "idx")
    cast = drawn.withColumns({"doc_id": F.col("doc_id").cast("string"), "page": F.col("page").cast("int")})
    return cast.join(edge, PAGE, "left").withColumn("region", region).withColumn("number", F.row_number().over(by))


def reconstruct(pages: DataFrame, glyphs: DataFrame, rules: DataFrame, links: DataFrame, drawn: DataFrame, h: Heuristics = STANDARD, limits: Limits = DEFAULT) -> DataFrame:
    """(doc_id, status, error_code, markdown, n_blocks, page_count, n_images, warnings) of every document of ``pages``.

    A document without any visible glyph is ``ocr_required``; one with too many pages, images or pixels is ``limit_exceeded``.
    """
    found = without_chrome(lines(pages, glyphs, h), h)
    found = found.join(body_sizes(found), "doc_id")
    made = blocks(found, rules, links, h)
    shown = numbered_images(drawn, made)
    name = F.concat(F.lit("![](image-"), F.format_string("%03d", "number"), F.lit(".png)"))
    alone = F.array(F.struct(F.lit("missing_image_alt").alias("code"), F.lit("an image has no alternative text").alias("message"), F.col("page")))
    rows = made.select("doc_id", "page", "region", "t", "l", F.lit(0).alias("late"), "ord", "markdown", "warnings").unionAll(
        shown.select("doc_id", "page", "region", F.col("t").cast("float"), F.col("l").cast("float"), F.lit(1).alias("late"), F.col("number").alias("ord"), name.alias("markdown"), alone.alias("warnings"))
    )
    placed_rows = F.sort_array(F.collect_list(F.when(F.col("ord") >= 0, F.struct("page", "region", "t", "l", "late", "ord", "markdown"))))
    noted = F.sort_array(F.collect_list(F.when(F.size("warnings") > 0, F.struct("late", "page", "ord", "warnings"))))
    documents = rows.groupBy("doc_id").agg(placed_rows.alias("blocks"), noted.alias("noted"))
    key = F.col("doc_id").cast("string").alias("doc_id")
    count = pages.select(key).groupBy("doc_id").agg(F.count("*").alias("page_count"))
    visible = glyphs.where(~F.col("text").rlike(r"(?U)^\s*$")).select(key).distinct().withColumn("text", F.lit(True))
    out = count.join(visible, "doc_id", "left").join(image_budget(drawn), "doc_id", "left").join(documents, "doc_id", "left")
    code = F.when((F.col("page_count") > limits.pages) | (F.col("n_images") > limits.assets) | (F.col("image_bytes") > limits.input_bytes), "limit_exceeded").when(F.col("text").isNull(), "ocr_required")
    text = F.concat_ws("\n\n", F.col("blocks.markdown"))
    text = F.regexp_replace(text, r"\n+$", "")
    fine = F.col("error_code").isNull()
    return out.withColumn("error_code", code).select(
        "doc_id", F.when(fine, "ok").otherwise("error").alias("status"), "error_code", F.when(fine, F.when(text == "", "").otherwise(F.concat(text, F.lit("\n")))).alias("markdown"),
        F.when(fine, F.size("blocks")).alias("n_blocks"), "page_count", F.coalesce("n_images", F.lit(0)).alias("n_images"), F.when(fine, F.flatten(F.col("noted.warnings"))).alias("warnings"),
    )


def image_budget(drawn: DataFrame) -> DataFrame:
    """(doc_id, n_images, image_bytes): what decoding the images would take, known before any is decoded."""
    size = F.sum(F.col("px_w").cast("long") * F.col("px_h") * 4)
    return drawn.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.count("*").alias("n_images"), size.alias("image_bytes"))


def image_assets(shown: DataFrame) -> DataFrame:
    """(doc_id, number, file_name, media_type, data): the numbered images as PNG."""

    def run(frames):
        for pdf in frames:
            data = [images.encode(w, h, bytes(x)) for w, h, x in zip(pdf["px_w"], pdf["px_h"], pdf["rgba"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "number": pdf["number"], "file_name": [f"image-{n:03d}.png" for n in pdf["number"]], "media_type": "image/png", "data": data})

    return shown.select("doc_id", "number", "px_w", "px_h", "rgba").mapInPandas(run, "doc_id string, number int, file_name string, media_type string, data binary")


# Recognition of text in pages and images

# Images below these sizes are not worth recognising.
LEAST_SIDE, LEAST_PIXELS, LEAST_SHARE = 64, 16_384, 0.01


def pages_to_recognise(pages: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Pages without a visible glyph."""
    return pages.join(glyphs.where(~F.col("text").rlike(r"(?U)^\s*$")).select(*PAGE).distinct(), PAGE, "left_anti")


def images_to_recognise(pages: DataFrame, drawn: DataFrame) -> DataFrame:
    """Images large enough in pixels and on the page."""
    share = (F.col("r") - F.col("l")).cast("float") * (F.col("b") - F.col("t")).cast("float") / (F.col("width").cast("float") * F.col("height").cast("float"))
    large = (F.col("px_w") >= LEAST_SIDE) & (F.col("px_h") >= LEAST_SIDE) & (F.col("px_w").cast("long") * F.col("px_h") >= LEAST_PIXELS)
    return drawn.join(pages.select(*PAGE, "width", "height"), PAGE).where(large & (share >= LEAST_SHARE)).drop("width", "height")


def new_recognised_lines(found: DataFrame, glyphs: DataFrame) -> DataFrame:
    """``found`` (doc_id, page, ord, text, l, t, r, b) without lines that only repeat the glyphs under them: a spatial join by page."""
    key = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    x, g = found.alias("x"), glyphs.alias("g")
    meets = (F.col("x.l") < F.col("g.r")) & (F.col("x.r") > F.col("g.l")) & (F.col("x.t") < F.col("g.b")) & (F.col("x.b") > F.col("g.t"))
    same = (F.col("x.doc_id") == F.col("g.doc_id")) & (F.col("x.page") == F.col("g.page"))
    under = x.join(g, same & meets).groupBy("x.doc_id", "x.page", "x.ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g.idx", "g.text"))), lambda s: s["text"]), "").alias("under"))
    joined = found.join(under, [*PAGE, "ord"], "left")
    return joined.where((key(F.col("text")) != "") & (F.coalesce(key(F.col("under")), F.lit("")) != key(F.col("text")))).drop("under")
