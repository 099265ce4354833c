"""Markdown from a tree of blocks.

Blocks: ("heading", level, inlines) ("paragraph", inlines) ("list", ordered, start, items) ("table", alignments, rows)
("code", language, text) ("quote", blocks) ("image", asset id, alt) ("rule",).
Inlines: ("text", s) ("em", inlines) ("strong", inlines) ("code", s) ("link", url, title, inlines) ("break",).
"""

from __future__ import annotations

import re

ALIGN = {"none": "---", "left": ":---", "center": ":---:", "right": "---:"}


class EmitError(ValueError):
    pass


def escape_text(s: str, table: bool = False) -> str:
    s = re.sub(r"\r\n?", "\n", s)
    s = re.sub(r"([\\`*_~\[\]<>#!|])" if table else r"([\\`*_~\[\]<>#!])", r"\\\1", s).replace("&", "&amp;")
    s = re.sub(r"(?m)^( {0,3})([-+])(?=\s)", r"\1\\\2", s)
    s = re.sub(r"(?m)^( {0,3})(-{3,}|={3,})(?=\s*$)", r"\1\\\2", s)
    s = re.sub(r"(?m)^( {0,3}[0-9]+)([.)])(?=\s)", r"\1\\\2", s)
    return s.replace("\n", "<br>") if table else s


def escape_destination(s: str, table: bool = False) -> str:
    s = re.sub(r"([\\()|])" if table else r"([\\()])", r"\\\1", s)
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def longest_run(s: str, mark: str) -> int:
    return max(map(len, re.findall(re.escape(mark) + "+", s)), default=0)


def code_span(s: str, table: bool = False) -> str:
    if not s:
        return "<code></code>"
    fence = "`" * (longest_run(s, "`") + 1)
    pad = " " if s.strip(" ") and (s[0] in "` " or s[-1] in "` ") else ""
    if table:
        s = s.replace("|", "\\|").replace("\n", "<br>")
    return fence + pad + s + pad + fence


def inlines(items: list, table: bool = False) -> str:
    out = []
    for x in items:
        kind = x[0]
        if kind == "text":
            out.append(escape_text(x[1], table))
        elif kind == "em":
            out.append(f"*{inlines(x[1], table)}*")
        elif kind == "strong":
            out.append(f"**{inlines(x[1], table)}**")
        elif kind == "code":
            out.append(code_span(x[1], table))
        elif kind == "break":
            out.append("<br>" if table else "  \n")
        else:
            title = re.sub(r'([\\"|])' if table else r'([\\"])', r"\\\1", x[2]) if x[2] else ""
            out.append(f"[{inlines(x[3], table)}]({escape_destination(x[1], table)}" + (f' "{title}"' if title else "") + ")")
    return "".join(out)


def destinations(assets: list, prefix: str | None = None) -> dict[str, str]:
    """File name by asset id, under ``prefix`` if there is one."""
    out = {a.id: f"{prefix}/{a.file_name}" if prefix else a.file_name for a in assets}
    if len(out) < len(assets):
        raise EmitError("two assets have one id")
    return out


def block(b: tuple, files: dict[str, str] | None = None) -> str:
    kind = b[0]
    if kind == "heading":
        return "#" * b[1] + " " + inlines(b[2])
    if kind == "paragraph":
        return inlines(b[1])
    if kind == "rule":
        return "***"
    if kind == "image":
        if files is None or b[1] not in files:
            raise EmitError("an image names an asset that is not there")
        return f"![{escape_text(b[2])}]({escape_destination(files[b[1]])})"
    if kind == "quote":
        return "\n".join("> " + line if line else ">" for line in blocks(b[1], files).split("\n"))
    if kind == "code":
        lang, text = b[1] or "", re.sub(r"\r\n?", "\n", b[2])
        if "\n" in lang or "\r" in lang:
            raise EmitError("a language has no line breaks")
        mark = "~" if "`" in lang else "`"
        fence = mark * max(3, longest_run(text, mark) + 1)
        return f"{fence}{lang}\n{text}" + ("" if text.endswith("\n") else "\n") + fence
    if kind == "list":
        out = []
        for i, item in enumerate(b[3]):
            lead = f"{(b[2] if b[2] is not None else 1) + i}. " if b[1] else "- "
            pad = " " * len(lead)
            lines = blocks(item, files).split("\n")
            out.append("\n".join([lead + lines[0], *(pad + x if x else x for x in lines[1:])]))
        return "\n".join(out)
    aligns, rows = b[1], b[2]
    width = max(map(len, rows), default=0)
    if aligns and len(aligns) != width:
        raise EmitError("alignments do not fit the table")
    if not width:
        return ""
    row = lambda cells: "| " + " | ".join(cells) + " |"
    text = [[inlines(c, True) for c in r] + [""] * (width - len(r)) for r in rows]
    return "\n".join([row(text[0]), row(ALIGN[a] for a in aligns or ["none"] * width), *map(row, text[1:])])


def blocks(items: list, files: dict[str, str] | None = None) -> str:
    return "\n\n".join(block(b, files) for b in items)


def markdown(items: list, final_newline: bool = True, assets: list | None = None, prefix: str | None = None) -> str:
    """The text of a document; an image's destination is its asset's file name under ``prefix``."""
    text = blocks(items, destinations(assets or [], prefix)).replace("\r\n", "\n").replace("\r", "\n").rstrip("\n")
    return text + "\n" if text and final_newline else text
