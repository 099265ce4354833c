"""HTML documents as trees: a tokenizer, and the tree construction of the HTML standard with its error recovery.

Scripting counts as enabled, so the contents of noscript are raw text. Templates keep their contents as children. Framesets are not built.
"""

from __future__ import annotations

import html as entities
import re
from html.entities import html5

from veldmark.operators.errors import DEFAULT, Limits, within

# Element groups of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "keygen", "bgsound", "basefont", "frame"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "header", "hgroup", "main", "menu", "nav", "ol", "p", "search", "section", "summary", "ul"}
ENDED_AS_BLOCKS = (BLOCKS - {"p"}) | {"button", "listing", "pre", "object", "applet", "marquee"}
IMPLIED = {"dd", "dt", "li", "optgroup", "option", "p", "rb", "rp", "rt", "rtc"}
SCOPE = {"applet", "caption", "html", "table", "td", "th", "marquee", "object", "template", "mi", "mo", "mn", "ms", "mtext", "annotation-xml", "foreignObject", "desc"}
SPECIAL = {
    "address", "applet", "area", "article", "aside", "base", "basefont", "bgsound", "blockquote", "body", "br", "button", "caption", "center", "col", "colgroup", "dd", "details", "dir", "div", "dl", "dt", "embed",
    "fieldset", "figcaption", "figure", "footer", "form", "frame", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "iframe", "img", "input", "keygen", "li", "link", "listing",
    "main", "marquee", "menu", "meta", "nav", "noembed", "noframes", "noscript", "object", "ol", "p", "param", "plaintext", "pre", "script", "search", "section", "select", "source", "style", "summary", "table",
    "tbody", "td", "template", "textarea", "tfoot", "th", "thead", "title", "tr", "track", "ul", "wbr", "xmp",
}
TABLE_PARTS = {"caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
TABLE_CONTEXT = {"table", "tbody", "tfoot", "thead", "tr"}
BREAKOUT = BLOCKS - {"dir", "p"} | FORMATTING - {"a"} | HEADINGS | {"body", "br", "dd", "dt", "embed", "head", "hr", "img", "li", "listing", "meta", "p", "pre", "ruby", "span", "sub", "sup", "table", "var"}
WS = " \t\n\f\r"

_INSIDE = r"((?:[^>=]++|=[ \t\n\f]*+(?:\"[^\"]*+\"|'[^']*+'|[^ \t\n\f>\"'][^ \t\n\f>]*+|(?=>)))*+)>"
_TOKEN = re.compile(rf"<!--(?:>|->|[\s\S]*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*){_INSIDE}|<([a-zA-Z][^\s/>]*){_INSIDE}|</[^a-zA-Z][^>]*(?:>|\Z)")
_OPENED = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_REFERENCE = re.compile(r"&(#(?:[xX][0-9a-fA-F]+|[0-9]+);?|[A-Za-z][A-Za-z0-9]*;?)(?!=)")


class Element:
    __slots__ = ("name", "attrs", "children", "parent", "foreign")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, foreign: bool = False):
        self.name, self.attrs, self.children, self.parent, self.foreign = name, attrs or {}, [], None, foreign

    def add(self, child, at: int | None = None) -> None:
        """Append a child, or put it at a place; texts side by side are one."""
        i = len(self.children) if at is None else at
        if isinstance(child, str):
            if i and isinstance(self.children[i - 1], str):
                self.children[i - 1] += child
                return
        else:
            child.parent = self
        self.children.insert(i, child)

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


def attribute_value(text: str) -> str:
    """References decoded as in attributes: one without a semicolon before a letter, digit or equals sign stays."""
    if "&" not in text:
        return text

    def decode(m):
        name = m[1]
        if name[0] == "#":
            return entities.unescape(m[0] if name[-1] == ";" else m[0] + ";")
        return html5.get(name, m[0])

    return _REFERENCE.sub(decode, text)


def tokens(text: str):
    """("text", s, None), ("raw", s, name) after the start tag of a raw text element, ("start", name, (attributes, self-closing)), ("end", name, None)."""
    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        before = m.start() if m else n
        cut = _OPENED.search(text, at, before)  # a tag that never ends takes the rest
        if before > at:
            plain = text[at : cut.start() if cut else before]
            if plain:
                yield "text", entities.unescape(plain), None
        if cut or not m:
            return
        at = m.end()
        if m[1]:
            yield "end", m[1].lower(), None
        elif m[3]:
            name, attrs, rest = m[3].lower(), {}, m[4]
            if rest and not rest.isspace():
                for a in _ATTR.finditer(rest):
                    attrs.setdefault(a[1].lower(), attribute_value(next((g for g in a.groups()[1:] if g is not None), "")))
            yield "start", name, (attrs, rest.endswith("/"))
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(text, at)
                body = text[at : end.start() if end else n]
                yield "raw", entities.unescape(body) if name in ("title", "textarea") else body, name
                at = end.end() if end else n
            elif name == "plaintext":
                yield "text", text[at:], None
                return


def title(text: str) -> str | None:
    """The first title of a document, by its tokens alone; nothing after it is read."""
    for kind, value, name in tokens(text.removeprefix("﻿")):
        if kind == "raw" and name == "title":
            return " ".join(value.split()) or None
    return None


class Builder:
    """Tree construction; ``mode`` is the name of the method that takes tags outside foreign content."""

    def __init__(self):
        self.document, self.html = Element("#document"), Element("html")
        self.document.add(self.html)
        self.head = self.body = self.form = None
        self.stack, self.active, self.mode, self.foster = [self.html], [], "before_head", False

    # places

    @property
    def top(self) -> Element:
        return self.stack[-1]

    def place(self, parent: Element | None = None) -> tuple[Element, int | None]:
        """Where the next node goes: into the current one, or before a table that it may not be in."""
        parent = parent or self.top
        if not self.foster or parent.name not in TABLE_CONTEXT or parent.foreign:
            return parent, None
        i = max((k for k, e in enumerate(self.stack) if e.name == "table"), default=0)
        j = max((k for k, e in enumerate(self.stack) if e.name == "template"), default=-1)
        if j > i or not i:
            return (self.stack[j] if j > i else self.html), None
        table = self.stack[i]
        if table.parent is None:
            return self.stack[i - 1], None
        return table.parent, next(k for k, c in enumerate(table.parent.children) if c is table)

    def insert(self, name: str, attrs: dict | None = None, foreign: bool = False) -> Element:
        e = Element(name, attrs, foreign)
        parent, at = self.place()
        parent.add(e, at)
        self.stack.append(e)
        return e

    def leaf(self, name: str, attrs: dict) -> None:
        self.insert(name, attrs)
        self.stack.pop()

    def write(self, text: str) -> None:
        parent, at = self.place()
        parent.add(text, at)

    def pop_to(self, *names: str) -> None:
        while self.stack.pop().name not in names:
            pass

    def clear_to(self, *names: str) -> None:
        while self.top.name not in names and self.top is not self.html:
            self.stack.pop()

    def in_scope(self, *names: str, more=frozenset(), stop=SCOPE) -> bool:
        for e in reversed(self.stack):
            if e.name in names and not e.foreign:
                return True
            if e.name in stop or e.name in more:
                return False
        return False

    def in_table_scope(self, *names: str) -> bool:
        return self.in_scope(*names, stop={"html", "table", "template"})

    def imply(self, but: str = "") -> None:
        while self.top.name in IMPLIED and self.top.name != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_scope("p", more={"button"}):
            self.imply("p")
            self.pop_to("p")

    # formatting

    def remember(self, e: Element) -> None:
        same = 0
        for i in range(len(self.active) - 1, -1, -1):
            x = self.active[i]
            if x is None:
                break
            if x.name == e.name and x.attrs == e.attrs:
                same += 1
                if same == 3:
                    del self.active[i]
                    break
        self.active.append(e)

    def reopen(self) -> None:
        """Formatting elements that were left open are opened again."""
        active, i = self.active, len(self.active)
        while i and active[i - 1] is not None and not self.is_open(active[i - 1]):
            i -= 1
        for k in range(i, len(active)):
            active[k] = self.insert(active[k].name, dict(active[k].attrs))

    def is_open(self, e: Element) -> bool:
        return any(x is e for x in self.stack)

    def forget_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, name: str) -> None:
        """The end of a formatting element, around which other elements may be open still."""
        stack, active = self.stack, self.active
        if self.top.name == name and not any(x is self.top for x in active):
            stack.pop()
            return
        for _ in range(8):
            element = None
            for x in reversed(active):
                if x is None or x.name == name:
                    element = x
                    break
            if element is None:
                return self.any_end(name)
            if not self.is_open(element):
                active.remove(element)
                return None
            if not self.in_scope(name):
                return None
            at = next(i for i, x in enumerate(stack) if x is element)
            furthest = next((x for x in stack[at + 1 :] if x.name in SPECIAL and not x.foreign), None)
            if furthest is None:
                del stack[at:]
                active.remove(element)
                return None
            ancestor, bookmark, last = stack[at - 1], active.index(element), furthest
            i, inner = next(k for k, x in enumerate(stack) if x is furthest), 0
            while True:
                i -= 1
                inner += 1
                node = stack[i]
                if node is element:
                    break
                known = next((k for k, x in enumerate(active) if x is node), None)
                if known is not None and inner > 3:
                    del active[known]
                    bookmark -= known < bookmark
                    known = None
                if known is None:
                    del stack[i]
                    continue
                node = Element(node.name, dict(node.attrs))
                active[known] = stack[i] = node
                if last is furthest:
                    bookmark = known + 1
                last.detach()
                node.add(last)
                last = node
            last.detach()
            foster, self.foster = self.foster, True
            parent, where = self.place(ancestor)
            self.foster = foster
            parent.add(last, where)
            clone = Element(element.name, dict(element.attrs))
            for c in furthest.children:
                clone.add(c)
            furthest.children = []
            furthest.add(clone)
            gone = active.index(element)
            del active[gone]
            active.insert(bookmark - (gone < bookmark), clone)
            stack[:] = [x for x in stack if x is not element]
            stack.insert(next(k for k, x in enumerate(stack) if x is furthest) + 1, clone)
        return None

    def any_end(self, name: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            e = self.stack[i]
            if e.name == name:
                self.imply(name)
                del self.stack[i:]
                return
            if e.name in SPECIAL and not e.foreign:
                return

    # tokens

    def feed(self, kind: str, value: str, more) -> None:
        if kind == "text":
            self.text(value)
        elif kind == "raw":
            # the raw text element is the current one, unless its start tag was ignored
            if self.top.name == more:
                value = value[1:] if more == "textarea" and value.startswith("\n") else value
                if value:
                    self.top.add(value)
                self.stack.pop()
        elif self.top.foreign and self.in_foreign(kind, value, more):
            return
        elif kind == "start":
            getattr(self, self.mode)(value, *more)
        else:
            getattr(self, self.mode + "_end")(value)

    def text(self, s: str) -> None:
        s = s.replace("\0", "")
        if self.mode in ("before_head", "in_head", "after_head"):
            rest = s.lstrip(WS)
            if len(rest) < len(s) and self.mode != "before_head":
                (self.head if self.mode == "in_head" else self.html).add(s[: len(s) - len(rest)])
            if not rest:
                return
            self.to_body()
            s = rest
        if not s:
            return
        if self.top.foreign or self.mode == "in_select":
            self.write(s)
        elif self.mode == "in_columns":
            rest = s.lstrip(WS)
            if len(rest) < len(s):
                self.write(s[: len(s) - len(rest)])
            if rest and self.top.name == "colgroup":
                self.stack.pop()
                self.mode = "in_table"
                self.text(rest)
        elif self.mode in ("in_table", "in_rows", "in_row") and self.top.name in TABLE_CONTEXT:
            if s.strip(WS):
                self.outside_table(self.body_text, s)
            else:
                self.write(s)
        else:
            self.body_text(s)

    def body_text(self, s: str) -> None:
        if self.mode == "after_body" and s.strip(WS):
            self.mode = "in_body"
        self.reopen()
        self.write(s)

    def outside_table(self, act, *args) -> None:
        self.foster = True
        act(*args)
        self.foster = False

    def in_foreign(self, kind: str, name: str, more) -> bool:
        """Tags of SVG and MathML; a tag that only HTML has ends them."""
        if kind == "start":
            if name in BREAKOUT or (name == "font" and {"color", "face", "size"} & more[0].keys()):
                while self.top.foreign and self.top.name not in ("foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext"):
                    self.stack.pop()
                return False
            if self.top.name in ("foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext", "annotation-xml") and name not in ("svg", "math"):
                return False
            self.insert(name, more[0], True)
            if more[1]:
                self.stack.pop()
            return True
        for i in range(len(self.stack) - 1, 0, -1):
            if not self.stack[i].foreign:
                return False
            if self.stack[i].name == name:
                del self.stack[i:]
                return True
        return False

    # before and around the body

    def to_head(self, attrs: dict | None = None) -> None:
        self.head, self.mode = self.insert("head", attrs), "in_head"

    def to_body(self, attrs: dict | None = None) -> None:
        if self.head is None:
            self.to_head()
        if self.mode == "in_head":
            self.stack[:] = [self.html]
        self.body, self.mode = self.insert("body", attrs), "in_body"

    def merge(self, e: Element, attrs: dict) -> None:
        for k, v in attrs.items():
            e.attrs.setdefault(k, v)

    def before_head(self, name, attrs, closed):
        if name == "html":
            self.merge(self.html, attrs)
        elif name == "head":
            self.to_head(attrs)
        else:
            self.to_head()
            self.in_head(name, attrs, closed)

    def before_head_end(self, name):
        if name in ("head", "body", "html", "br"):
            self.to_head()
            self.in_head_end(name)

    def in_head(self, name, attrs, closed):
        if name == "html":
            self.merge(self.html, attrs)
        elif name in HEAD:
            self.insert(name, attrs)
            if name in VOID:
                self.stack.pop()
            elif name == "template":
                self.active.append(None)
                self.mode = "in_body"
        elif name != "head":
            self.stack.pop()
            self.mode = "after_head"
            self.after_head(name, attrs, closed)

    def in_head_end(self, name):
        if name in ("head", "body", "html", "br"):
            self.stack.pop()
            self.mode = "after_head"
            if name != "head":
                self.after_head_end(name)
        elif name == "template":
            self.end_template()

    def after_head(self, name, attrs, closed):
        if name == "html":
            self.merge(self.html, attrs)
        elif name == "body":
            self.to_body(attrs)
        elif name in HEAD:
            self.stack.append(self.head)
            self.in_head(name, attrs, closed)
            self.stack = [x for x in self.stack if x is not self.head]
        elif name not in ("head", "frameset"):
            self.to_body()
            self.in_body(name, attrs, closed)

    def after_head_end(self, name):
        if name in ("body", "html", "br"):
            self.to_body()
            self.in_body_end(name)
        elif name == "template":
            self.end_template()

    def after_body(self, name, attrs, closed):
        if name == "html":
            self.merge(self.html, attrs)
        else:
            self.mode = "in_body"
            self.in_body(name, attrs, closed)

    def after_body_end(self, name):
        if name != "html":
            self.mode = "in_body"
            self.in_body_end(name)

    def end_template(self) -> None:
        if any(e.name == "template" for e in self.stack):
            while self.stack.pop().name != "template":
                pass
            self.forget_to_marker()
            self.reset_mode()

    def reset_mode(self) -> None:
        """The mode that the open elements call for."""
        modes = {"select": "in_select", "td": "in_cell", "th": "in_cell", "tr": "in_row", "tbody": "in_rows", "thead": "in_rows", "tfoot": "in_rows", "caption": "in_caption", "colgroup": "in_columns", "table": "in_table", "template": "in_body", "body": "in_body", "head": "in_head"}
        for e in reversed(self.stack):
            if e.name in modes and not e.foreign:
                self.mode = modes[e.name]
                return
        self.mode = "in_body" if self.body is not None else "after_head" if self.head is not None else "before_head"

    # the body

    def in_body(self, name, attrs, closed):
        if name in FORMATTING:
            self.format(name, attrs)
        elif name in BLOCKS or name in ("pre", "listing"):
            self.close_p()
            self.insert(name, attrs)
        elif name in HEADINGS:
            self.close_p()
            if self.top.name in HEADINGS:
                self.stack.pop()
            self.insert(name, attrs)
        elif name == "html":
            self.merge(self.html, attrs)
        elif name in HEAD:
            self.insert(name, attrs)
            if name in VOID:
                self.stack.pop()
            elif name == "template":
                self.active.append(None)
        elif name == "body":
            if self.body is not None and not any(e.name == "template" for e in self.stack):
                self.merge(self.body, attrs)
        elif name == "form":
            if self.form is None:
                self.close_p()
                self.form = self.insert(name, attrs)
        elif name in ("li", "dd", "dt"):
            ends = {"li"} if name == "li" else {"dd", "dt"}
            for e in reversed(self.stack):
                if e.name in ends:
                    self.imply(e.name)
                    self.pop_to(e.name)
                    break
                if e.name in SPECIAL and not e.foreign and e.name not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(name, attrs)
        elif name == "button":
            if self.in_scope("button"):
                self.imply()
                self.pop_to("button")
            self.reopen()
            self.insert(name, attrs)
        elif name in ("applet", "marquee", "object"):
            self.reopen()
            self.insert(name, attrs)
            self.active.append(None)
        elif name == "table":
            self.close_p()
            self.insert(name, attrs)
            self.mode = "in_table"
        elif name in ("param", "source", "track"):
            self.leaf(name, attrs)
        elif name == "hr":
            self.close_p()
            self.leaf(name, attrs)
        elif name == "image":
            self.in_body("img", attrs, closed)
        elif name in VOID - {"col", "frame"}:
            self.reopen()
            self.leaf(name, attrs)
        elif name == "plaintext":
            self.close_p()
            self.insert(name, attrs)
        elif name == "xmp":
            self.close_p()
            self.reopen()
            self.insert(name, attrs)
        elif name in ("textarea", "iframe", "noembed"):
            self.insert(name, attrs)
        elif name == "select":
            self.reopen()
            self.insert(name, attrs)
            self.mode = "in_select"
        elif name in ("optgroup", "option"):
            if self.top.name == "option":
                self.stack.pop()
            self.reopen()
            self.insert(name, attrs)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.imply("rtc" if name in ("rp", "rt") else "")
            self.insert(name, attrs)
        elif name in ("svg", "math"):
            self.reopen()
            self.insert(name, attrs, True)
            if closed:
                self.stack.pop()
        elif name not in TABLE_PARTS and name not in ("head", "frame", "frameset"):
            self.reopen()
            self.insert(name, attrs)

    def format(self, name, attrs) -> None:
        if name == "a":
            for x in reversed(self.active):
                if x is None:
                    break
                if x.name == "a":
                    self.adopt("a")
                    self.active = [y for y in self.active if y is not x]
                    self.stack = [y for y in self.stack if y is not x]
                    break
        self.reopen()
        if name == "nobr" and self.in_scope("nobr"):
            self.adopt("nobr")
            self.reopen()
        self.remember(self.insert(name, attrs))

    def in_body_end(self, name):
        if name in FORMATTING:
            self.adopt(name)
        elif name in ("body", "html"):
            if self.in_scope("body"):
                self.mode = "after_body"
                if name == "html":
                    self.after_body_end(name)
        elif name == "form":
            node, self.form = self.form, None
            if node is not None and self.is_open(node) and self.in_scope("form"):
                self.imply()
                self.stack = [x for x in self.stack if x is not node]
        elif name == "p":
            if not self.in_scope("p", more={"button"}):
                self.insert("p")
            self.close_p()
        elif name in ENDED_AS_BLOCKS or name in ("li", "dd", "dt"):
            if self.in_scope(name, more={"ol", "ul"} if name == "li" else frozenset()):
                self.imply(name if name in ("li", "dd", "dt") else "")
                self.pop_to(name)
                if name in ("applet", "marquee", "object"):
                    self.forget_to_marker()
        elif name in HEADINGS:
            if self.in_scope(*HEADINGS):
                self.imply()
                self.pop_to(*HEADINGS)
        elif name == "br":
            self.reopen()
            self.leaf("br", {})
        elif name == "template":
            self.end_template()
        else:
            self.any_end(name)

    # tables

    def in_table(self, name, attrs, closed):
        if name == "caption":
            self.clear_to("table", "template")
            self.active.append(None)
            self.insert(name, attrs)
            self.mode = "in_caption"
        elif name in ("colgroup", "col"):
            self.clear_to("table", "template")
            self.insert("colgroup", attrs if name == "colgroup" else {})
            self.mode = "in_columns"
            if name == "col":
                self.in_columns(name, attrs, closed)
        elif name in ("tbody", "thead", "tfoot", "tr", "td", "th"):
            self.clear_to("table", "template")
            self.insert(name if name in ("tbody", "thead", "tfoot") else "tbody", attrs if name in ("tbody", "thead", "tfoot") else {})
            self.mode = "in_rows"
            if name in ("tr", "td", "th"):
                self.in_rows(name, attrs, closed)
        elif name == "table":
            if self.in_table_scope("table"):
                self.pop_to("table")
                self.reset_mode()
                getattr(self, self.mode)(name, attrs, closed)
        elif name in ("style", "script", "template"):
            self.in_body(name, attrs, closed)
        elif name == "input" and attrs.get("type", "").lower() == "hidden":
            self.leaf(name, attrs)
        elif name == "form":
            if self.form is None and not any(e.name == "template" for e in self.stack):
                self.form = self.insert(name, attrs)
                self.stack.pop()
        else:
            self.outside_table(self.in_body, name, attrs, closed)

    def in_table_end(self, name):
        if name == "table":
            if self.in_table_scope("table"):
                self.pop_to("table")
                self.reset_mode()
        elif name == "template":
            self.end_template()
        elif name not in TABLE_PARTS and name not in ("body", "html"):
            self.outside_table(self.in_body_end, name)

    def end_caption(self) -> bool:
        if not self.in_table_scope("caption"):
            return False
        self.imply()
        self.pop_to("caption")
        self.forget_to_marker()
        self.mode = "in_table"
        return True

    def in_caption(self, name, attrs, closed):
        if name in TABLE_PARTS or name == "table":
            if self.end_caption():
                self.in_table(name, attrs, closed)
        else:
            self.in_body(name, attrs, closed)

    def in_caption_end(self, name):
        if name == "caption":
            self.end_caption()
        elif name == "table":
            if self.end_caption():
                self.in_table_end(name)
        elif name not in TABLE_PARTS and name not in ("body", "html"):
            self.in_body_end(name)

    def in_columns(self, name, attrs, closed):
        if name == "col":
            self.leaf(name, attrs)
        elif name == "template":
            self.in_body(name, attrs, closed)
        elif name != "html" and self.top.name == "colgroup":
            self.stack.pop()
            self.mode = "in_table"
            self.in_table(name, attrs, closed)

    def in_columns_end(self, name):
        if name == "template":
            self.end_template()
        elif name != "col" and self.top.name == "colgroup":
            self.stack.pop()
            self.mode = "in_table"
            if name != "colgroup":
                self.in_table_end(name)

    def in_rows(self, name, attrs, closed):
        if name in ("tr", "th", "td"):
            self.clear_to("tbody", "tfoot", "thead", "template")
            self.insert("tr", attrs if name == "tr" else {})
            self.mode = "in_row"
            if name != "tr":
                self.in_row(name, attrs, closed)
        elif name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead"):
            if self.in_table_scope("tbody", "thead", "tfoot"):
                self.end_rows()
                self.in_table(name, attrs, closed)
        else:
            self.in_table(name, attrs, closed)

    def end_rows(self) -> None:
        self.clear_to("tbody", "tfoot", "thead", "template")
        self.stack.pop()
        self.mode = "in_table"

    def in_rows_end(self, name):
        if name in ("tbody", "tfoot", "thead"):
            if self.in_table_scope(name):
                self.end_rows()
        elif name == "table":
            if self.in_table_scope("tbody", "thead", "tfoot"):
                self.end_rows()
                self.in_table_end(name)
        elif name not in TABLE_PARTS and name not in ("body", "html"):
            self.in_table_end(name)

    def end_row(self) -> bool:
        if not self.in_table_scope("tr"):
            return False
        self.clear_to("tr", "template")
        self.stack.pop()
        self.mode = "in_rows"
        return True

    def in_row(self, name, attrs, closed):
        if name in ("th", "td"):
            self.clear_to("tr", "template")
            self.insert(name, attrs)
            self.active.append(None)
            self.mode = "in_cell"
        elif name in TABLE_PARTS:
            if self.end_row():
                self.in_rows(name, attrs, closed)
        else:
            self.in_table(name, attrs, closed)

    def in_row_end(self, name):
        if name == "tr":
            self.end_row()
        elif name in ("table", "tbody", "tfoot", "thead"):
            if (name == "table" or self.in_table_scope(name)) and self.end_row():
                self.in_rows_end(name)
        elif name not in TABLE_PARTS and name not in ("body", "html"):
            self.in_table_end(name)

    def end_cell(self) -> None:
        self.imply()
        self.pop_to("td", "th")
        self.forget_to_marker()
        self.mode = "in_row"

    def in_cell(self, name, attrs, closed):
        if name in TABLE_PARTS:
            if self.in_table_scope("td", "th"):
                self.end_cell()
                self.in_row(name, attrs, closed)
        else:
            self.in_body(name, attrs, closed)

    def in_cell_end(self, name):
        if name in ("td", "th"):
            if self.in_table_scope(name):
                self.imply()
                self.pop_to(name)
                self.forget_to_marker()
                self.mode = "in_row"
        elif name in ("table", "tbody", "tfoot", "thead", "tr"):
            if self.in_table_scope(name):
                self.end_cell()
                self.in_row_end(name)
        elif name not in TABLE_PARTS and name not in ("body", "html"):
            self.in_body_end(name)

    # selects

    def end_select(self) -> bool:
        if not any(e.name == "select" for e in self.stack):
            return False
        self.pop_to("select")
        self.reset_mode()
        return True

    def in_select(self, name, attrs, closed):
        if name in ("option", "optgroup", "hr"):
            if self.top.name == "option":
                self.stack.pop()
            if name != "option" and self.top.name == "optgroup":
                self.stack.pop()
            self.insert(name, attrs)
            if name == "hr":
                self.stack.pop()
        elif name in ("script", "template"):
            self.in_body(name, attrs, closed)
        elif name in ("select", "input", "keygen", "textarea") or (name in TABLE_PARTS | {"table"} and self.in_scope("table", stop={"html"})):
            if self.end_select() and name != "select":
                getattr(self, self.mode)(name, attrs, closed)

    def in_select_end(self, name):
        if name == "optgroup":
            if self.top.name == "option" and len(self.stack) > 1 and self.stack[-2].name == "optgroup":
                self.stack.pop()
            if self.top.name == "optgroup":
                self.stack.pop()
        elif name == "option":
            if self.top.name == "option":
                self.stack.pop()
        elif name == "select":
            self.end_select()
        elif name == "template":
            self.end_template()
        elif name in TABLE_PARTS | {"table"} and self.in_table_scope(name) and self.end_select():
            getattr(self, self.mode + "_end")(name)


def parse(text: str, limits: Limits = DEFAULT) -> Element:
    """A document tree, within the budgets of depth and nodes."""
    builder = Builder()
    after_pre = False
    for kind, value, more in tokens(text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")):
        if after_pre and kind == "text" and value.startswith("\n"):
            value = value[1:]
        after_pre = kind == "start" and value in ("pre", "listing")
        if value or kind != "text":
            builder.feed(kind, value, more)
    if builder.body is None:
        builder.to_body()
    work, count = [(builder.document, 0)], 0
    while work:
        e, depth = work.pop()
        within("html_dom_depth", depth, limits.html_dom_depth)
        count = within("html_dom_nodes", count + 1, limits.html_dom_nodes)
        if not isinstance(e, str):
            work += [(c, depth + 1) for c in reversed(e.children)]
    return builder.document
