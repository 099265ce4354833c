"""Strict CSV, JSON and XML readers and their block trees."""

from __future__ import annotations

import json
import re
from collections import Counter
from xml.parsers import expat

from veldmark.operators.errors import DEFAULT, FormatError, Limits


def decode(content: bytes) -> str:
    try:
        return content.decode("utf-8").removeprefix("\ufeff")
    except UnicodeDecodeError as e:
        raise FormatError("not UTF-8") from e


_FIELD = {d: re.compile(rf'"((?:[^"\r]|""|\r\n)*)"|([^{re.escape(d)}\n\r"]*)') for d in ",;\t|"}


def parse_csv(text: str, delimiter: str, limits: Limits = DEFAULT) -> list[list[str]]:
    """Records; quotes only around whole fields, a lone carriage return is an error, blank lines are records."""
    out, row, cells, at, n = [], [], 0, 0, len(text)
    if not n:
        return out
    field = _FIELD[delimiter]
    while True:
        m = field.match(text, at)
        value = m[1].replace('""', '"') if m[1] is not None else m[2]
        if len(value) * 4 > limits.csv_field_bytes:
            raw, n_bytes = value.encode(), limits.csv_field_bytes + 1
            while n_bytes < len(raw) and raw[n_bytes] & 0xC0 == 0x80:  # to the end of the first character over the budget
                n_bytes += 1
            limits.check("csv_field_bytes", min(n_bytes, len(raw)))
        row.append(value)
        cells += 1
        if len(row) > limits.csv_fields_per_record or cells > limits.csv_cells:
            limits.check("csv_fields_per_record", len(row))
            limits.check("csv_cells", cells)
        at = m.end()
        if at < n and text[at] == delimiter:
            at += 1
            continue
        if at < n and not (text.startswith("\r\n", at) or text[at] == "\n"):
            raise FormatError("malformed record")
        out.append(row)
        limits.check("csv_records", len(out))
        if at < n:
            at += 2 if text[at] == "\r" else 1
        if at >= n:
            return out
        row = []


def delimiter_scores(text: str, limits: Limits = DEFAULT) -> dict[str, tuple[int, int, int]]:
    """(records of the usual width, that width, records) of the delimiters that split a record; the larger of equally usual widths."""
    scores, refused = {}, None
    for d in ",;\t|":
        try:
            rows = parse_csv(text, d, limits)
        except FormatError as e:
            refused = refused or (e if e.limit else None)
            continue
        if widths := Counter(w for w in map(len, rows) if w > 1):
            width, often = max(widths.items(), key=lambda x: (x[1], x[0]))
            scores[d] = (often, width, len(rows))
    if not scores and refused:
        raise refused
    return scores


def detect_delimiter(text: str, limits: Limits = DEFAULT) -> tuple[str | None, bool]:
    """(delimiter, unique): the one of the best score; none if no delimiter splits a record."""
    scores = delimiter_scores(text, limits)
    if not scores:
        return None, True
    top = max(scores.values())
    found = [d for d, s in scores.items() if s == top]
    return found[0], len(found) == 1


def lines(text: str) -> list:
    """Text with line breaks as inlines."""
    out: list = []
    for i, part in enumerate(re.split(r"\r\n|\n|\r", text)):
        if i:
            out.append(("break",))
        if part:
            out.append(("text", part))
    return out


def csv_blocks(content: bytes, limits: Limits = DEFAULT) -> tuple[list, dict, list]:
    text = decode(content)
    delimiter, unique = detect_delimiter(text, limits)
    if not unique:
        raise FormatError("ambiguous delimiter")
    rows = parse_csv(text, delimiter or ",", limits)
    names = {",": "comma", ";": "semicolon", "\t": "tab", "|": "pipe"}
    properties = {"delimiter": names[delimiter or ","], "header_policy": "first_record", "blank_record_policy": "preserve_one_empty_cell", "line_ending_policy": "lf_or_crlf"}
    if not rows:
        return [], properties, [("table_degraded", "CSV input is empty; no table was emitted")]
    ragged = sum(len(r) != len(rows[0]) for r in rows)
    warnings = [("table_degraded", f"CSV rows do not all have the header's {len(rows[0])} columns")] if ragged else []
    return [("table", [], [[lines(c) for c in r] for r in rows])], properties, warnings


class Number(str):
    """The exact text of a number."""


#: Fixed value: a key that readers of exact numbers keep for themselves.
RESERVED_KEY = "$serde_json::private::Number"


def _constant(name):
    raise FormatError(f"{name} is not JSON")


def _depth(text: str, enough: int = 128) -> int:
    """Depth outside strings, up to one more than ``enough``."""
    depth = most = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', text, re.S):
        depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(m[0], 0)
        most = max(most, depth)
        if most > enough:
            break
    return most


def parse_json(text: str, limits: Limits = DEFAULT):
    """Values in source order with the exact text of numbers; repeated keys and text after the value are errors."""
    limits.check("json_nesting_depth", _depth(text, limits.json_nesting_depth))

    def pairs(items):
        keys = {k for k, _ in items}
        if len(keys) != len(items):
            raise FormatError("duplicate key")
        if RESERVED_KEY in keys:
            raise FormatError("reserved key")
        return dict(items)

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_int=Number, parse_float=Number, parse_constant=_constant)
    except (json.JSONDecodeError, RecursionError) as e:
        raise FormatError(str(e)) from e
    nodes = 0

    def count(v):
        nonlocal nodes
        nodes = limits.check("json_nodes", nodes + 1)
        if isinstance(v, (dict, list)):
            name = "json_object_entries" if isinstance(v, dict) else "json_array_entries"
            for i, x in enumerate(v.values() if isinstance(v, dict) else v):
                limits.check(name, i + 1)
                count(x)
        elif isinstance(v, str):
            try:
                v.encode()
            except UnicodeEncodeError as e:
                raise FormatError("half a surrogate pair") from e

    count(value)
    return value


def is_json(text: str, limits: Limits = DEFAULT) -> bool:
    """The grammar alone: repeated keys and sizes do not matter here, but the depth does."""
    limits.check("json_nesting_depth", _depth(text, limits.json_nesting_depth))
    try:
        json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_constant)
        return True
    except (json.JSONDecodeError, RecursionError, FormatError):
        return False


def _scalar(v) -> list:
    if isinstance(v, Number):
        return [("code", str(v))]
    if isinstance(v, str):
        return lines(v)
    return [("code", "null" if v is None else "true" if v is True else "false")] if not isinstance(v, (dict, list)) else [("code", "{}" if isinstance(v, dict) else "[]")]


def _members(d: dict) -> list[list]:
    out = []
    for k, v in d.items():
        if isinstance(v, (dict, list)) and v:
            out.append([("paragraph", [("strong", [("text", k)]), ("text", ":")]), *json_tree(v)])
        else:
            out.append([("paragraph", [("strong", [("text", k)]), ("text", ": "), *_scalar(v)])])
    return out


def json_tree(v) -> list:
    if isinstance(v, dict) and v:
        return [("list", False, None, _members(v))]
    if isinstance(v, list) and v:
        items = []
        for x in v:
            items.append([b for m in _members(x) for b in m] if isinstance(x, dict) and x else json_tree(x) if isinstance(x, list) and x else [("paragraph", _scalar(x))])
        return [("list", False, None, items)]
    return [("paragraph", _scalar(v))]


def json_blocks(content: bytes, limits: Limits = DEFAULT) -> tuple[list, dict, list]:
    return json_tree(parse_json(decode(content), limits)), {"object_key_order": "source"}, []


#: Names that XML binds for itself.
XML_NAMESPACE, XMLNS_NAMESPACE = "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2000/xmlns/"


class Node:
    """An element: name and attributes as written, the same as (namespace, local name), children in order."""

    __slots__ = ("name", "attributes", "uri", "local", "expanded", "children")

    def __init__(self, name, attributes, uri, local, expanded):
        self.name, self.attributes, self.uri, self.local, self.expanded, self.children = name, attributes, uri, local, expanded, []

    def named(self, uri: str, local: str) -> bool:
        return self.local == local and self.uri == uri

    def get(self, local: str, uri: str | None = None) -> str | None:
        return self.expanded.get((uri, local))

    def elements(self, uri: str | None = None, *locals_: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and (not locals_ or (c.uri == uri and c.local in locals_))]

    def child(self, uri: str, local: str) -> Node | None:
        return next(iter(self.elements(uri, local)), None)

    def below(self, uri: str, *locals_: str):
        """Elements under this one by name, in document order."""
        for c in self.elements():
            if c.uri == uri and c.local in locals_:
                yield c
            yield from c.below(uri, *locals_)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


def _bind(prefix: str, uri: str) -> None:
    if prefix == "xmlns" or uri == XMLNS_NAMESPACE or (prefix == "xml") != (uri == XML_NAMESPACE) or (prefix and not uri):
        raise FormatError(f"the prefix {prefix} can't stand for {uri}")


def parse_xml(content: bytes, limits: Limits = DEFAULT) -> Node:
    """The root of a document in UTF-8 without a document type; namespaces are resolved, budgets are exact."""
    text, root, stack, used = decode(content), [], [], Counter()
    parser = expat.ParserCreate(encoding="UTF-8")
    parser.ordered_attributes, parser.buffer_text = True, False

    def refuse(*_):
        raise FormatError("document types are not read")

    def declared(version, encoding, standalone):
        if version != "1.0" or (encoding or "UTF-8").upper() != "UTF-8":
            raise FormatError("only XML 1.0 in UTF-8 is read")

    def instruction(target, _):
        if ":" in target or target.lower() == "xml":
            raise FormatError("a processing instruction has a reserved name")

    def taken(name, n):
        used[name] = limits.check(name, used[name] + n)

    def start(name, flat):
        attrs = list(zip(flat[::2], flat[1::2]))
        if attrs:
            limits.check("xml_attributes_per_element", len(attrs))
            taken("xml_attributes", len(attrs))
            taken("xml_text_bytes", sum(len(v.encode()) for _, v in attrs))
        limits.check("xml_nesting_depth", len(stack) + 1)
        taken("xml_nodes", 1)
        scope = stack[-1][1] if stack else {"xml": XML_NAMESPACE}
        bound = {k[6:] if k != "xmlns" else "": v for k, v in attrs if k == "xmlns" or k.startswith("xmlns:")}
        for prefix, uri in bound.items():
            _bind(prefix, uri)
        scope = {**scope, **bound} if bound else scope

        def expand(qname, default):
            prefix, colon, local = qname.partition(":")
            if not colon:
                return (scope.get("") or None if default else None), qname
            if not prefix or not local or ":" in local or prefix not in scope or re.match(r"[-.0-9\u00b7]", local):
                raise FormatError(f"{qname} is not a bound name")
            return scope[prefix], local

        expanded = {}
        for k, v in attrs:
            if k != "xmlns" and not k.startswith("xmlns:"):
                key = expand(k, False)
                if key in expanded:
                    raise FormatError("repeated attribute")
                expanded[key] = v
        node = Node(name, attrs, *expand(name, True), expanded)
        (stack[-1][0].children if stack else root).append(node)
        stack.append((node, scope))

    def characters(s):
        if stack:
            taken("xml_text_bytes", len(s.encode()))
            children = stack[-1][0].children
            if children and isinstance(children[-1], str):
                children[-1] += s
            else:
                taken("xml_nodes", 1)
                children.append(s)

    parser.StartElementHandler, parser.EndElementHandler = start, lambda _: stack.pop()
    parser.CharacterDataHandler, parser.XmlDeclHandler = characters, declared
    parser.StartDoctypeDeclHandler, parser.ProcessingInstructionHandler = refuse, instruction
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError as e:
        raise FormatError(str(e)) from e
    return root[0]


def xml_tree(node: Node) -> list:
    children = node.children
    if any(isinstance(c, Node) for c in children):
        children = [c for c in children if isinstance(c, Node) or c.strip(" \t\r\n") or "\n" not in c]
    head: list = [("strong", [("text", node.name)])]
    if node.attributes:
        head.append(("text", " ("))
        for i, (k, v) in enumerate(node.attributes):
            head += [("text", ", ")] * bool(i) + [("strong", [("text", k)]), ("text", ": "), ("code", v)]
        head.append(("text", ")"))
    if len(children) == 1 and isinstance(children[0], str):
        return [("paragraph", [*head, ("text", ": "), *lines(children[0])])]
    out = [("paragraph", head)]
    for c in children:
        out.append(("list", False, None, [xml_tree(c)]) if isinstance(c, Node) else ("paragraph", lines(c)))
    return out


def xml_blocks(content: bytes, limits: Limits = DEFAULT) -> tuple[list, dict, list]:
    return [("list", False, None, [xml_tree(parse_xml(content, limits))])], {}, []


def detect(content: bytes, extension: str | None = None, limits: Limits = DEFAULT) -> tuple[str | None, str | None]:
    """(format, error code) of a text by the structured formats that it follows and its extension (csv, json, xml or none)."""
    found, refused = candidates(content, limits), None
    if isinstance(found, FormatError):
        refused, found = found, []
    if not found:
        if refused:
            raise refused
        return (extension, None) if extension else (None, "unsupported_format")
    unique = "csv" not in found or detect_delimiter(decode(content), limits)[1]
    if extension:
        if extension not in found:
            return None, "format_conflict"
        return (None, "ambiguous_format") if extension == "csv" and not unique else (extension, None)
    return (found[0], None) if len(found) == 1 and unique else (None, "ambiguous_format")


def candidates(content: bytes, limits: Limits = DEFAULT) -> list[str] | FormatError:
    """The structured formats that a text follows, in the order csv, json, xml; the first budget's error if it follows none."""
    out, refused = [], None
    try:
        text = decode(content)
    except FormatError:
        return out
    for name, check in (("json", lambda: is_json(text, limits) or _no()), ("xml", lambda: parse_xml(content, limits)), ("csv", lambda: detect_delimiter(text, limits)[0] or _no())):
        try:
            check()
            out.append(name)
        except FormatError as e:
            refused = refused or (e if e.limit else None)
    return sorted(out) if out or not refused else refused


def _no():
    raise FormatError("not of this format")
