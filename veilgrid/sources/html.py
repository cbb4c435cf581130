"""Pages from HTML: elements, form fields, visible text and hints, without a layout.

One pass of a tolerant parser builds a light tree for a page; everything is read off it.  Visibility comes from the
markup alone (``hidden``, ``aria-hidden``, inline styles); boxes are inputs of later steps, never guessed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math".split())
BLOCK = frozenset("div p h1 h2 h3 h4 h5 h6 li tr section article header footer nav main aside blockquote figure figcaption".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
ROLES = {
    "button": "button", "menuitem": "button", "tab": "button", "switch": "button", "link": "link", "textbox": "input", "combobox": "input",
    "checkbox": "check", "radio": "check", "slider": "check",
}
UNFIELDED = frozenset(("hidden", "submit", "button", "reset", "image"))
VALUED = frozenset(("text", "password", "email", "tel", "url", "search", "number"))

_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0*)?\s*(?:;|$)", re.I)


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def nodes(self) -> Iterator[Node]:
        """The node and all below it in the order of the text."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo += reversed(n.children)
        return "".join(out).strip()

    def up(self) -> Iterator[Node]:
        n = self
        while n is not None:
            yield n
            n = n.parent

    def hides(self) -> bool:
        return "hidden" in self.attrs or self.attrs.get("aria-hidden") == "true" or bool(_HIDING.search(self.attrs.get("style", "")))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES and self.at.tag in CLOSES[tag]:
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for n in self.at.up():
            if n.tag == tag:
                self.at = n.parent or self.root
                return

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


_REFERENCE = re.compile(r"&(?!amp)(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*)(;?)")


def ended_references(html: str) -> str:
    """The markup in which references without their semicolon are plain text, but for the ampersand's; browsers read some of them."""
    return _REFERENCE.sub(lambda m: m[0] if m[2] and (m[1][0] == "#" or m[1] + ";" in html5) else "&amp;" + m[0][1:], html)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def selector(node: Node) -> str:
    """A path of tags, each with its place among its kind and two classes at most, from the nearest id on."""
    parts: list[str] = []
    for n in node.up():
        if n.tag in ("body", "html", "#root"):
            break
        if n.attrs.get("id"):
            parts.append("#" + n.attrs["id"])
            break
        part = n.tag
        alike = [c for c in n.parent.children if isinstance(c, Node) and c.tag == n.tag] if n.parent else []
        if len(alike) > 1:
            part += f":nth-of-type({1 + next(i for i, c in enumerate(alike) if c is n)})"
        parts.append(part + "".join("." + c for c in n.attrs.get("class", "").split()[:2]))
    return " > ".join(reversed(parts))


def visible_text(body: Node) -> str:
    """Text with a newline at blocks and breaks and a tab at cells, runs of blanks and blank lines reduced."""
    out: list[str] = []
    blocks = 0
    todo: list[Node | str] = [*reversed(body.children)]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            if t := n.strip():
                out.append(t)
            continue
        if n.tag in SILENT or n.hides():
            continue
        if n.tag == "br":
            out.append("\n")
        elif n.tag in BLOCK:
            if blocks:
                out.append("\n")
            blocks += 1
        elif n.tag in ("td", "th"):
            out.append("\t")
        elif n.attrs.get("role") in ("button", "link", "menuitem") and n.attrs.get("aria-label"):
            out.append(n.attrs["aria-label"])
        todo += reversed(n.children)
    text = re.sub(r"(\n\s*){3,}", "\n\n", " ".join(out))
    return re.sub(r"[ \t]{2,}", " ", text).strip()


def _selected(node: Node) -> str:
    options = [n for n in node.nodes() if n.tag == "option"]
    chosen = next((o for o in options if "selected" in o.attrs), options[0] if options else None)
    return chosen.text() if chosen else ""


def element_text(node: Node) -> str:
    a = node.attrs
    if node.tag == "input":
        return a.get("value") or a.get("placeholder") or a.get("aria-label") or ""
    if node.tag == "select":
        return _selected(node)
    if node.tag == "textarea":
        return node.text() or a.get("placeholder", "")
    if node.tag in ("button", "a"):
        return node.text() or (a.get("title", "") if node.tag == "a" else "") or a.get("aria-label", "")
    return node.text()


def field_label(node: Node, page: Node) -> str | None:
    """What names a field: a label for its id, a label around or beside it up to five levels up, ARIA, placeholder, title."""
    a = node.attrs
    everything = list(page.nodes())
    if a.get("id"):
        for n in everything:
            if n.tag == "label" and n.attrs.get("for") == a["id"]:
                return n.text() or None
    for depth, n in enumerate(node.up()):
        if depth == 0 or n.tag == "#root":
            continue
        if depth > 5:
            break
        inner = n if n.tag == "label" else next((c for c in n.nodes() if c.tag == "label"), None)
        if inner is not None:
            return inner.text() or None
    if a.get("aria-label"):
        return a["aria-label"]
    if a.get("aria-labelledby"):
        named = next((n for n in everything if n.attrs.get("id") == a["aria-labelledby"]), None)
        if named is not None:
            return named.text() or None
    return a.get("placeholder") or a.get("title") or None


def elements_of(page: Node) -> list[dict]:
    """Interactive elements in order."""
    out = []
    for n in page.nodes():
        a, role = n.attrs, n.attrs.get("role", "")
        if n.tag not in ("a", "button", "input", "select", "textarea") and role not in ROLES and "tabindex" not in a:
            continue
        if n.tag in SILENT or any("hidden" in p.attrs for p in n.up()):
            continue
        kind = value = None
        is_input, is_button, is_link = n.tag in ("input", "select", "textarea"), n.tag == "button", n.tag == "a"
        input_type = (a.get("type") or "text").lower() if n.tag == "input" else None
        if n.tag == "input":
            kind = "input"
            value = a.get("value") if input_type in VALUED else ("true" if "checked" in a else "false") if input_type in ("checkbox", "radio") else None
        elif n.tag in ("button", "select", "textarea"):
            kind, value = n.tag, _selected(n) if n.tag == "select" else n.text() if n.tag == "textarea" else None
        elif n.tag == "a":
            kind, value = "anchor", a.get("href")
        elif role in ROLES:
            part = ROLES[role]
            kind = f"role-{role}" if part == "check" else f"role-{part}"
            is_input, is_button, is_link = part in ("input", "check"), part == "button", part == "link"
        placeholder = a.get("placeholder") if n.tag in ("input", "textarea") else a.get("aria-placeholder") if kind == "role-input" else None
        out.append({
            "idx": len(out), "tag_name": n.tag, "text": element_text(n), "type": kind, "name": a.get("name") or None if n.tag in ("input", "button", "select", "textarea") else None, "placeholder": placeholder or None,
            "value": value or None, "id": a.get("id") or None, "class_name": a.get("class", "").strip() or None, "selector": selector(n), "is_visible": not any(p.hides() for p in n.up()),
            "is_input": is_input, "is_button": is_button, "is_link": is_link, "autocomplete": a.get("autocomplete") or None if n.tag == "input" else None, "aria_label": a.get("aria-label") or None, "input_type": input_type,
        })
    return out


def fields_of(page: Node) -> list[dict]:
    """Form fields in order; values of passwords are left out."""
    out = []
    for n in page.nodes():
        if n.tag not in ("input", "select", "textarea"):
            continue
        a = n.attrs
        kind = (a.get("type") or "text").lower() if n.tag == "input" else n.tag
        if kind in UNFIELDED or any("hidden" in p.attrs for p in n.up()):
            continue
        value = "" if kind == "password" else a.get("value", "") if n.tag == "input" else _selected(n) if n.tag == "select" else n.text()
        out.append({
            "idx": len(out), "selector": selector(n), "name": a.get("name", ""), "type": kind, "placeholder": "" if n.tag == "select" else a.get("placeholder", ""), "value": value, "label": field_label(n, page),
            "autocomplete": a.get("autocomplete") or None, "is_password": kind == "password", "required": "required" in a or a.get("aria-required") == "true",
        })
    return out


_ELEMENT = "idx int, tag_name string, text string, type string, name string, placeholder string, value string, id string, class_name string, selector string, is_visible boolean, is_input boolean, is_button boolean, is_link boolean, autocomplete string, aria_label string, input_type string"
_FIELD = "idx int, selector string, name string, type string, placeholder string, value string, label string, autocomplete string, is_password boolean, required boolean"


def _struct(ddl: str) -> tuple[str, pa.DataType]:
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names = [x.split() for x in ddl.split(", ")]
    return "struct<" + ",".join(f"{n}:{t}" for n, t in names) + ">", pa.struct([(n, kinds[t]) for n, t in names])


def page_context(page: Node) -> dict:
    body = next((n for n in page.nodes() if n.tag == "body"), page)
    title = next((n.text() for n in page.nodes() if n.tag == "title"), "")
    fields = fields_of(page)
    hints = " ".join(f"{f['placeholder']} {f['label'] or ''} {f['name']} {f['autocomplete'] or ''}" for f in fields)
    return {"title": title, "visible_text": visible_text(body), "form_hints": hints, "elements": elements_of(page), "form_fields": fields}


def extract_pages(pages: DataFrame, ended: bool = False) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, title, visible_text, form_hints, elements, form_fields)``; null html is an empty page.

    ended: references are read as ``ended_references`` has them, otherwise as browsers do.
    """
    (es, ea), (fs, fa) = _struct(_ELEMENT), _struct(_FIELD)
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("visible_text", pa.string()), ("form_hints", pa.string()), ("elements", pa.list_(ea)), ("form_fields", pa.list_(fa))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"page_id": i, "url": u} | page_context(parse(ended_references(h) if ended and h else h)) for i, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(run, f"page_id long, url string, title string, visible_text string, form_hints string, elements array<{es}>, form_fields array<{fs}>")


def elements_frame(pages: DataFrame) -> DataFrame:
    """One row for each element of extracted pages."""
    return pages.select("page_id", F.explode("elements").alias("e")).select("page_id", "e.*")


def fields_frame(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode("form_fields").alias("f")).select("page_id", "f.*")
