"""Pages of linked documents in HTML to sections, references and definitions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, elements whose text is raw, and what each start tag closes. Fixed values of HTML.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_STOPS = {"li": {"ol", "ul"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                todo.extend(reversed(n.children))
        return "".join(out)

    def up(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def has_class(self, *names: str) -> bool:
        return bool(set(self.attrs.get("class", "").split()) & set(names))


class _Tree(HTMLParser):
    """Closes what the rules of HTML close: paragraphs at blocks, items at items, cells at cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK and self._inside("p", {"button", "table", "li", "td"}):
            self._close("p")
        if tag in _CLOSES:
            n = self.at
            while n.parent is not None and n.tag not in _STOPS.get(tag, set()):
                if n.tag in _CLOSES[tag]:
                    self.at = n.parent
                    if n.tag == tag or tag in ("dt", "dd"):
                        break
                n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        if self._inside(tag, set()):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def _inside(self, tag: str, stop: set[str]) -> bool:
        n: Node | None = self.at
        while n is not None and n.tag not in stop:
            if n.tag == tag:
                return True
            n = n.parent
        return False

    def _close(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        self.at = n.parent or self.root


def parse(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def _squeeze(text: str) -> str:
    return " ".join(text.split())


# ---- Markdown ------------------------------------------------------------------------------------------------------


def _inline(n: Node | str) -> str:
    if isinstance(n, str):
        return re.sub(r"\s+", " ", n)
    if n.tag in ("script", "style"):
        return ""
    inner = "".join(_inline(c) for c in n.children if not (isinstance(c, Node) and c.tag in ("ol", "ul", "dl", "table", "pre", "blockquote")))
    if n.tag in ("code", "kbd", "samp"):
        return f"`{_squeeze(inner)}`" if inner.strip() else ""
    if n.tag in ("strong", "b"):
        return f"**{inner.strip()}**" if inner.strip() else ""
    if n.tag in ("em", "i", "var"):
        return f"*{inner.strip()}*" if inner.strip() else ""
    if n.tag == "a" and n.attrs.get("href"):
        return f"[{inner.strip()}]({n.attrs['href']})"
    if n.tag == "br":
        return "\n"
    if n.tag == "img":
        return n.attrs.get("alt", "")
    return inner


def markdown(n: Node, depth: int = 0) -> str:
    """Block content as Markdown; nested lists are indented by four blanks a level."""
    out: list[str] = []
    pending: list[Node | str] = []

    def flush() -> None:
        line = "".join(map(_inline, pending)).strip()
        if line:
            out.append(re.sub(r" *\n *", "\n", line))
        pending.clear()

    for c in n.children:
        if isinstance(c, str) or c.tag not in _BLOCK | {"ol", "ul", "dl", "table", "li", "emu-alg", "emu-note"}:
            pending.append(c)
            continue
        flush()
        if c.tag in ("ol", "ul"):
            start = int(c.attrs["start"]) if c.attrs.get("start", "").isdigit() else 1
            items = [x for x in c.children if isinstance(x, Node) and x.tag == "li"]
            lines = []
            for i, li in enumerate(items):
                body = markdown(li, depth + 1)
                head = f"{start + i}. " if c.tag == "ol" else "- "
                lines.append(head + body.replace("\n\n", "\n").replace("\n", "\n    "))
            out.append("\n".join(lines))
        elif c.tag == "pre":
            kind = "idl" if c.has_class("idl") else ""
            out.append(f"```{kind}\n" + c.text().strip("\n") + "\n```")
        elif re.fullmatch("h[1-6]", c.tag):
            out.append("#" * int(c.tag[1]) + " " + _squeeze("".join(map(_inline, c.children))))
        elif c.tag == "blockquote" or c.has_class("note", "example", "warning", "issue"):
            label = next((x for x in ("note", "example", "warning", "issue") if c.has_class(x)), "")
            body = markdown(c, depth)
            body = f"**{label.capitalize()}:** {body}" if label and not body.lower().startswith(label) else body
            out.append("\n".join("> " + x if x else ">" for x in body.split("\n")))
        elif c.tag == "table":
            rows = [[_squeeze("".join(map(_inline, d.children))) for d in r.children if isinstance(d, Node) and d.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                wide = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
                out.append("\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]]))
        elif c.tag == "dl":
            for d in c.children:
                if isinstance(d, Node) and d.tag in ("dt", "dd"):
                    out.append(("**" + _squeeze(_inline(d)) + "**") if d.tag == "dt" else markdown(d, depth))
        else:
            inner = markdown(c, depth)
            if inner:
                out.append(inner)
    flush()
    return "\n\n".join(out)


# ---- extraction ----------------------------------------------------------------------------------------------------


def _heading_id(h: Node) -> str:
    if h.attrs.get("id"):
        return h.attrs["id"]
    p = h.parent
    if p is not None and p.attrs.get("id") and next((c for c in p.children if isinstance(c, Node)), None) is h:
        return p.attrs["id"]
    return ""


def _steps_after(dfn: Node) -> Node | None:
    """The ordered list that a definition introduces: the next element after it in its container, or after its
    paragraph there."""
    branch: Node = dfn
    for box in dfn.up():
        if box.tag in ("pre", "table", "nav"):
            return None
        at = next(i for i, c in enumerate(box.children) if c is branch)
        nxt = next((c for c in box.children[at + 1 :] if isinstance(c, Node) and c.tag in _BLOCK), None)
        if nxt is not None and nxt.tag == "ol":
            return nxt
        if box.tag in _BLOCK - {"p"} | {"dd", "dt", "li", "emu-clause"}:
            return None
        branch = box
    return None


def _item_path(a: Node) -> tuple[list[str], list[Node]]:
    """Numbers of the ordered items around a node, from outside, and those items."""
    items = [n for n in a.up() if n.tag == "li" and n.parent is not None and n.parent.tag == "ol"][::-1]
    out = []
    for li in items:
        start = int(li.parent.attrs["start"]) if li.parent.attrs.get("start", "").isdigit() else 1
        out.append(str(start + [c for c in li.parent.children if isinstance(c, Node) and c.tag == "li"].index(li)))
    return out, items


def _own_text(li: Node) -> str:
    return _squeeze("".join(_inline(c) for c in li.children if isinstance(c, str) or c.tag not in ("ol", "ul", "dl")))


def extract(html: str, spec: str, base_url: str, bases: dict[str, str]) -> dict[str, list[dict]]:
    """sections, refs and idl_defs of one page. ``bases`` maps addresses (without scheme, outer slash) to spec names.

    Of sections with equal anchors the first stands. A heading hangs below the nearest earlier heading of smaller depth,
    anything else below the nearest earlier heading; neighbours share parent and depth.
    """
    root = parse(html)
    sections: list[dict] = []
    bodies: dict[str, Node] = {}
    seen: set[str] = set()
    scope: dict[int, str] = {}
    at = ""

    def add(anchor: str, title: str, kind: str, depth: int | None = None, number: str | None = None, content: str | None = None) -> None:
        nonlocal at
        if anchor in seen:
            return
        seen.add(anchor)
        sections.append({"anchor": anchor, "title": title or None, "section_type": kind, "depth": depth, "number": number, "content_text": content, "ord": len(sections)})

    for n in root.walk():
        scope[id(n)] = at
        if re.fullmatch("h[2-6]", n.tag) and (anchor := _heading_id(n)):
            number = next((_squeeze(x.text()).rstrip(".") for x in n.walk() if x.tag == "span" and x.has_class("secno", "secnum")), None)
            title = _squeeze("".join(x if isinstance(x, str) else "" if x.has_class("secno", "secnum", "self-link") else x.text() for x in n.children))
            body = Node("div")
            if n.parent is not None:
                for c in n.parent.children[n.parent.children.index(n) + 1 :]:
                    if isinstance(c, Node) and (re.fullmatch("h[1-6]", c.tag) or any(re.fullmatch("h[2-6]", x.tag) for x in c.walk())):
                        break
                    body.children.append(c)
            add(anchor, title, "heading", int(n.tag[1]), number, markdown(body) or None)
            at = anchor
        elif n.tag == "emu-clause" and n.attrs.get("id"):
            head = next((c for c in n.children if isinstance(c, Node) and c.tag == "h1"), None)
            title = "" if head is None else _squeeze("".join(x if isinstance(x, str) else "" if x.has_class("secnum", "secno") else x.text() for x in head.children))
            number = None if head is None else next((_squeeze(x.text()) for x in head.walk() if x.tag == "span" and x.has_class("secnum", "secno")), None)
            body = Node("div")
            body.children = [c for c in n.children if not (isinstance(c, Node) and c.tag in ("h1", "emu-clause"))]
            depth = min(6, 2 + sum(x.tag == "emu-clause" for x in n.up()))
            steps = next((x for c in body.children if isinstance(c, Node) for x in c.walk() if x.tag == "emu-alg"), None)
            add(n.attrs["id"], title, "algorithm" if steps is not None else "heading", depth, number, markdown(body) or None)
            at = n.attrs["id"]
            if steps is not None:
                bodies[at] = steps
        elif n.tag == "dfn" and n.attrs.get("id"):
            steps = _steps_after(n)
            marked = any("data-algorithm" in x.attrs or x.has_class("algorithm") for x in n.up()) or n.attrs.get("data-dfn-type") == "abstract-op"
            kind = "algorithm" if steps is not None or marked else "idl" if n.attrs.get("data-dfn-type") in ("interface", "attribute", "method", "dictionary", "enum", "callback") else "definition"
            box = next((x for x in n.up() if x.tag in ("p", "dd", "dt", "div", "section", "li", "pre")), None)
            holder = Node("div")
            if box is not None:
                holder.children.append(box)
            text = markdown(holder)
            if steps is not None and box is not None and steps.parent is not box:
                holder = Node("div")
                holder.children.append(steps)
                text = (text + "\n\n" + markdown(holder)).strip()
            add(n.attrs["id"], _squeeze(n.text()), kind, content=text or None)
            if steps is not None:
                bodies[n.attrs["id"]] = steps
        elif n.tag == "pre" and n.has_class("idl") and n.attrs.get("id"):
            add(n.attrs["id"], "", "idl", content="```idl\n" + n.text().strip("\n") + "\n```")

    last_at: dict[int, str] = {}
    for s in sections:
        d = s["depth"] if s["depth"] else 7
        above = [k for k in last_at if k < d]
        s["parent_anchor"] = last_at[max(above)] if above else None
        if s["depth"]:
            last_at = {k: v for k, v in last_at.items() if k < d} | {d: s["anchor"]}
    near: dict[tuple, dict] = {}
    for s in sections:
        s["prev_anchor"] = s["next_anchor"] = None
        k = (s["parent_anchor"], s["depth"])
        if k in near:
            s["prev_anchor"], near[k]["next_anchor"] = near[k]["anchor"], s["anchor"]
        near[k] = s

    owner_of = {id(x): anchor for anchor, steps in bodies.items() for x in steps.walk()}
    refs: list[dict] = []
    keys: set[tuple] = set()
    order: dict[str, int] = {}
    for n in root.walk():
        href = n.attrs.get("href", "")
        if n.tag not in ("a", "emu-xref") or "#" not in href or any(x.has_class("self-link", "toc", "index") or x.tag == "nav" for x in (n, *n.up())):
            continue
        page, _, fragment = href.partition("#")
        key = re.sub(r"^[a-z]+://", "", page).rstrip("/")
        to_spec = spec if not page or key == re.sub(r"^[a-z]+://", "", base_url).rstrip("/") else bases.get(key) or bases.get(key.rpartition("/")[0])
        own = next((x.attrs["id"] for x in (n, *n.up()) if x.tag == "dfn" and x.attrs.get("id")), None)
        home = own or owner_of.get(id(n)) or scope[id(n)]
        fragment = unquote(fragment)
        if not to_spec or not fragment or not home or (to_spec == spec and fragment == home) or fragment.startswith("biblio-"):
            continue
        path, items = _item_path(n)
        in_note = any(x.has_class("note", "example", "warning", "issue") or x.tag == "blockquote" for x in n.up())
        in_idl = any(x.tag == "pre" and x.has_class("idl") for x in n.up())
        kind = "note" if in_note else "idl" if in_idl else "step" if path else "prose"
        step_path = ".".join(path) or None
        call = n.attrs.get("id") or None
        k = (home, to_spec, fragment, step_path, call)
        if k in keys:
            continue
        keys.add(k)
        refs.append({"from_anchor": home, "to_spec": to_spec, "to_anchor": fragment, "step_path": step_path, "step_text": _own_text(items[-1]) if items else None, "guard_path": [_own_text(x) for x in items[:-1]] or None, "call_site_id": call, "kind": kind, "ord": order.setdefault(home, 0)})
        order[home] += 1

    idl: list[dict] = []
    named: set[tuple] = set()
    for n in root.walk():
        kind = n.attrs.get("data-dfn-type", "")
        if n.tag != "dfn" or not n.attrs.get("id") or not kind or kind == "argument" or (n.attrs["id"], kind) in named:
            continue
        named.add((n.attrs["id"], kind))
        name = _squeeze(n.attrs.get("data-lt", "").split("|")[0] or n.text())
        base = name.split("(")[0] if kind in ("method", "constructor") else name
        owner = n.attrs.get("data-dfn-for", "").split("/")[0].split(",")[0].strip() or None
        block = next((x for x in n.up() if x.tag == "pre" and x.has_class("idl")), None)
        idl.append({"anchor": n.attrs["id"], "name": base, "owner": owner, "kind": kind, "canonical_name": f"{owner}.{base}" if owner else base, "idl_text": block.text().strip() if block else None, "ord": len(idl)})
    return {"section": sections, "ref": refs, "idl": idl}


_FIELDS = {
    "item": "string", "ord": "int", "anchor": "string", "title": "string", "content_text": "string", "section_type": "string", "parent_anchor": "string", "prev_anchor": "string", "next_anchor": "string", "depth": "int", "number": "string",
    "from_anchor": "string", "to_spec": "string", "to_anchor": "string", "step_path": "string", "step_text": "string", "guard_path": "array<string>", "call_site_id": "string", "kind": "string", "name": "string", "owner": "string", "canonical_name": "string", "idl_text": "string",
}


def extract_pages(pages: DataFrame, specs: dict[str, str]) -> DataFrame:
    """Sections, references and definitions of pages (spec, base_url, html) as rows tagged by ``item``: section, ref, idl.

    ``specs`` maps base addresses to names and goes to each task. Null pages give nothing. One pass, no shuffle; write it
    partitioned by item, or filter it with ``items``.
    """
    bases = {re.sub(r"^[a-z]+://", "", k).rstrip("/"): v for k, v in specs.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for spec, base, html in zip(pdf["spec"], pdf["base_url"], pdf["html"]):
                for item, found in extract(html, spec, base or "", bases).items():
                    rows += [{"spec": spec, "item": item} | r for r in found]
            out = pd.DataFrame(rows, columns=["spec", *_FIELDS], dtype=object)
            out = out.where(out.notna(), None)
            for c in ("ord", "depth"):
                out[c] = out[c].astype("Int32")
            yield out

    return pages.filter("html is not null").select("spec", "base_url", "html").mapInPandas(run, "spec string, " + ", ".join(f"{k} {v}" for k, v in _FIELDS.items()))


_OF = {
    "section": ["spec", "anchor", "title", "content_text", "section_type", "parent_anchor", "prev_anchor", "next_anchor", "depth", "number", "ord"],
    "ref": ["spec", "from_anchor", "to_spec", "to_anchor", "step_path", "step_text", "guard_path", "call_site_id", "kind", "ord"],
    "idl": ["spec", "anchor", "name", "owner", "kind", "canonical_name", "idl_text", "ord"],
}


def items(extracted: DataFrame, item: str) -> DataFrame:
    """One kind of extracted rows with its own columns."""
    return extracted.filter(F.col("item") == item).select(*_OF[item])


def merge_pages(rows: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """Rows of a document in several pages: of equal keys the first by page and order stands."""
    from docweft.operators.corpus import first_rows

    return first_rows(rows, keys, [page, "ord"])
