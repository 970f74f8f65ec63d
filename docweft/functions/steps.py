"""Numbered steps of an algorithm's Markdown text, their control flow and their variables. Plain Python, per text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_ITEM = re.compile(r"^([ \t]*)(\d{1,9})[.)]([ \t]+|$)(.*)$")
_BULLET = re.compile(r"^([ \t]*)[-*+][ \t]+")
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})")
_LINK = re.compile(r"\[((?:[^\[\]]|\[\[[^\[\]]*\]\]|\[[^\[\]]*\])*)\]\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)*)\)")


@dataclass
class Step:
    path: str
    parent: int  # place of the parent in the list, -1 at the top
    text: str = ""  # Markdown
    children: list[int] = field(default_factory=list)


def _width(blank: str) -> int:
    return len(blank.expandtabs(4))


def parse_steps(markdown: str | None) -> list[Step]:
    """The steps of the first ordered list, in document order.

    A step is numbered by the first number of its list and its place in it. Deeper numbered lines are its children;
    only its first nested list counts. Further lines belong to its text; block quotes, fenced code and unordered lists
    inside it do not.
    """
    steps: list[Step] = []
    stack: list[tuple[int, int, int]] = []  # indent, first number, step
    counts: dict[int, int] = {}  # children numbered so far, by parent
    closed: set[int] = set()  # parents whose first list has ended
    mute: int | None = None  # indent of a bullet or quote whose lines are skipped
    fence = ""
    blank = False
    for line in (markdown or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        m = _FENCE.match(line)
        if fence:
            if m and m.group(1).startswith(fence):
                fence = ""
            continue
        if m:
            fence = m.group(1)
            continue
        if not line.strip():
            blank = True
            continue
        indent = _width(line[: len(line) - len(line.lstrip())])
        item = _ITEM.match(line)
        if item and (mute is None or indent <= mute):
            mute = None
            while stack and indent < stack[-1][0]:
                stack.pop()
            if stack and indent >= stack[-1][0] + 2:
                parent = stack[-1][2]
                if parent in closed and steps[parent].children:
                    mute = indent  # a second nested list
                    continue
                first = int(item.group(2))
            elif stack:
                parent, first = steps[stack[-1][2]].parent, stack[-1][1]
                stack.pop()
            else:
                if steps:
                    return steps
                parent, first = -1, int(item.group(2))
            nth = counts.get(parent, 0)
            counts[parent] = nth + 1
            path = f"{steps[parent].path}.{first + nth}" if parent >= 0 else str(first + nth)
            steps.append(Step(path, parent, item.group(4).strip()))
            if parent >= 0:
                steps[parent].children.append(len(steps) - 1)
            stack.append((indent, first, len(steps) - 1))
        elif not steps:
            continue
        elif indent < (stack[0][0] + 1 if stack else 1) and (blank or line.lstrip()[:1] in "#|"):
            return steps
        elif mute is not None and indent > mute:
            pass
        elif _BULLET.match(line) or line.lstrip().startswith(">"):
            mute = indent
            for _, _, at in stack:
                if steps[at].children:
                    closed.add(at)
        elif blank and mute is not None:
            mute = None
        elif mute is None:
            while len(stack) > 1 and blank and indent < stack[-1][0] + 1:
                closed.add(stack[-2][2])
                stack.pop()
            at = stack[-1][2]
            steps[at].text += " " + line.strip()
        blank = False
    return steps


def plain(markdown: str) -> str:
    """Inline Markdown as text, blanks folded."""
    t = _LINK.sub(r"\1", markdown)
    t = re.sub(r"`+([^`]*)`+", r"\1", t)
    t = re.sub(r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"\1", t)
    t = re.sub(r"(?<!\w)([*_])(?=[^\s*_])(.*?)(?<=[^\s*_])\1(?!\w)", r"\2", t)
    return " ".join(t.split())


def shorten(text: str, n: int = 120) -> str:
    return text[:n] + "…" if len(text) > n else text


# ---- control flow --------------------------------------------------------------------------------------------------

#: Step shapes in the order in which they are tried, one pattern each, in any case. Fixed values.
SHAPES = [
    ("jump", r"^jump\s+to\s+step\s+(\d+(?:\.\d+)*)"),
    ("jump", r"^return\s+to\s+step\s+(\d+(?:\.\d+)*)"),
    ("abort", r"^abort\s+(?:these\s+steps|this\s+algorithm)\b"),
    ("return", r"^return\b"),
    ("otherwise", r"^otherwise\b"),
    ("loop", r"^for\s+each\b"),
    ("loop", r"^while\b"),
    ("parallel", r"^in\s+parallel[,\s]"),
    ("parallel", r"\bin\s+parallel\b"),
    ("if_block", r"^if\b"),
    ("if_inline", r"^if\b.*,\s*then\b"),
    ("unrecognised", r"^(?:continue|break|switch\s+on)\b"),
]
_SHAPES = [(k, re.compile(p, re.I)) for k, p in SHAPES]
#: The kind of node each shape makes.
NODE_KIND = {"abort": "terminal", "return": "terminal", "otherwise": "branch", "if_block": "branch", "if_inline": "branch", "loop": "loop", "parallel": "parallel"}
_BRANCHES = ("if_block", "if_inline", "otherwise")


def shape(text: str, has_children: bool) -> str:
    for kind, pattern in _SHAPES:
        if kind == "if_block" and not has_children:
            continue
        if pattern.search(text):
            return kind
    return "plain"


def flow(markdown: str | None, calls: dict[str, list[str]] | None = None) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Nodes (id, kind, text), edges (from, to, kind) and issues (step, code) of an algorithm.

    Each step goes on to its next sibling or, at the end of its list, to where its parent goes on; the last step of a
    loop goes back to the loop, steps in parallel end there. ``calls`` maps step paths to called sections.
    """
    steps = parse_steps(markdown)
    texts = [shorten(plain(s.text)) for s in steps]
    shapes = [shape(t, bool(s.children)) for s, t in zip(steps, texts)]
    ids = {s.path for s in steps}
    follow: list[tuple[str, str] | None] = [None] * len(steps)
    built = [s.parent < 0 for s in steps]
    top = [i for i, s in enumerate(steps) if s.parent < 0]
    before: list[int] = [-1] * len(steps)
    for family, head in [(top, -1), *((s.children, i) for i, s in enumerate(steps) if s.children)]:
        for a, b in zip(family, family[1:]):
            before[b] = a
        kind = shapes[head] if head >= 0 else ""
        if head >= 0:
            on = built[head] and kind in ("if_block", "otherwise", "loop", "parallel")
            for c in family:
                built[c] = on
        last = None if head < 0 or kind == "parallel" else ("loop", steps[head].path) if kind == "loop" else follow[head]
        for c, nxt in zip(family, [*family[1:], None]):
            follow[c] = ("next", steps[nxt].path) if nxt is not None else last
    nodes, edges, issues, outside = [], [], [], set()
    for i, s in enumerate(steps):
        if not built[i]:
            continue
        kind, me, go = shapes[i], s.path, follow[i]
        nodes.append((me, NODE_KIND.get(kind, "step"), texts[i]))
        for to in (calls or {}).get(me, ()):
            if to not in outside:
                outside.add(to)
                nodes.append((to, "external", to))
            edges.append((me, to, "call"))
        kids = [steps[c].path for c in s.children]
        if kind == "otherwise":
            if before[i] >= 0 and shapes[before[i]] in _BRANCHES:
                edges.append((steps[before[i]].path, me, "else"))
            else:
                issues.append((me, "otherwise_without_if"))
        if kind in ("if_block", "otherwise", "loop") and kids:
            edges.append((me, kids[0], "then"))
        if kind == "parallel":
            edges += [(me, k, "then") for k in kids]
        if kind == "if_inline" and go:
            edges.append((me, go[1], "then"))
        if kind == "unrecognised":
            issues.append((me, "unrecognised_control"))
            if go:
                edges.append((me, go[1], "unknown"))
        if kind == "jump":
            label = next(m.group(1) for k, p in _SHAPES if k == "jump" and (m := p.search(texts[i])))
            if label in ids:
                edges.append((me, label, "jump"))
            else:
                issues.append((me, "unresolved_jump"))
        if go and (kind in ("plain", "loop", "parallel") or kind == "otherwise" and not kids):
            edges.append((me, go[1], go[0]))
    return nodes, edges, issues


# ---- statements ----------------------------------------------------------------------------------------------------

_VAR = re.compile(r"(?<![*\w])\*([A-Za-z][\w-]*)\*(?!\*)")
_SLOT = re.compile(r"\*([A-Za-z][\w-]*)\*(?:'s\s+|’s\s+|\.)\[\[(\w+)\]\]")
#: Statement kinds and the words they begin with, in the order in which they are tried, in any case. Fixed values.
STATEMENTS = [
    ("if", r"^if\b"),
    ("otherwise", r"^(?:otherwise|else)\b"),
    ("for_each", r"^for\s+each\b"),
    ("while", r"^(?:while\b|repeat\b|loop:)"),
    ("return", r"^return\b"),
    ("throw", r"^(?:throw|reject)\b"),
    ("abort", r"^(?:abort|terminate)\b"),
    ("jump", r"^jump\b"),
    ("continue", r"^continue\b"),
    ("break", r"^break\b"),
    ("wait", r"^wait\b"),
    ("parallel", r"^in\s+parallel\b"),
    ("steps", r"^run\s+(?:the\s+following|these)\s+steps\b"),
    ("assert", r"^assert\b"),
    ("set", r"^(?:set|unset)\b"),
    ("let", r"^let\b"),
    ("increment", r"^(?:increment|increase)\b"),
    ("decrement", r"^(?:decrement|decrease)\b"),
    ("append", r"^(?:append|prepend|add|insert|push|enqueue|extend)\b"),
    ("remove", r"^(?:remove|empty|clear|delete|dequeue|pop)\b"),
    ("call", r"^(?:run|perform|invoke|call|fire|queue|fetch|validate|resolve|dispatch)\b"),
]
_STATEMENTS = [(k, re.compile(p, re.I)) for k, p in STATEMENTS]
#: Verbs that change something; a statement of no known form that holds one may write. Fixed values.
LEXICON = ["set", "unset", "append", "prepend", "remove", "insert", "extend", "replace", "empty", "clear", "increment", "decrement", "update", "change", "reset", "enqueue", "dequeue", "add", "store", "mark", "toggle"]
_LEXICON = re.compile(rf"(?<![\w-])(?:{'|'.join(LEXICON)})(?![\w-])", re.I)
_TUPLE = re.compile(r"(?i)^let\s+(?:\(\s*)?((?:\*[A-Za-z][\w-]*\*(?:\s*,\s*(?:and\s+)?|\s+and\s+))+\*[A-Za-z][\w-]*\*)\s*\)?\s+be\b")


def opaque_reason(text: str) -> str:
    """Why a statement of no known form is opaque: it may write (a verb that changes something), it only links to other
    steps, or nothing of it is known."""
    if _LEXICON.search(plain(text)):
        return "unparsed_mutation"
    return "unparsed_link" if _LINK.search(text) else "unknown_form"


def statement(text: str) -> dict:
    """kind, action, defs, uses, writes and reads (fields as names in double brackets) and calls of one step's Markdown.

    action is the kind of what a condition leads to, else kind. An opaque statement has a reason.
    """
    text = " ".join(text.split())
    kind = next((k for k, p in _STATEMENTS if p.search(text)), "opaque")
    inner = re.sub(r"(?i)^(?:if|otherwise,? if|else,? if)\b.*?,\s*(?:then\s+)?(?=(?:set|unset|let|append|prepend|remove|return|throw|run|increment|decrement)\b)|^(?:otherwise|else),\s*(?=\w)", "", text) if kind in ("if", "otherwise") else text
    action = next((k for k, p in _STATEMENTS if p.search(inner)), kind) if inner is not text else kind
    defs: list[str] = []
    writes: list[str] = []
    several = _TUPLE.match(inner)
    m = re.match(r"(?i)(?:let)\s+\*([A-Za-z][\w-]*)\*\s+be\b", inner) or re.match(r"(?i)set\s+\*([A-Za-z][\w-]*)\*\s+to\b", inner) or re.match(r"(?i)for\s+each\s+(?:\w+\s+)?\*([A-Za-z][\w-]*)\*", inner)
    m = m or re.match(r"(?i)(?:increment|increase|decrement|decrease)\s+\*([A-Za-z][\w-]*)\*(?!['’.])", inner)
    if several:
        defs += _VAR.findall(several.group(1))
    elif m:
        defs.append(m.group(1))
    store = re.match(r"(?i)(?:set|unset|increment|increase|decrement|decrease)\s+\*([A-Za-z][\w-]*)\*(?:'s\s+|’s\s+|\.)\[\[(\w+)\]\]", inner) or re.match(r"(?i)(?:append|prepend|add|insert|push|enqueue|extend|remove|empty|clear|delete|dequeue|pop)\b.*?\*([A-Za-z][\w-]*)\*(?:'s\s+|’s\s+|\.)\[\[(\w+)\]\]", inner)
    if store:
        writes.append(store.group(2))
    slots = [f for _, f in _SLOT.findall(text)]
    reads = list(slots)
    for f in writes:
        reads.remove(f)
    used = _VAR.findall(text)
    for d in defs:  # the place that defines it is no use; counting up is one
        if d in used and not (m and action in ("increment", "decrement")):
            used.remove(d)
    calls = [u for _, u in _LINK.findall(text) if "#" in u]
    return {"kind": kind, "action": action, "reason": opaque_reason(text) if kind == "opaque" else None, "defs": defs, "uses": list(dict.fromkeys(used)), "writes": writes, "reads": list(dict.fromkeys(reads)), "calls": list(dict.fromkeys(calls))}
