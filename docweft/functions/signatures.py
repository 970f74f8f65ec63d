"""Signatures of algorithms and the arguments of their calls. Plain Python, per text."""

from __future__ import annotations

import re

from docweft.functions.steps import _ITEM, _LINK

_PARAM = re.compile(r"(?P<optional>\ban? optional\b|\boptionally\b)?[^*,]*?(?<![*\w])\*(?P<name>[A-Za-z][\w-]*)\*(?:\s*\(default(?:ing)?(?: is| to)?\s*(?P<default>[^()]+)\))?")
_LEAD = re.compile(r"(?i)\b(?:given|with|taking)\b(?!\s+(?:the|a|an)\s+(?:following|same)\b)")
_END = re.compile(r":\s*$|[.;](?:\s|$)|,\s*(?:run|perform|return|then|do)\b|\bto be\b")


def signature(text: str | None) -> list[dict]:
    """Parameters (name, optional, default) that the words before the first step declare: ``To x, given *a* and an
    optional *b* (default null):``. No such words give no parameters."""
    intro = []
    for line in (text or "").split("\n"):
        if _ITEM.match(line):
            break
        intro.append(line)
    for para in reversed(re.split(r"\n\s*\n", "\n".join(intro).strip())):
        words = " ".join(para.split())
        lead = _LEAD.search(words)
        if not lead or not re.match(r"(?i)(?:to\b|the\b.*\b(?:steps|algorithm)\b|when\b)", words):
            continue
        rest = words[lead.end() :]
        end = _END.search(rest)
        rest = rest[: end.start()] if end else rest
        out, late = [], False
        for m in _PARAM.finditer(rest):
            late = late or bool(m.group("optional"))
            out.append({"name": m.group("name"), "optional": late or m.group("default") is not None, "default": m.group("default")})
        return out
    return []


def _top_level(text: str) -> list[str]:
    """A list cut at its commas and its last "and", not inside brackets or quotes."""
    parts, depth, last, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c in "([{«":
            depth += 1
        elif c in ")]}»":
            depth -= 1
        elif c in "\"`":
            j = text.find(c, i + 1)
            i = j if j > 0 else i
        elif depth <= 0 and (m := re.compile(r",\s*(?:and\s+)?|\s+and\s+").match(text, i)):
            parts.append(text[last:i])
            last = i = m.end()
            continue
        i += 1
    parts.append(text[last:])
    return [p.strip() for p in parts if p.strip()]


def arguments(text: str, anchor: str) -> tuple[list[str], dict[str, str]] | None:
    """Positional and named arguments of the call that a step's link to ``anchor`` makes; None without such a link.

    Positional ones follow ``given`` or ``with``; ``*name* set to value`` and ``*name* being value`` are named.
    """
    link = next((m for m in _LINK.finditer(text) if m.group(2).partition("#")[2] == anchor), None)
    if link is None:
        return None
    rest = text[link.end() :]
    lead = re.match(r"\s*,?\s*(?:given|with|passing|on|for)\b", rest)
    if not lead:
        return [], {}
    rest = rest[lead.end() :]
    stop = re.search(r"[.;:](?:\s|$)|,\s*(?:then|if|and then|otherwise)\b", rest)
    rest = rest[: stop.start()] if stop else rest
    positional, named = [], {}
    for part in _top_level(rest):
        part = re.sub(r"^(?:given|with)\s+", "", part)
        m = re.fullmatch(r"\*([A-Za-z][\w-]*)\*\s+(?:set to|being|as)\s+(.+)", part)
        if m:
            named[m.group(1)] = m.group(2)
        else:
            positional.append(part)
    return positional, named


def bind(params: list[dict], positional: list[str], named: dict[str, str]) -> tuple[list[tuple[str, str | None, str]], str, list[str]]:
    """((parameter, value, via), ...), confidence and issues of a call.

    via: named, positional, default or missing. Confidence: exact (all bound, no issue), partial, or unbound (nothing
    could be bound though something should). Issues: unknown_parameter, surplus_argument, missing_argument.
    """
    issues: list[str] = []
    names = [p["name"] for p in params]
    issues += ["unknown_parameter"] * any(n not in names for n in named)
    left = list(positional)
    out: list[tuple[str, str | None, str]] = []
    for p in params:
        if p["name"] in named:
            out.append((p["name"], named[p["name"]], "named"))
        elif left:
            out.append((p["name"], left.pop(0), "positional"))
        elif p["optional"]:
            out.append((p["name"], p["default"], "default"))
        else:
            out.append((p["name"], None, "missing"))
    issues += ["surplus_argument"] * bool(left) + ["missing_argument"] * any(v == "missing" for _, _, v in out)
    got = sum(v in ("named", "positional") for _, _, v in out)
    confidence = "exact" if not issues else "partial" if got else "unbound"
    return out, confidence, issues
