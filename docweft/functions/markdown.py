"""Reshaping Markdown contents for readers. Plain Python."""

from __future__ import annotations

import re

_PARTS = re.compile(r"(?P<fence>(?m:^)(?:```|~~~)[\s\S]*?(?:(?m:^)(?:```|~~~)[^\n]*|\Z))|(?P<code>(`+)(?:(?!\3)[\s\S])+?\3)|(?P<link>(?<!!)\[(?P<label>(?:[^\[\]]|\[\[[^\[\]]*\]\])*)\]\((?P<to>[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)\))")
_ASIDE = re.compile(r"^> ?\**(note|example|warning|issue)\b", re.I)


def transform_content(text: str | None, links: str = "full", asides: bool = True) -> str | None:
    """Contents with links whole (full), cut to ``#anchor`` (short) or to their label (none), and with or without quoted
    notes, examples, warnings and issues. Code is not touched."""
    if text is None or (links == "full" and asides):
        return text
    if not asides:
        kept: list[str] = []
        skip = fence = False
        for line in text.split("\n"):
            if re.match(r"(```|~~~)", line):
                fence = not fence
            if not fence and line.startswith(">"):
                skip = skip or bool(_ASIDE.match(line))
            else:
                skip = False
            if not skip:
                kept.append(line)
        text = re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n")
    if links == "full":
        return text

    def one(m: re.Match) -> str:
        if not m.group("link"):
            return m.group(0)
        if links == "none" or "#" not in m.group("to"):
            return m.group("label")
        return f"[{m.group('label')}](#{m.group('to').split('#', 1)[1]})"

    return _PARTS.sub(one, text)
