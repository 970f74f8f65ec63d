"""Similarity of short texts. Plain Python."""

from __future__ import annotations

import re


def jaro_winkler(a: str, b: str, scale: float = 0.1, longest: int = 4) -> float:
    """Jaro-Winkler similarity, 0 to 1; 1 for two empty texts. Common prefixes count only above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = bytearray(len(b))
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = 1
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (c for c, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:longest], b[:longest]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * scale * (1 - jaro)


def normal_step(text: str) -> str:
    """A step's words: without Markdown signs, blanks folded, lower case, without the stops at its end."""
    t = re.sub(r"\[([^\[\]]*)\]\([^()]*\)", r"\1", text)
    t = re.sub(r"[*_`]", "", t)
    return " ".join(t.split()).lower().rstrip(".,:;!?")


def classify(comment: str, step: str, threshold: float = 0.85) -> str:
    """How a comment agrees with a step: exact, fuzzy or mismatch. An empty comment cites the number only: exact."""
    a, b = normal_step(comment), normal_step(step)
    if not a or a == b:
        return "exact"
    if not b:
        return "mismatch"
    if a in b or b in a:
        return "fuzzy"
    return "fuzzy" if jaro_winkler(a, b) >= threshold else "mismatch"


def longest_increasing(xs: list) -> int:
    """The length of a longest strictly increasing subsequence."""
    from bisect import bisect_left

    tails: list = []
    for x in xs:
        i = bisect_left(tails, x)
        tails[i : i + 1] = [x]
    return len(tails)
