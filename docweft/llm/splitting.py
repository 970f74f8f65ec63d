"""Splitting oversized texts at natural boundaries, by dynamic programming over boundary positions."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.operators.runtime import spread

#: Penalty of a cut by what ends there. Fixed values of the cost model.
PENALTIES = {"end": 0.0, "paragraph": 0.0, "step": 0.6, "line": 1.2, "sentence": 2.0, "word": 6.0, "anywhere": 25.0}
#: Added to a cut inside a fenced block.
IN_FENCE = 4.0
#: Cost of each piece (few pieces are better) and weight of the squared relative deviation from equal sizes.
PER_PIECE, IMBALANCE = 3.0, 4.0

_PARAGRAPH = re.compile(r"\n[ \t\r]*\n[ \t\r\n]*(?=\S)")
_STEP = re.compile(r"\n(?=[ \t]*(?:\d+[.)]|[-*+]|#{1,6}) )")
_LINE = re.compile(r"\n(?=.)", re.S)
_SENTENCE = re.compile(r"[.!?][\"'”’)\]*_`]*[ \t]+(?=\S)|[。！？．][」』）”’]*(?=\S)")
_WORD = re.compile(r"\s+(?=\S)")
_FENCE = re.compile(r"(?m)^ {0,3}(```|~~~)")
_KINDS = ["end", "paragraph", "step", "line", "sentence", "word", "anywhere"]


def boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where text may be cut, ascending, and the rank of each in _KINDS. The last is the text's end.

    Every word's end is one; bare positions only fill stretches of more than an eighth of the limit without any.
    """
    n = len(text)
    found: dict[int, int] = {n: 0}
    for rank, pattern in ((1, _PARAGRAPH), (2, _STEP), (3, _LINE), (4, _SENTENCE), (5, _WORD)):
        for m in pattern.finditer(text):
            found.setdefault(m.end(), rank)
    found.pop(0, None)
    gap = max(1, limit // 8)
    last = 0
    for p in sorted(found):
        if p - last > gap:
            for q in range(last + gap, p, gap):
                found[q] = 6
        last = p
    at = np.array(sorted(found), np.int64)
    return at, np.array([found[p] for p in at], np.int64)


def _least_fines(at: np.ndarray, penalty: np.ndarray, limit: int, reach: int) -> np.ndarray:
    """For each boundary, a bound from below of the cost of all solutions that cut there: penalties and piece costs only,
    with pieces that may end up to ``reach`` after the cut before them. Sliding minima, forward and backward."""
    ends, fine = at.tolist(), (penalty + PER_PIECE).tolist()
    m = len(ends)
    to = [0.0] * m
    window: deque[int] = deque()
    for i in range(m):
        while window and ends[window[0]] < ends[i] - reach:
            window.popleft()
        to[i] = fine[i] + (0.0 if ends[i] <= limit else to[window[0]] if window else np.inf)
        while window and to[window[-1]] >= to[i]:
            window.pop()
        window.append(i)
    rest = [0.0] * m
    window.clear()
    for i in range(m - 1, -1, -1):
        while window and ends[window[0]] > ends[i] + reach:
            window.popleft()
        if i < m - 1:
            rest[i] = rest[window[0]] + fine[window[0]] if window else np.inf
        while window and rest[window[-1]] + fine[window[-1]] >= rest[i] + fine[i]:
            window.pop()
        window.append(i)
    return np.array(to) + np.array(rest)


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, what ends there) of the pieces of a text, each at most ``limit`` code points long.

    A text within the limit is one piece. Each later piece starts about ``overlap`` characters before the former ends
    (between three quarters and five quarters of it), at the best boundary there. The cuts minimise the sum of cut
    penalties, a cost per piece and the squared deviation from equal sizes, over all choices of boundaries.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    if not 0 <= overlap <= limit // 4:
        raise ValueError("the overlap must lie between 0 and a quarter of the limit")
    at, rank = boundaries(text, limit)
    m = len(at)
    penalty = np.array([PENALTIES[k] for k in _KINDS])[rank]
    fences = np.array([f.start() for f in _FENCE.finditer(text)], np.int64)
    if len(fences):
        penalty = penalty + np.where((np.searchsorted(fences, at, "left") % 2 == 1) & (rank > 0), IN_FENCE, 0.0)
    count = -(-(n - overlap) // (limit - overlap))
    even = (n + (count - 1) * overlap) / count

    def starts(of: np.ndarray) -> np.ndarray:
        """Where a piece starts that follows a cut at each of these boundaries."""
        out = np.maximum(at[of] - overlap, 0)
        if overlap:
            lo, hi = np.searchsorted(at, at[of] - overlap - overlap // 4), np.searchsorted(at, at[of] - overlap + overlap // 4, "right")
            for k in range(len(of)):
                if hi[k] > lo[k]:
                    near = slice(lo[k], hi[k])
                    out[k] = at[near][np.argmin(penalty[near] + np.abs(at[near] - (at[of[k]] - overlap)) / overlap)]
        return out

    def solve(of: np.ndarray) -> tuple[float, list[int]]:
        """The least cost with cuts at some boundaries only, the end among them, and the cuts."""
        ends, start, fine = at[of], starts(of), penalty[of] + PER_PIECE
        best = np.full(len(of), np.inf)
        back = np.full(len(of), -1, np.int64)
        first = np.searchsorted(start, ends - limit)  # earlier cuts leave more than the limit
        for i in range(len(of)):
            e, lo = ends[i], first[i]
            if e <= limit:
                best[i] = fine[i] + IMBALANCE * ((e - even) / even) ** 2
            if lo < i:
                cost = best[lo:i] + IMBALANCE * ((e - start[lo:i] - even) / even) ** 2
                j = int(np.argmin(cost))
                if cost[j] + fine[i] < best[i]:
                    best[i], back[i] = cost[j] + fine[i], lo + j
        chosen, i = [], len(of) - 1
        while i >= 0:
            chosen.append(int(of[i]))
            i = int(back[i])
        return float(best[-1]), chosen[::-1]

    # A solution with few boundaries bounds the cost. Cuts that no solution within the bound can use, as pieces cost at
    # least their fines, need not be tried: the result is the best over all boundaries.
    few = np.flatnonzero((rank < 5) | (rank == 6))
    least, cuts = solve(few)
    if np.isinf(least):
        least, cuts = solve(np.arange(m))
    else:
        through = _least_fines(at, penalty, limit, limit - overlap + overlap // 4)
        more = np.flatnonzero(through <= least + 1e-9)
        if len(np.setdiff1d(more, few)):
            _, cuts = solve(np.union1d(more, [m - 1]))
    start = dict(zip(cuts, starts(np.array(cuts)).tolist()))
    out, s = [], 0
    for i in cuts:
        out.append((s, int(at[i]), _KINDS[rank[i]]))
        s = start[i]
    return out


_SCHEMA = pa.schema([("id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("overlap", pa.int32()), ("boundary", pa.string()), ("piece", pa.string())])


def split_oversized(rows: DataFrame, limit: int, overlap: int, id_col: str = "id", text_col: str = "content_text") -> DataFrame:
    """The pieces of every text of more than ``limit`` code points; other rows, null texts included, give none.

    Result: id, piece_no (from 1), n_pieces, start, end (code points), overlap (shared with the piece before),
    boundary (end, paragraph, step, line, sentence, word or anywhere) and piece. The pieces less their overlaps give
    the text again. Rows are filtered by length in the scan's own stage; there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in _SCHEMA]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pieces = split_text(text, limit, overlap)
                before = 0
                for k, (s, e, kind) in enumerate(pieces):
                    for c, v in zip(cols, (key, k + 1, len(pieces), s, e, before - s if k else 0, kind, text[s:e])):
                        c.append(v)
                    before = e
                if len(cols[0]) > 2000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)
                    cols = [[] for _ in _SCHEMA]
            if cols[0]:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

    big = rows.filter(F.char_length(text_col) > limit).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return spread(big).mapInArrow(run, "id bigint, piece_no int, n_pieces int, start bigint, end bigint, overlap int, boundary string, piece string")
