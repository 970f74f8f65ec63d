"""Repetition inside single documents, measured by a cascade of rules ordered by rejection per cost."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.operators.runtime import spread

#: Length of a run that counts as repeated, least words of a case, least repeated share (as a fraction's parts).
RUN, LEAST_WORDS, SHARE = 8, 16, (1, 3)
#: Documents of the sample on which costs and selectivities of the rules are estimated (at most).
SAMPLE = 400
_WORD = re.compile(r"[^\W_]+")
_CACHE = 300_000


class _Words(dict):
    """Word numbers of each blank-separated chunk of lower-cased text."""

    def __init__(self):
        super().__init__()
        self.number: dict[str, int] = {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        number = self.number
        got = tuple(number.setdefault(w, len(number)) for w in _WORD.findall(chunk))
        if len(chunk) < 64:
            self[chunk] = got
        return got

    def of(self, text: str | None) -> np.ndarray:
        """The words of a text as numbers; equal words of one text have equal numbers."""
        if not text:
            return np.zeros(0, np.int64)
        if len(self) >= _CACHE or len(self.number) >= 4 * _CACHE:
            self.clear()
            self.number.clear()
        return np.fromiter(chain.from_iterable(map(self.__getitem__, text.lower().split())), np.int64)


def repeated_words(words: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each word, whether it lies in a run of ``run`` words that also starts at an earlier word of the text.

    Runs are compared by 64-bit hashes; equal hashes are then compared word by word, so the result is exact.
    """
    n = len(words)
    marked = np.zeros(n, bool)
    if n <= run:
        return marked
    m = n - run + 1
    h = np.zeros(m, np.uint64)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for k in range(run):
        h = h * np.uint64(0x100000001B3) + mixed[k : k + m]
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    start = first[which]
    again = np.flatnonzero(start < np.arange(m))
    if not len(again):
        return marked
    earlier = start[again]
    equal = np.ones(len(again), bool)
    for k in range(run):
        equal &= words[again + k] == words[earlier + k]
    if not equal.all():  # hashes that met by chance: look at the runs themselves
        seen: set[bytes] = set()
        grams = np.lib.stride_tricks.sliding_window_view(words, run)
        hits = []
        for i in range(m):
            g = grams[i].tobytes()
            if g in seen:
                hits.append(i)
            seen.add(g)
        again = np.array(hits, np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + run, -1)
    return np.cumsum(edge[:-1]) > 0


def _distinct(words: np.ndarray, k: int) -> int:
    if k == 1:
        return len(np.unique(words))
    m = len(words) - k + 1
    h = words[:m].astype(np.uint64)
    for j in range(1, k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + m].astype(np.uint64)
        h ^= h >> np.uint64(31)
    return len(np.unique(h))


def _rule(k: int) -> Callable[[np.ndarray], bool]:
    """Rejects a text that has too many distinct sequences of k words to be a case.

    In a case at least R = n/3 words are repeated, in stretches of 8 or more; of l such words, l - k + 1 start a
    sequence of k that came before, at least (9 - k)/8 each. Hence no more than (n - k + 1) - R (9 - k)/8 are distinct.
    """

    def rejects(words: np.ndarray) -> bool:
        n = len(words)
        if n < LEAST_WORDS:
            return True
        least = -(-n * SHARE[0] // SHARE[1])
        return _distinct(words, k) * RUN > (n - k + 1) * RUN - least * (RUN + 1 - k)

    return rejects


def is_case(words: np.ndarray) -> bool:
    """The exact rule that decides what no other has rejected."""
    return len(words) >= LEAST_WORDS and int(repeated_words(words).sum()) * SHARE[1] >= len(words) * SHARE[0]


#: Each rule rejects only texts that cannot be cases, so their order changes the cost, never the result.
RULES: dict[str, Callable[[np.ndarray], bool]] = {
    "length": lambda w: len(w) < LEAST_WORDS,
    "vocabulary": _rule(1),
    "pairs": _rule(2),
    "fours": _rule(4),
}


def _estimate(documents: DataFrame, text_col: str) -> list[tuple[str, float, float]]:
    """(rule, cost in seconds a text, share rejected) on at most SAMPLE documents, measured in one task of the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        texts = [w for b in batches for w in map(words.of, b.column(0).to_pylist())]
        rows = []
        for name, rule in RULES.items():
            began = time.perf_counter()
            rejected = sum(map(rule, texts))
            rows.append((name, (time.perf_counter() - began) / max(1, len(texts)), rejected / max(1, len(texts))))
        began = time.perf_counter()
        for w in texts:
            is_case(w)
        rows.append(("exact", (time.perf_counter() - began) / max(1, len(texts)), 0.0))
        yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["rule", "cost", "rejects"])

    n = documents.select(F.lit(1)).count()
    taken = documents.select(text_col).sample(min(1.0, 2 * SAMPLE / max(1, n)), seed=7).limit(SAMPLE).coalesce(1)
    return [tuple(r) for r in taken.mapInArrow(run, "rule string, cost double, rejects double").collect()]


def cascade(estimates: list[tuple[str, float, float]]) -> list[str]:
    """The rules worth running, by falling rejection per cost.

    A rule whose cost exceeds what it saves (its rejections times the cost of the exact rule) is left out: the exact
    rule decides its texts just as well.
    """
    exact = next((c for r, c, _ in estimates if r == "exact"), 1.0)
    use = [(p / max(c, 1e-9), r) for r, c, p in estimates if r in RULES and p * exact > c]
    return [r for _, r in sorted(use, reverse=True)]


def repetitive_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The documents given over to repetition: id, n_words, n_repeated, share.

    Words are maximal runs of letters and digits of the lower-cased text. A case has at least 16 words, of which at
    least a third lie in runs of 8 that also start earlier in the text. Null and empty texts are no cases. Rows with
    equal ids are judged one by one.

    A short-circuit cascade: cheap rules that can only reject run first, in the order of rejection per cost on a sample
    (``order`` overrides it); what passes them is decided exactly. No shuffle.
    """
    names = cascade(_estimate(documents, text_col)) if order is None else order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        rules = [RULES[r] for r in names]
        for b in batches:
            at, ns, reps = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                w = words.of(text)
                if len(w) < LEAST_WORDS or any(r(w) for r in rules):
                    continue
                r = int(repeated_words(w).sum())
                if r * SHARE[1] >= len(w) * SHARE[0]:
                    at.append(i), ns.append(len(w)), reps.append(r)
            if at:
                yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array(ns, pa.int64()), pa.array(reps, pa.int64()), pa.array([r / n for r, n in zip(reps, ns)])], names=[id_col, "n_words", "n_repeated", "share"])

    kind = dict(documents.dtypes)[id_col]
    return spread(documents.select(id_col, text_col).filter(F.col(text_col).isNotNull())).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_repeated bigint, share double")


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _twice(parts: list[str]) -> float:
    """The share of characters in parts that came before."""
    seen: set[str] = set()
    total = again = 0
    for p in (" ".join(x.split()).lower() for x in parts):
        if p:
            total += len(p)
            again += len(p) * (p in seen)
            seen.add(p)
    return again / total if total else 0.0


def repetition_profile(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: n_words and the shares of words, sentences, lines and paragraphs that repeat earlier ones.

    Shares of sentences, lines and paragraphs are of characters, after blanks are folded and case is ignored. Null and
    empty texts have zero words and zero shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in b.column(1).to_pylist():
                text = text or ""
                w = words.of(text)
                r = int(repeated_words(w).sum())
                lines = text.split("\n")
                paragraphs = re.split(r"\n[ \t\r]*\n", text)
                for c, v in zip(out, (len(w), r, r / len(w) if len(w) else 0.0, _twice([s for p in paragraphs for s in _SENTENCE.split(p)]), _twice(lines), _twice(paragraphs))):
                    c.append(v)
            yield pa.record_batch([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *[pa.array(c, pa.float64()) for c in out[2:]]], names=[id_col, "n_words", "n_repeated", "word_share", "sentence_share", "line_share", "paragraph_share"])

    kind = dict(documents.dtypes)[id_col]
    return spread(documents.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_repeated bigint, word_share double, sentence_share double, line_share double, paragraph_share double")
