"""Full-text search: postings, BM25 ranking, boolean queries with phrases and prefixes, snippets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.operators.corpus import Corpus

#: BM25 as published for the store's ranking function. Fixed values.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FIELDS = ("anchor", "title", "content_text")


def _unaccented() -> tuple[str, str]:
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        low = chr(cp).lower()
        base = unicodedata.normalize("NFD", low)[0]
        if len(low) == 1 and low == chr(cp) and base != low and base.isascii():
            src.append(low), dst.append(base)
    return "".join(src), "".join(dst)


_FROM, _TO = _unaccented()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without diacritics, as an array; empty for null."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), _FROM, _TO)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, key: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per (document, field, term): key, field, term, tf, positions. The index that searches can be run on."""
    each = docs.select(*key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("ts")) for f in fields])).alias("x")).select(*key, "x.field", F.posexplode("x.ts").alias("pos", "term"))
    return each.groupBy(*key, "field", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


# ---- queries -------------------------------------------------------------------------------------------------------

_LEX = re.compile(r'\s*(?:(?P<near>NEAR)\s*(?=\()|(?P<col>\w+)\s*:|"(?P<phrase>(?:[^"]|"")*)"(?P<pstar>\s*\*)?|(?P<op>AND|OR|NOT)(?=[\s("]|$)|(?P<word>[\w]+)(?P<star>\*)?|(?P<par>[()+^,]))')


class QueryError(ValueError):
    """A query that does not follow the grammar."""


def parse_query(query: str) -> tuple:
    """A query as nested tuples: ("and" | "or" | "not", a, b), ("term", column, (words...), prefix), with True behind it if it must come first, or
    ("near", column, ((words, prefix), ...), distance).

    Grammar: words, "phrases", prefixes (word*), phrases put together (a + b), the first word of a column (^word),
    NEAR(a b, 10), column filters (title: word), AND (also implied), OR, NOT, parentheses.
    """
    items, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m or m.end() == at:
            raise QueryError(f"unexpected sign in {query!r} at {at}")
        items.append({k: v for k, v in m.groupdict().items() if v is not None})
        at = m.end()

    def words(text: str) -> tuple[str, ...]:
        low = "".join(_TO[_FROM.index(c)] if c in _FROM else c for c in text.lower())
        return tuple(re.findall(r"[^\W_]+", low))

    def either(i: int):
        left, i = both(i)
        while i < len(items) and items[i].get("op") == "OR":
            right, i = both(i + 1)
            left = ("or", left, right)
        return left, i

    def both(i: int):
        left, i = minus(i)
        while i < len(items) and items[i].get("op") not in ("OR", "NOT") and items[i].get("par") != ")":
            if items[i].get("op") == "AND":
                i += 1
            right, i = minus(i)
            left = ("and", left, right)
        return left, i

    def minus(i: int):
        left, i = single(i)
        while i < len(items) and items[i].get("op") == "NOT":
            right, i = single(i + 1)
            left = ("not", left, right)
        return left, i

    def single(i: int):
        if i >= len(items):
            raise QueryError("the query ends too early")
        x = items[i]
        if x.get("par") == "(":
            inner, i = either(i + 1)
            if i >= len(items) or items[i].get("par") != ")":
                raise QueryError("a parenthesis is open")
            return inner, i + 1
        column = None
        if "col" in x:
            column = x["col"]
            if column not in FIELDS:
                raise QueryError(f"no such column: {column}")
            i += 1
            x = items[i] if i < len(items) else {}
        if "near" in x:
            return near(i + 1, column)
        first = x.get("par") == "^"
        if first:
            i += 1
        got, prefix, i = phrase(i)
        return ("term", column, got, prefix, *([True] if first else [])), i

    def phrase(i: int):
        """A word or phrase, with what + puts behind it."""
        x = items[i] if i < len(items) else {}
        if "phrase" not in x and "word" not in x:
            raise QueryError("a word was expected")
        got, prefix = words(x.get("phrase", x.get("word"))), "pstar" in x or "star" in x
        if i + 1 < len(items) and items[i + 1].get("par") == "+":
            more, prefix, i = phrase(i + 2)
            return got + more, prefix, i
        return got, prefix, i + 1

    def near(i: int, column: str | None):
        parts, distance = [], 10
        i += 1
        while i < len(items) and items[i].get("par") not in (")", ","):
            got, prefix, i = phrase(i)
            parts.append((got, prefix))
        if i < len(items) and items[i].get("par") == ",":
            number = items[i + 1].get("word", "") if i + 1 < len(items) else ""
            if not number.isdigit():
                raise QueryError("NEAR wants a number")
            distance, i = int(number), i + 2
        if i >= len(items) or items[i].get("par") != ")" or not parts:
            raise QueryError("NEAR is open")
        parts = [p for p in parts if p[0]]
        return (("near", column, tuple(parts), distance) if len(parts) > 1 else ("term", column, *(parts[0] if parts else ((), False)))), i + 1

    if not items:
        raise QueryError("the query is empty")
    tree, end = either(0)
    if end != len(items):
        raise QueryError("the query goes on after its end")
    return tree


def quoted(query: str) -> str:
    """Every run of letters and digits as a phrase of its own: what is searched when a query breaks the grammar."""
    return " ".join(f'"{w}"' for w in re.findall(r"[^\W_]+", query))


def _tree(query: str) -> tuple | None:
    try:
        return parse_query(query)
    except QueryError:
        safe = quoted(query)
        return parse_query(safe) if safe else None


def _leaves(tree: tuple) -> list[tuple]:
    return [tree] if tree[0] in ("term", "near") else [x for t in tree[1:] for x in _leaves(t)]


def _starts(ts: Column, words: tuple[str, ...], prefix: bool) -> Column:
    """The places at which the words stand in a row in an array of tokens."""
    last = len(words) - 1
    if not words:
        return F.expr("cast(array() as array<int>)")
    start = F.filter(F.transform(ts, lambda t, i: F.when((F.startswith(t, F.lit(words[0]))) if prefix and last == 0 else (t == words[0]), i)), lambda i: i.isNotNull())
    if last == 0:
        return start

    def goes_on(i: Column) -> Column:
        cond = F.lit(True)
        for k in range(1, last + 1):
            t = F.get(ts, i + k)
            cond = cond & F.coalesce(F.startswith(t, F.lit(words[k])) if prefix and k == last else (t == words[k]), F.lit(False))
        return cond

    return F.filter(start, goes_on)


def _hits(ts: Column, leaf: tuple) -> Column:
    """How often a leaf of a query is met in an array of tokens. Phrases are near if at most so many tokens lie between
    the end of the first and the start of the last; then the first phrase's places that begin such a stretch count."""
    if leaf[0] == "term":
        at = _starts(ts, leaf[2], leaf[3])
        return F.size(F.filter(at, lambda i: i == 0)) if len(leaf) > 4 else F.size(at)
    _, _, parts, distance = leaf

    def reaches(others: list[Column], reach: int):
        def all_near(s: Column) -> Column:
            cond = F.lit(True)
            for other in others:
                cond = cond & F.exists(other, lambda t: (t >= s) & (t <= s + reach))
            return cond

        return all_near

    total = F.lit(0)
    for k, (words, prefix) in enumerate(parts):
        others = [_starts(ts, *p) for j, p in enumerate(parts) if j != k]
        total = total + F.size(F.filter(_starts(ts, words, prefix), reaches(others, len(words) + distance)))
    return total


def search(corpus: Corpus, queries: list[str], spec: str | None = None, limit: int = 20, with_snippet: bool = False) -> DataFrame:
    """The best sections for each query: query_no, rank_no, spec, anchor, title, section_type, score (negative, best
    first) and, if asked for, snippet. Equal scores are ordered by spec and document order.

    A query that breaks the grammar is searched again with each word quoted; one without words finds nothing. All
    queries are answered in one scan: a section's tokens are counted where they are read, only counts of the few query
    terms and the matching sections travel, and the corpus statistics come from the same scan.
    """
    trees = {i: _tree(q) for i, q in enumerate(queries)}
    trees = {i: t for i, t in trees.items() if t is not None and any(x[2] for x in _leaves(t))}
    s = corpus.sections
    if not trees:
        return s.limit(0).select(F.lit(0).alias("query_no"), F.lit(0).alias("rank_no"), "spec", "anchor", "title", "section_type", F.lit(0.0).alias("score"))
    terms = sorted({x for t in trees.values() for x in _leaves(t)}, key=str)
    number = {x: i for i, x in enumerate(terms)}
    tok = s.select("spec", "anchor", "title", "section_type", "ord", "content_text", *[tokens(F.col(f)).alias(f"_{f}") for f in FIELDS])
    hits = []
    for leaf in terms:
        n = F.lit(0)
        for f in [leaf[1]] if leaf[1] else FIELDS:
            n = n + _hits(F.col(f"_{f}"), leaf)
        hits.append(n)
    counted = tok.select("spec", "anchor", "title", "section_type", "ord", *(["content_text"] if with_snippet else []), sum((F.size(f"_{f}") for f in FIELDS[1:]), F.size(f"_{FIELDS[0]}")).alias("_len"), F.array(*hits).alias("_tf"))
    stats = counted.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *[F.count_if(F.col("_tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))])  # one row
    first = stats.first()
    n, avg = first["n"], first["avg"] or 1.0
    import math

    idf = [max(LEAST_IDF, math.log((n - first[f"df{i}"] + 0.5) / (first[f"df{i}"] + 0.5))) if n else LEAST_IDF for i in range(len(terms))]

    def holds(tree: tuple) -> Column:
        if tree[0] in ("term", "near"):
            return F.col("_tf")[number[tree]] > 0 if tree[2] else F.lit(True)
        a, b = holds(tree[1]), holds(tree[2])
        return a & b if tree[0] == "and" else a | b if tree[0] == "or" else a & ~b

    def scoring(tree: tuple) -> list[tuple]:
        return [tree] if tree[0] in ("term", "near") else scoring(tree[1]) + (scoring(tree[2]) if tree[0] != "not" else [])

    def score(tree: tuple) -> Column:
        total = F.lit(0.0)
        for x in scoring(tree):
            if x[2]:
                tf = F.col("_tf")[number[x]]
                total = total + F.lit(idf[number[x]]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / avg))
        return -total

    found = counted if spec is None else counted.filter(F.lower("spec") == spec.lower())
    each = F.explode(F.filter(F.array(*[F.when(holds(t), F.struct(F.lit(i).alias("query_no"), score(t).alias("score"))) for i, t in trees.items()]), lambda x: x.isNotNull())).alias("x")
    rows = found.select("spec", "anchor", "title", "section_type", "ord", *(["content_text"] if with_snippet else []), each).select("x.query_no", "x.score", "spec", "anchor", "title", "section_type", "ord", *(["content_text"] if with_snippet else []))
    w = Window.partitionBy("query_no").orderBy("score", "spec", F.col("ord").asc_nulls_last(), "anchor")
    top = rows.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= limit)
    out = ["query_no", "rank_no", "spec", "anchor", "title", "section_type", "score"]
    if not with_snippet:
        return top.select(*out)
    marked = lambda x: [(x[2], x[3])] if x[0] == "term" else list(x[2])
    wanted = {i: [p for x in scoring(t) if x[2] and x[1] in (None, "content_text") for p in marked(x)] for i, t in trees.items()}

    def snippets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["snippet"] = [confine_marks(snippet(t or "", wanted[i])) for t, i in zip(pdf["content_text"], pdf["query_no"])]
            yield pdf[[*out, "snippet"]]

    return top.select(*out, "content_text").mapInPandas(snippets, "query_no int, rank_no int, spec string, anchor string, title string, section_type string, score double, snippet string")


# ---- snippets ------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+")


def snippet(text: str, wanted: list[tuple[tuple[str, ...], bool]], open_: str = "<mark>", close: str = "</mark>", size: int = 64) -> str:
    """The stretch of ``size`` tokens with the most different query terms (then hits, then the first), hits marked."""
    spans = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    if not spans:
        return text
    fold = str.maketrans(_FROM, _TO)
    words = [text[s:e].lower().translate(fold) for s, e in spans]
    hit: list[tuple[int, int, int]] = []
    for k, (phrase, prefix) in enumerate(wanted):
        m = len(phrase)
        for i in range(len(words) - m + 1):
            if words[i : i + m - 1] == list(phrase[:-1]) and (words[i + m - 1].startswith(phrase[-1]) if prefix else words[i + m - 1] == phrase[-1]):
                hit.append((i, i + m, k))
    hit.sort()
    best, start = (-1, -1), 0
    for first in sorted({max(0, min(i, len(words) - size)) for i, _, _ in hit} or {0}):
        inside = [k for i, j, k in hit if i >= first and j <= first + size]
        if (len(set(inside)), len(inside)) > best:
            best, start = (len(set(inside)), len(inside)), first
    stop = min(len(words), start + size)
    marks: list[list[int]] = []
    for i, j, _ in hit:
        if i >= start and j <= stop:
            if marks and i <= marks[-1][1]:
                marks[-1][1] = max(marks[-1][1], j)
            else:
                marks.append([i, j])
    lo, hi = (0 if start == 0 else spans[start][0]), (len(text) if stop == len(words) else spans[stop - 1][1])
    out, at = ["..." if start else ""], lo
    for i, j in marks:
        out += [text[at : spans[i][0]], open_, text[spans[i][0] : spans[j - 1][1]], close]
        at = spans[j - 1][1]
    return "".join([*out, text[at:hi], "..." if stop < len(words) else ""])


def confine_marks(text: str, open_: str = "<mark>", close: str = "</mark>") -> str:
    """Marks kept out of link targets, code spans with a hit marked whole, and marks left open closed."""
    bare = lambda x: x.replace(open_, "").replace(close, "")
    text = re.sub(r"(\]\()([^)\n]*)(\)?)", lambda m: m.group(1) + bare(m.group(2)) + m.group(3), text)
    text = re.sub(r"(`+)([^`]*(?:(?!\1)`+[^`]*)*)\1(?!`)", lambda m: f"{open_}{bare(m.group(0))}{close}" if open_ in m.group(0) else m.group(0), text)
    text = re.sub(f"{re.escape(open_)}({re.escape(open_)})+", open_, text)
    return text + close * max(0, text.count(open_) - text.count(close))
