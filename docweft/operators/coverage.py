"""Coverage of algorithms by source code: addresses and step comments found, matched and counted."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.functions.similarity import classify, longest_increasing
from docweft.operators.lookup import ancestors, base_depth, url_key

_ADDRESS = r"https?://[^\s<>()\[\]\"'`]+#[^\s<>()\[\]\"'`]+"
#: A step comment: comment sign, optional word "step", number, optional dot, text. Fixed value.
_STEP = re.compile(r"(?://|#|;+|/\*+|\*)\s*([Ss]tep\s+)?(\d{1,3}(?:\.\d{1,3})*)(\.)?(?:\s*(.*?))\s*(?:\*/)?$")
_GOES_ON = re.compile(r"^\s*(?://|#|;+|\*)\s?\s*(\S.*?)\s*(?:\*/)?$")


def scan_addresses(files: DataFrame, specs: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Addresses of sections in texts: key, match_no, spec, anchor, url. Trailing punctuation is no part of an anchor.

    All addresses are taken in one pass over each text and joined to the specs by host and path, instead of one pattern
    of all bases; a page at any depth below a base belongs to it, below several to the longest.
    """
    found = files.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"({_ADDRESS})"), 1)).alias("match_no", "url"))
    found = found.withColumn("url", F.rtrim("url", F.lit(".,;:!?")))
    bases = specs.filter("base_url is not null").groupBy(url_key(F.col("base_url")).alias("_k")).agg(F.min("name").alias("spec"))
    parts = found.withColumn("_k", url_key(F.col("url"))).withColumn("anchor", F.substring_index("url", "#", -1)).filter("anchor <> ''")
    tries = parts.select(key, "match_no", "url", "anchor", F.inline(ancestors(F.col("_k"), base_depth(bases))))
    hit = tries.join(bases, tries["k"] == bases["_k"]).select(key, "match_no", "url", "anchor", "spec", "up")
    return hit.groupBy(key, "match_no", "url", "anchor").agg(F.min_by("spec", "up").alias("spec")).select(key, "match_no", "spec", "anchor", "url")


def scan_file(text: str) -> list[dict]:
    """Addresses and step comments of one source text with the scope of each step.

    An address opens a scope at its line's indent; an address no deeper than the open ones closes those, and so does code
    left of their indent, or at it after deeper code. A step comment belongs to the innermost scope. A comment line
    without a number that follows a step goes on with it.
    """
    out, open_ = [], []  # open_: [indent, url, went deeper]
    last = None
    for no, line in enumerate((text or "").split("\n"), 1):
        bare = line.strip()
        if not bare:
            last = None
            continue
        indent = len(line) - len(line.lstrip())
        urls = list(re.finditer(_ADDRESS, line))
        m = _STEP.search(line) if not urls else None
        is_step = bool(m and (m.group(1) or "." in m.group(2) or m.group(3)))
        comment = bare[:1] in "/#;*"
        while open_ and (indent < open_[-1][0] or (not comment and indent <= open_[-1][0] and open_[-1][2]) or (urls and indent <= open_[-1][0])):
            open_.pop()
        for s in open_:
            s[2] = s[2] or indent > s[0]
        for u in urls:
            url = u.group(0).rstrip(".,;:!?")
            open_.append([indent, url, False])
            out.append({"line": no, "what": "url", "url": url, "number": None, "text": None})
        if is_step:
            last = {"line": no, "what": "step", "url": open_[-1][1] if open_ else None, "number": m.group(2), "text": m.group(4) or ""}
            out.append(last)
        elif last is not None and comment and not urls and (g := _GOES_ON.match(line)):
            last["text"] = (last["text"] + " " + g.group(1)).strip()
        else:
            last = None
    return out


def scan_sources(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """scan_file over many texts: key, line, what (url, step), url (of the scope), number, text. No shuffle."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *r.values()) for k, t in zip(pdf[key], pdf[text]) for r in scan_file(t)]
            yield pd.DataFrame(rows, columns=[key, "line", "what", "url", "number", "text"])

    return files.select(key, text).mapInPandas(run, f"`{key}` {kind}, line int, what string, url string, number string, text string")


def classify_pairs(pairs: DataFrame, comment: str, step: str, threshold: float = 0.85) -> DataFrame:
    """Adds ``verdict`` (exact, fuzzy, mismatch) of a comment against a step, in Arrow batches; equal texts never leave
    the plan. Null steps give not_found."""
    # a cheap form: texts equal in it are equal in the true one
    fold = lambda c: F.rtrim(F.btrim(F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[*_`]", ""), r"\s+", " "))), F.lit(".,:;!?"))

    @F.pandas_udf("string")
    def verdict(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple, str] = {}
        return pd.Series([memo.setdefault(k, None) or memo.__setitem__(k, classify(k[0], k[1], threshold)) or memo[k] for k in zip(a.fillna(""), b.fillna(""))])

    decided = F.when(F.col(step).isNull(), "not_found").when(fold(F.col(comment)) == fold(F.col(step)), "exact")
    # one pass: only undecided texts go to Python
    rest = pairs.withColumn("_said", decided)
    open_ = lambda c: F.when(F.col("_said").isNull(), F.col(c))
    return rest.withColumn("verdict", F.coalesce("_said", verdict(open_(comment), open_(step)))).drop("_said")


def validate(scanned: DataFrame, steps: DataFrame, sections: DataFrame, key: str = "path") -> DataFrame:
    """Step comments against the steps they cite: key, line, spec, anchor, number, comment, step_text, verdict.

    scanned: key, line, number, text, spec, anchor; steps: spec, anchor, step_path, text.
    """
    s = steps.select("spec", "anchor", F.col("step_path").alias("number"), F.col("text").alias("step_text"))
    joined = scanned.select(key, "line", "spec", "anchor", "number", F.col("text").alias("comment")).join(s, ["spec", "anchor", "number"], "left")
    return classify_pairs(joined, "comment", "step_text")


def coverage(validated: DataFrame, steps: DataFrame, key: str = "path") -> DataFrame:
    """Per (key, spec, anchor): n_steps, n_implemented, n_missing, n_warnings (mismatch or not found), n_reordered.

    A step is implemented by its first comment that is exact, fuzzy or a mismatch. Reordered steps are those outside a
    longest increasing subsequence of the cited steps; the cited numbers of one algorithm in one file are a small array.
    """
    count = steps.groupBy("spec", "anchor").agg(F.count("*").alias("n_steps"))
    cited = validated.filter("verdict <> 'not_found'").groupBy(key, "spec", "anchor", "number").agg(F.min("line").alias("line"))
    numbers = F.transform(F.array_sort(F.collect_list(F.struct("line", "number"))), lambda x: F.transform(F.split(x["number"], r"\."), lambda n: n.cast("int")))

    @F.pandas_udf("int")
    def reordered(ns: pd.Series) -> pd.Series:
        return pd.Series([len(n) - longest_increasing([tuple(x) for x in n]) for n in ns])

    got = cited.groupBy(key, "spec", "anchor").agg(F.count("*").alias("n_implemented"), numbers.alias("_ns"))
    warn = validated.filter("verdict in ('mismatch', 'not_found')").groupBy(key, "spec", "anchor").agg(F.count("*").alias("n_warnings"))
    seen = validated.select(key, "spec", "anchor").distinct()
    out = seen.join(got, [key, "spec", "anchor"], "left").join(warn, [key, "spec", "anchor"], "left").join(count, ["spec", "anchor"], "left")
    empty = F.expr("cast(array() as array<array<int>>)")
    return out.select(key, "spec", "anchor", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), F.coalesce("n_implemented", F.lit(0)).alias("n_implemented"), (F.coalesce("n_steps", F.lit(0)) - F.coalesce("n_implemented", F.lit(0))).alias("n_missing"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"), reordered(F.coalesce("_ns", empty)).alias("n_reordered"))


def missing_steps(validated: DataFrame, steps: DataFrame, key: str = "path") -> DataFrame:
    """Steps of cited algorithms that no comment implements: key, spec, anchor, step_path, step_no."""
    seen = validated.select(key, "spec", "anchor").distinct()
    done = validated.filter("verdict <> 'not_found'").select(key, "spec", "anchor", F.col("number").alias("step_path"))
    return seen.join(steps.select("spec", "anchor", "step_path", "step_no"), ["spec", "anchor"]).join(done, [key, "spec", "anchor", "step_path"], "left_anti")


def step_drift(corpus, steps: DataFrame, old_steps: DataFrame) -> DataFrame:
    """Steps of two versions of algorithms against each other by number: spec, anchor, step_path, verdict."""
    a = steps.select("spec", "anchor", "step_path", F.col("text").alias("new_text"))
    b = old_steps.select("spec", "anchor", "step_path", F.col("text").alias("old_text"))
    return classify_pairs(b.join(a, ["spec", "anchor", "step_path"], "left"), "old_text", "new_text").select("spec", "anchor", "step_path", "verdict")
