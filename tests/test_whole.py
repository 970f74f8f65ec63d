"""Queries that must do the whole job, against brute force on small tables."""

from __future__ import annotations

import hashlib
import json
import re

import pytest

import __spark_entry__ as entry
from docweft.functions.steps import parse_steps, plain
from docweft.operators import effects
from docweft.sources.tables import SCHEMAS

TEXTS = {
    "a": "1. Queue a blue task.\n2. Run [b](S#b).\n",
    "b": "1. Queue a red task.\n    1. Throw a fit in parallel.\n2. Run [a](S#a) or [e](S#e).\n",
    "c": "1. Wait until it is done.\n2. Post the red flag.\n",
    "d": "1. In parallel, run [c](S#c).\n2. The thing of [b](S#b).\n",
    "e": "1. Reject the red one.\n",
}
#: from, to, step path, step text; d links to c twice.
LINKS = [("a", "b", "2", "Run b."), ("b", "a", "2", "Run a or e."), ("b", "e", "2", "Run a or e."), ("d", "c", "1", "In parallel, run c."), ("d", "c", "1", "In parallel, run c."), ("d", "b", "2", "The thing of b."), ("e", "p", "1", "Reject the red one.")]


def write(spark, path, **rows):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows.get(name, []), schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def corpus(spark, path, texts, links):
    sections = [(100 + i, 1, a, a, t, "algorithm", None, None, None, 1, None, i) for i, (a, t) in enumerate(texts.items())] + [(199, 1, "p", "p", "Prose.", "definition", None, None, None, 1, None, 99)]
    refs = [(i, 1, a, "S", b, at, text, None, None, "step", i) for i, (a, b, at, text) in enumerate(links)]
    return write(spark, path, specs=[(1, "S", "https://s.example/", "p")], snapshots=[(1, 1, "x", "2021-01-01T00:00:00Z", None, 1, None, None, None, "8")], sections=sections, refs=refs)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return corpus(spark, str(tmp_path_factory.mktemp("small") / "t"), TEXTS, LINKS)


def occurrences(texts):
    """node, step_path, kind, params, rule of DEFAULT_RULES on all steps, text by text."""
    out = set()
    for a, t in texts.items():
        for s in parse_steps(t):
            for r in effects.DEFAULT_RULES:
                if m := re.search(r.pattern, plain(s.text)):
                    params = {n: m.group(int(v[1:])) if v.startswith("$") else v for n, v in r.params.items()}
                    out.add((f"S#{a}", s.path, r.kind, json.dumps(params, separators=(",", ":"), sort_keys=True), r.id))
    return out


def eid(kind, params):
    return "ef_" + hashlib.sha256(f"{kind}\0{params}".encode()).hexdigest()


def test_effects_of_all_steps(spark, small):
    want = occurrences(TEXTS)
    assert {tuple(r) for r in entry.queries()["effect_occurrences"](spark, small).select("node", "step_path", "kind", "params", "rules").collect()} == want
    calls = {("S#a", "S#b", 0), ("S#b", "S#a", 0), ("S#b", "S#e", 0), ("S#d", "S#c", 2), ("S#d", "S#b", 1)}
    best = {(n, eid(k, p), 0): 0 for n, _, k, p, _ in want}
    for d in range(1, 20):
        for a, b, x in calls:
            for (n, e, y), far in list(best.items()):
                if n == b and far == d - 1:
                    best.setdefault((a, e, max(x, y)), d)
    got = {(r.node, eid(r.kind, r.params), r.exec): r.distance for r in entry.queries()["effect_states"](spark, small).collect()}
    assert got == best
    assert len({e for _, e, _ in got}) > len({k for _, _, k, _, _ in want})
