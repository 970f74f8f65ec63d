"""Plain-Python parts: steps, control flow, statements, similarity, Markdown, pages, source scanning, queries."""

from __future__ import annotations

import random

import duckdb
import pytest

from docweft.functions import steps as S
from docweft.functions.markdown import transform_content
from docweft.functions.similarity import classify, jaro_winkler, longest_increasing
from docweft.operators import effects, search, state
from docweft.operators.coverage import scan_file
from docweft.sources import html as H

ALGO = """Intro text.

1. Let *x* be the [first thing](https://a.example/#first).
2. If *x* is null, then return.
3. If *x* has [[Parts]]:
    1. Set *x*'s [[Mode]] to "on".
        It goes on here.
    2. For each *y* of *x*.[[Parts]]:
        1. Append *y* to *z*'s [[Items]].
        2. Jump to step 4.
4. Otherwise, set *q* to *x*.
    > Note: not a part of it.
5. In parallel, run these steps:
    1. Wait until *q* is set.
    2. Abort these steps.
6. Jump to step 9.
7. Return *q*.

Then more.

1. Another list.
"""


def test_steps():
    steps = S.parse_steps(ALGO)
    assert [s.path for s in steps] == ["1", "2", "3", "3.1", "3.2", "3.2.1", "3.2.2", "4", "5", "5.1", "5.2", "6", "7"]
    assert steps[3].text.endswith("It goes on here.") and "Note" not in steps[7].text
    assert [steps[s.parent].path if s.parent >= 0 else None for s in steps][3:7] == ["3", "3", "3.2", "3.2"]
    assert S.parse_steps(None) == [] and S.parse_steps("no list") == []
    assert [s.path for s in S.parse_steps("3. a\n3. b\n    5. c")] == ["3", "4", "4.5"]


def test_flow():
    nodes, edges, issues = S.flow(ALGO, {"1": ["A#first"]})
    kind = {i: k for i, k, _ in nodes}
    assert (kind["2"], kind["3"], kind["3.2"], kind["5"], kind["7"], kind["5.2"], kind["A#first"]) == ("branch", "branch", "loop", "parallel", "terminal", "terminal", "external")
    got = set(edges)
    assert {("1", "A#first", "call"), ("1", "2", "next"), ("2", "3", "then"), ("3", "3.1", "then"), ("3.1", "3.2", "next"), ("3.2", "3.2.1", "then"), ("3.2", "4", "next"), ("3.2.2", "4", "jump"), ("3", "4", "else"), ("4", "5", "next"), ("5", "5.1", "then"), ("5", "5.2", "then"), ("5", "6", "next"), ("5.1", "5.2", "next")} <= got
    assert not any(a == "7" or a == "5.2" for a, _, _ in got)
    assert issues == [("6", "unresolved_jump")]
    _, e, i = S.flow("1. Otherwise, x.\n2. Continue.\n3. While a:\n    1. b\n4. c")
    assert i == [("1", "otherwise_without_if"), ("2", "unrecognised_control")]
    assert {("2", "3", "unknown"), ("3.1", "3", "loop"), ("3", "3.1", "then"), ("3", "4", "next")} <= set(e)


def test_statements():
    s = S.statement("Let *x* be *y*'s [[Mode]].")
    assert (s["kind"], s["defs"], s["uses"], s["reads"], s["writes"]) == ("let", ["x"], ["y"], ["Mode"], [])
    s = S.statement("If *a* is null, then set *x*'s [[Mode]] to *b*.[[Kind]].")
    assert (s["kind"], s["action"], s["writes"], s["reads"]) == ("if", "set", ["Mode"], ["Kind"])
    assert S.statement("Append *y* to *z*'s [[Items]].")["writes"] == ["Items"]
    assert S.statement("Frobnicate *q*.[[Z]].")["kind"] == "opaque"
    assert S.statement("Run [x y](https://a.example/b#c).")["calls"] == ["https://a.example/b#c"]


def test_slices():
    text = "1. Let *a* be 1.\n2. Let *b* be *a*.\n3. If *b* is 2:\n    1. Say hello.\n    2. Let *c* be 3.\n4. Return *c*."
    assert state.slice_forward(text, {"a"}) == [("1", "matched"), ("2", "matched"), ("3", "matched"), ("3.1", "inherited")]
    rows, inputs = state.slice_backward(text, "3.2")
    assert dict(rows) == {"3.2": "target", "3": "context", "2": "definition", "1": "definition"} and inputs == []
    rows, inputs = state.slice_backward("1. Return *z*.", "1")
    assert inputs == ["z"] and state.slice_backward("1. x", "9") == ([], [])


def test_similarity():
    r = random.Random(1)
    pairs = [("", ""), ("a", ""), ("martha", "marhta"), ("dixon", "dicksonx"), ("same", "same")] + [("".join(r.choice("abcde ") for _ in range(r.randrange(1, 12))), "".join(r.choice("abcde ") for _ in range(r.randrange(1, 12)))) for _ in range(200)]
    for a, b in pairs[2:]:
        want = duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]
        assert jaro_winkler(a, b) == pytest.approx(want, abs=1e-9), (a, b)
    assert classify("", "x") == "exact" and classify("Let *x* be 1.", "let x be 1") == "exact"
    assert classify("Let x", "Let x be 1") == "fuzzy" and classify("Throw it", "Let x be 1") == "mismatch"
    assert longest_increasing([3, 1, 2, 5, 4]) == 3 and longest_increasing([]) == 0 and longest_increasing([1, 1]) == 1


def test_transform_content():
    text = "See [a](https://x.example/#b) and `[c](#d)`.\n\n> **Note:** gone\n> still\n\n> a quote\n\n```\n[e](#f)\n```"
    assert transform_content(text) == text
    short = transform_content(text, links="short", asides=False)
    assert "[a](#b)" in short and "`[c](#d)`" in short and "gone" not in short and "a quote" in short and "[e](#f)" in short
    assert "See a and" in transform_content(text, links="none") and transform_content(None) is None


PAGE = """<html><body><h1>T</h1><nav><a href="#x">toc</a></nav>
<section id=intro><h2><span class=secno>1.</span> Intro</h2><p>Text with <a href="#run">run</a> & <a href="https://b.example/p.html#far">far</a><p>More
<h3 id=deep>Deep</h3><p>To <dfn id=run data-dfn-type=abstract-op>run it</dfn> given <var>x</var>:
<ol><li>If x: <ol><li><a href="#deep">go deep</a> now.<li>Return.</ol><li>Done, see <a href="#missing%20one">that</a>.</ol>
<h2 id=two>Two</h2><div class=note><a href="#intro">noted</a></div>
<pre class=idl id=idl-1>interface <dfn id=dom-a data-dfn-type=interface>A</dfn> { <dfn id=dom-a-b data-dfn-type=method data-dfn-for="A/x">b(y)</dfn>; };</pre>
<script>var s = "</p><h2 id=no>no</h2>";</script><h2 id=two>Again</h2></body></html>"""


def test_pages():
    got = H.extract(PAGE, "A", "https://a.example/", {"b.example": "B"})
    sec = {s["anchor"]: s for s in got["section"]}
    assert [s["anchor"] for s in got["section"]] == ["intro", "deep", "run", "two", "idl-1", "dom-a", "dom-a-b"]
    assert (sec["intro"]["number"], sec["intro"]["title"], sec["deep"]["parent_anchor"], sec["two"]["prev_anchor"], sec["run"]["section_type"]) == ("1", "Intro", "intro", "intro", "algorithm")
    steps = S.parse_steps(sec["run"]["content_text"])
    assert [s.path for s in steps] == ["1", "1.1", "1.2", "2"]
    refs = {(r["from_anchor"], r["to_spec"], r["to_anchor"]): r for r in got["ref"]}
    assert refs["run", "A", "deep"]["step_path"] == "1.1" and refs["run", "A", "deep"]["kind"] == "step" and refs["run", "A", "deep"]["guard_path"] == ["If x:"]
    assert refs["run", "A", "missing one"]["step_path"] == "2" and refs["intro", "B", "far"]["kind"] == "prose" and refs["two", "A", "intro"]["kind"] == "note"
    idl = {d["anchor"]: d for d in got["idl"]}
    assert idl["dom-a-b"]["canonical_name"] == "A.b" and idl["dom-a"]["kind"] == "interface" and "interface A" in idl["dom-a"]["idl_text"]
    assert H.extract("", "A", "", {}) == {"section": [], "ref": [], "idl": []}


SOURCE = """// https://a.example/#one
void f() {
  // Step 1. Let x be 1
  //   and more.
  // 2.1. Return.
  // https://a.example/#two.
    // 3. Nested
  g();
  // 4. Back in one
}
// 5. Outside
"""


def test_scopes():
    rows = scan_file(SOURCE)
    steps = {r["number"]: r for r in rows if r["what"] == "step"}
    assert steps["1"]["text"] == "Let x be 1 and more." and steps["1"]["url"] == "https://a.example/#one"
    assert steps["2.1"]["url"] == "https://a.example/#one" and steps["3"]["url"] == "https://a.example/#two"
    assert steps["4"]["url"] == "https://a.example/#one"
    assert scan_file("") == [] and scan_file(None) == []


def test_search_queries():
    assert search.parse_query('a "b c" OR NOT_x*') == ("or", ("and", ("term", None, ("a",), False), ("term", None, ("b", "c"), False)), ("term", None, ("not", "x"), True))
    for bad in ("", "a AND", "(a", "nope: x", "about:blank", "a)", '"open'):
        with pytest.raises(search.QueryError):
            search.parse_query(bad)
    assert search._tree("about:blank") == ("and", ("term", None, ("about",), False), ("term", None, ("blank",), False))


def test_snippets():
    text = "one two three [four five](https://x.example/four) and `code four here` end " + "pad " * 100
    s = search.confine_marks(search.snippet(text, [(("four",), False)]))
    assert "<mark>four</mark> five](https://x.example/four)" in s and "<mark>`code four here`</mark>" in s and s.endswith("...")
    assert search.snippet("", []) == "" and "<mark>b c</mark>" in search.snippet("a b c", [(("b", "c"), False)])


def test_catalogs():
    ok = '{"schema": 1, "rules": [{"id": "a", "kind": "event.fire", "pattern": "x (y)", "params": {"name": "$1"}}]}'
    assert effects.load_catalog(ok)[0].kind == "event.fire"
    for bad in ('{"schema": 2}', ok.replace("event.fire", "nope"), ok.replace("$1", "$2"), ok.replace('"id"', '"what": 1, "id"'), '{"schema": 1, "rules": [{"id": "a"}]}', ok.replace("[{", '[{"id": "a", "kind": "event.fire", "pattern": "z"}, {')):
        with pytest.raises(effects.CatalogError):
            effects.load_catalog(bad)


def test_yaml_catalogs():
    pytest.importorskip("yaml")
    text = "schema: 1\nrules:\n  - id: a\n    kind: event.fire\n    pattern: 'x (y)'\n    params: {name: $1}\n"
    assert effects.load_catalog(text)[0].params == {"name": "$1"}
    for bad in (text + "    kind: event.fire\n", "a: [", "- 1"):
        with pytest.raises(effects.CatalogError):
            effects.load_catalog(bad)


def test_clauses():
    page = "<emu-clause id=sec-a><h1><span class=secnum>7.1</span> ToIt ( x )</h1><p>It does.</p><emu-alg><ol><li>Return <emu-xref href='#sec-b'>b</emu-xref>.</ol></emu-alg><emu-clause id=sec-b><h1>B</h1></emu-clause></emu-clause>"
    got = H.extract(page, "E", "https://e.example/", {})
    a, b = got["section"]
    assert (a["title"], a["number"], a["section_type"], b["parent_anchor"], b["depth"]) == ("ToIt ( x )", "7.1", "algorithm", "sec-a", 3)
    assert [s.path for s in S.parse_steps(a["content_text"])] == ["1"] and got["ref"][0]["step_path"] == "1"


def test_signatures_and_bindings():
    from docweft.functions import signatures as G

    text = "To open a door, given a *door*, a boolean *fast* and an optional *key* (default null):\n\n1. Let *x* be *door*."
    params = G.signature(text)
    assert [(p["name"], p["optional"], p["default"]) for p in params] == [("door", False, None), ("fast", False, None), ("key", True, "null")]
    assert G.signature("1. Let *x* be 1.") == [] and G.signature(None) == [] and G.signature("Some *x* with *y*.") == []
    call = "Run [open](https://a.example/#open) given « *a*, *b* », true, and *key* set to 5. Then go."
    assert G.arguments(call, "open") == (["« *a*, *b* »", "true"], {"key": "5"}) and G.arguments(call, "other") is None
    args, sure, issues = G.bind(params, *G.arguments(call, "open"))
    assert args == [("door", "« *a*, *b* »", "positional"), ("fast", "true", "positional"), ("key", "5", "named")] and (sure, issues) == ("exact", [])
    assert G.bind(params, ["*a*"], {"nope": "1"})[1:] == ("partial", ["unknown_parameter", "missing_argument"])
    assert G.bind(params, [], {})[1] == "unbound" and G.bind([], ["x"], {})[2] == ["surplus_argument"] and G.bind([], [], {}) == ([], "exact", [])
