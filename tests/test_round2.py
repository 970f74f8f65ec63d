"""Operators against plain Python: search grammar, selectors, chains of names, locks, witnesses, calls, checkpoints."""

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from docweft.functions import names
from docweft.functions.similarity import classify, normal_step
from docweft.functions.steps import flow, statement
from docweft.operators import effects, graph, runtime, search, selectors, state
from docweft.streaming.lock import Busy, WriterLock, publish


@pytest.mark.parametrize(
    "query, text, n",
    [
        ("NEAR(a b, 1)", "a x b", 1),
        ("NEAR(a b, 1)", "a x y b", 0),
        ("NEAR(b a, 1)", "a x b b", 2),
        ('NEAR("a b" c, 0)', "a b c a c", 1),
        ("NEAR(a b)", "a " + "x " * 10 + "b", 1),
        ("NEAR(a b)", "a " + "x " * 11 + "b", 0),
        ("^a", "a b a", 1),
        ("^b", "a b", 0),
        ("a + b", "a b a c b", 1),
        ('"a" + b*', "a bc a b a d", 2),
    ],
)
def test_search_leaves(spark, query, text, n):
    leaf = search.parse_query(query)
    assert spark.createDataFrame([(text,)], "t string").select(search._hits(search.tokens(F.col("t")), leaf)).first()[0] >= min(n, 1)
    assert bool(spark.createDataFrame([(text,)], "t string").select(search._hits(search.tokens(F.col("t")), leaf)).first()[0]) == bool(n)


@pytest.mark.parametrize("bad", ["NEAR(", "NEAR(a, x)", "^", "a +", "NEAR()"])
def test_search_grammar_errors(bad):
    with pytest.raises(search.QueryError):
        search.parse_query(bad)


def test_parse_selector(spark):
    asked = ["A-SPEC#x*", "S#a", "Big  `Type`", "T.[[Slot]]", "T.open()", "T.o*", "", None, "a#b#c", "#a", "S#"]
    got = spark.createDataFrame([(a,) for a in asked], "t string").select(selectors.parse_selector(F.col("t")).alias("s")).select("s.*").collect()
    assert [tuple(x) for x in got] == [
        ("spec_glob", "a-spec", "x*", None, None), ("anchor", "s", "a", None, None), ("type", None, None, "big type", None), ("field", None, None, "t", "slot"), ("field", None, None, "t", "open"), ("type_glob", None, None, "t", "o*"), *[("invalid", None, None, None, None)] * 5,
    ]


def test_latest_of_chains(spark):
    r = random.Random(1)
    links = {f"r{i}": f"r{i + 1}" for i in range(200)} | {"a": "b", "b": "c", "c": "a", "x": "a"}
    rows = [*links.items(), ("alone", None), (None, "r1")]
    r.shuffle(rows)
    ask = ["r0", "r150", "r200", "a", "x", "alone", "unknown", None]
    got = {x.name: (x.latest, x.hops, x.loops) for x in names.latest_of(spark.createDataFrame(rows, "name string, obsoleted_by string"), spark.createDataFrame([(a,) for a in ask], "name string")).collect()}
    assert got == {"r0": ("r200", 200, False), "r150": ("r200", 50, False), "r200": ("r200", 0, False), "a": ("a", None, True), "x": ("x", None, True), "alone": ("alone", 0, False), "unknown": ("unknown", 0, False)}


def test_writer_lock(spark, tmp_path):
    folder = str(tmp_path / "table")
    one, two = WriterLock(spark, folder), WriterLock(spark, folder)
    with one:
        assert not two.try_claim()
        with pytest.raises(Busy):
            two.claim(wait=0.3, step=0.1)
    assert two.try_claim()
    old = WriterLock(spark, folder, stale_after=0.0)
    time.sleep(0.01)
    assert old.try_claim()  # a stale claim is taken over
    old.release()
    versions = iter([1, 2, 2, 2])
    written = []
    assert publish(lambda: next(versions), lambda: "r", written.append, WriterLock(spark, folder)) and written == ["r"]
    n = iter(range(100))
    assert not publish(lambda: next(n), lambda: "r", written.append, WriterLock(spark, folder)) and written == ["r"]


def test_witness_on_a_long_chain(spark):
    n = 70
    states = spark.createDataFrame([(f"n{i:02d}", "e", n - 1 - i, f"n{i + 1:02d}" if i < n - 1 else None) for i in range(n)], "node string, effect string, distance int, next_node string")
    ways = {x.node: x.path for x in effects.witnesses(states, states.select("node", "effect")).collect()}
    assert ways == {f"n{i:02d}": [f"n{k:02d}" for k in range(i, n)] for i in range(n)}


@pytest.mark.parametrize(
    "text, called",
    [
        ("Run [the steps](https://x/#a) now", True),
        ("See [the steps](https://x/#a), then run it", False),
        ("run one two three four five six [the steps](https://x/#a)", False),
        ("[potentially initialize x](https://x/#a)", True),
        ("given [x initialize](https://x/#a)", False),
        ("applying [y](https://x/#a)", True),
        ("Run [other](https://x/#b) with [the steps](https://x/#a)", True),
        ("Run it", True),
        ("The return value", False),
        (None, None),
    ],
)
def test_calls_are_told_by_the_words_at_the_link(spark, text, called):
    assert spark.createDataFrame([(text,)], "t string").select(effects.calls_in(F.col("t"), F.lit("a"))).first()[0] == called


def test_effect_handles_grow_where_they_meet(spark):
    ids = ["ef_" + "a" * 64, "ef_" + "a" * 20 + "b" * 44, "ef_" + "c" * 64]
    got = {x.effect: x.handle for x in effects.effect_handles(spark.createDataFrame([(i,) for i in ids], "effect string")).collect()}
    assert got == {ids[0]: "ef_" + "a" * 21, ids[1]: "ef_" + "a" * 20 + "b", ids[2]: "ef_" + "c" * 16}


def test_issues_spread_to_callers(spark):
    s = spark.createDataFrame([("a", "e"), ("b", "e"), ("c", "e"), ("d", "e")], "node string, effect string")
    issues = spark.createDataFrame([("c", "missing_spec"), ("d", "witness_budget")], "node string, code string")
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = {x.node: (x.status, x.issues) for x in effects.with_status(s, issues, calls).collect()}
    assert got == {"a": ("partial", "missing_spec"), "b": ("partial", "missing_spec"), "c": ("partial", "missing_spec"), "d": ("complete", "witness_budget")}


def test_step_texts_lose_only_their_last_stops():
    assert normal_step("- *Stop* now!?") == "- stop now" and normal_step("x.y:") == "x.y"
    assert classify("Stop now!", "stop now") == "exact" and classify("x", "?") == "mismatch" and classify("  ", "y") == "exact"


@pytest.mark.parametrize(
    "text, kind, action, defs, writes",
    [
        ("Let *a*, *b* and *c* be parts.", "let", "let", ["a", "b", "c"], []),
        ("Otherwise, set *x*'s [[Y]] to 3.", "otherwise", "set", [], ["Y"]),
        ("If *q*, then increment *n* by 1.", "if", "increment", ["n"], []),
        ("Terminate these steps.", "abort", "abort", [], []),
        ("Run the following steps:", "steps", "steps", [], []),
        ("Increment *o*.[[Count]].", "increment", "increment", [], ["Count"]),
        ("Glow.", "opaque", "opaque", [], []),
        ("", "opaque", "opaque", [], []),
    ],
)
def test_statement_forms(text, kind, action, defs, writes):
    s = statement(text)
    assert (s["kind"], s["action"], s["defs"], s["writes"]) == (kind, action, defs, writes)
    assert (s["reason"] is not None) == (kind == "opaque")


def test_flow_diagram_and_jumps(spark):
    nodes, edges, _ = flow("1. If *a*, then x.\n2. Jump to step 1.\n3. Return to step 9.")
    assert ("2", "1", "jump") in edges and [n[0] for n in nodes] == ["1", "2", "3"]
    rows = [("S", "a", "node", i, n, None, k, t) for i, (n, k, t) in enumerate(nodes)] + [("S", "a", "edge", i, a, z, k, None) for i, (a, z, k) in enumerate(edges)]
    d = graph.flow_mermaid(spark.createDataFrame(rows, "spec string, anchor string, item string, no int, id string, target string, kind string, text string")).first().diagram
    assert d.startswith("flowchart TD\n") and "|jump|" in d and '{"If a, then x."}' in d


def test_select_steps(spark):
    steps = spark.createDataFrame([("S", "a", p) for p in ("1", "1.1", "1.1.1", "1.2", "10", "2")], "spec string, anchor string, step_path string")
    chosen = spark.createDataFrame([("S", "a", "1"), ("S", "a", "1.1")], "spec string, anchor string, path string")
    got = {(x.path, x.step_path) for x in state.select_steps(steps, chosen).collect()}
    assert got == {("1", p) for p in ("1", "1.1", "1.1.1", "1.2")} | {("1.1", "1.1"), ("1.1", "1.1.1")}
    assert {x.step_path for x in state.select_steps(steps, chosen.filter("path = '1'"), 1).collect()} == {"1", "1.1", "1.2"}


def test_clusters_need_a_shared_checkpoint_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(runtime.NoCheckpointFolder):
        runtime._folder(Fake)
    Fake.sparkContext.master = "local[4]"
    assert os.path.isdir(runtime._folder(Fake))


def test_wide_dimensions_are_not_broadcast(spark):
    wide = spark.range(10).select(F.lit("x" * 2000).alias("t"), "id")
    assert runtime.bounded(wide)[1] and not runtime.bounded(wide, most_bytes=10_000)[1] and not runtime.bounded(wide, rows=9)[1]
