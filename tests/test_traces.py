"""Traces over all references against brute force."""

from __future__ import annotations

import random

import __spark_entry__ as entry
from docweft.operators import graph
from tests.test_operators import EDGE, all_paths, random_graph
from tests.test_whole import corpus


def test_traces(spark):
    edges = random_graph(8, 8, 24)
    edges += [(a, b, o + 1, i + 1000) for a, b, o, i in edges[:4]]  # parallel links
    names = sorted({x for e in edges for x in e[:2]})
    sources, targets = names[:6], names[4:]
    got = graph.traces(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in sources], "id string"), spark.createDataFrame([(x,) for x in targets], "id string"), 6).collect()
    for a in sources:
        for b in targets:
            mine = sorted((r for r in got if (r.source, r.target) == (a, b)), key=lambda r: r.path_no)
            assert [list(r.via) for r in mine] == (sorted(all_paths(edges, a, b, 6), key=len) if a != b else [])
            assert [r.path_no for r in mine] == list(range(1, len(mine) + 1))


def test_trace_paths(spark, tmp_path):
    r = random.Random(4)
    texts = {x: "1. Run it." for x in "abcdefgh"}
    chain = list(zip("abcdefg", "bcdefgh"))  # h lies 7 links from a
    links = [(a, b, "1", "Run it.") for a, b in [*chain, ("a", "b"), ("c", "a"), *((r.choice("abc"), r.choice("abc")) for _ in range(3)), ("a", "a")]]
    path = corpus(spark, str(tmp_path / "t"), texts, links)
    edges = [(f"S#{a}", f"S#{b}", i, i) for i, (a, b, _, _) in enumerate(links) if a != b]
    want = {(f"S#{a}", f"S#{b}", " ".join(map(str, via))) for a in texts for b in texts if a != b for via in all_paths(edges, f"S#{a}", f"S#{b}", 6)}
    assert {(x.source, x.target, x.via) for x in entry.queries()["trace_paths"](spark, path).collect()} == want
    assert {len(v.split()) for _, _, v in want} == set(range(1, 7))
