"""Pages at any depth below a base."""

from __future__ import annotations

from types import SimpleNamespace

from docweft.operators import coverage, lookup
from docweft.sources.tables import SCHEMAS

SPECS = [(1, "A", "https://a.example/", "p"), (2, "B", "https://b.example/x/", "p"), (3, "C", "https://b.example/x/y", "p"), (4, "b.example", None, "p")]
WANT = {"https://a.example/multipage/page.html#a": "A", "https://b.example/x/multipage/deep/page.html?q#a": "B", "https://b.example/x/y/z/w/page.html#a": "C", "https://b.example/x/yy#a": "B", "https://b.example/x/y#a": "C", "https://b.example/other/p#a": None}


def test_addresses_below_bases(spark):
    specs = spark.createDataFrame(SPECS, SCHEMAS["specs"])
    files = spark.createDataFrame([("f", " ".join(WANT))], "path string, content string")
    assert {r.url: r.spec for r in coverage.scan_addresses(files, specs).collect()} == {k: v for k, v in WANT.items() if v}


def test_targets_below_bases(spark):
    c = SimpleNamespace(tables=SimpleNamespace(specs=spark.createDataFrame(SPECS, SCHEMAS["specs"])))
    rows = [*WANT, "b#x", "https://a.example/multipage/page.html#a", "a#b#c", None]
    got = lookup.resolve_targets(c, spark.createDataFrame([(x,) for x in rows], "target string")).collect()
    assert sorted(((str(r.target), r.spec, r.error) for r in got), key=lambda x: (x[0], x[1] or "")) == sorted([*((k, v, None if v else "spec_not_found") for k, v in WANT.items()), ("b#x", "B", None), (rows[-3], "A", None), ("a#b#c", None, "invalid_target"), ("None", None, "invalid_target")], key=lambda x: (x[0], x[1] or ""))
