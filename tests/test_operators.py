"""Iterative and stateful operators against plain Python, streams and requests."""

from __future__ import annotations

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from docweft.api import Service
from docweft.operators import coverage, diff, effects, graph, state
from docweft.operators.corpus import Corpus
from docweft.sources import html as H
from docweft.sources.export import export
from docweft.sources.tables import SCHEMAS, Tables
from docweft.streaming import refresh

PATH = "/root/testdata/sf0.001"
EDGE = "src string, dst string, ord int, id bigint"


def random_graph(seed, n=18, m=50):
    r = random.Random(seed)
    rows = {}
    for i in range(m):
        a, b = f"S{r.randrange(2)}#n{r.randrange(n):02d}", f"S{r.randrange(2)}#n{r.randrange(n):02d}"
        if a != b:
            rows.setdefault((a, b), (a, b, r.randrange(5), i))
    return list(rows.values())


def queue_walk(edges, root, direction, depth, cap):
    out, into = {}, {}
    for a, b, o, i in edges:
        out.setdefault(a, []).append((o, i, b))
        into.setdefault(b, []).append((a, o, i))
    seen, todo, links, cut = {root: 0}, deque([root]), set(), False
    while todo:
        x = todo.popleft()
        if seen[x] >= depth:
            continue
        steps = [(x, b, b) for _, _, b in sorted(out.get(x, []))] if direction != "incoming" else []
        steps += [(a, x, a) for a, _, _ in sorted(into.get(x, []))] if direction != "outgoing" else []
        for a, b, y in steps:
            links.add((a, b))
            if y not in seen:
                if len(seen) >= cap:
                    cut = True
                else:
                    seen[y] = seen[x] + 1
                    todo.append(y)
    return seen, {(a, b) for a, b in links if a in seen and b in seen}, cut


@pytest.mark.parametrize("direction", ["outgoing", "incoming", "both"])
def test_neighbourhoods(spark, direction):
    edges = random_graph(3)
    e = spark.createDataFrame(edges, EDGE)
    roots = sorted({a for a, *_ in edges})[:5]
    for cap in (1000, 6):
        nodes, links = graph.neighbourhoods(e, spark.createDataFrame([(x,) for x in roots], "id string"), direction, 3, cap)
        got, lk = nodes.collect(), links.collect()
        for x in roots:
            seen, want_links, was_cut = queue_walk(edges, x, direction, 3, cap)
            assert {r.id: r.depth for r in got if r.root == x} == seen, (x, cap)
            assert {(r.src, r.dst) for r in lk if r.root == x} == want_links
            assert {r.truncated for r in got if r.root == x} == {was_cut}
    with pytest.raises(ValueError):
        graph.neighbourhoods(e, nodes.select("id"), direction, 1, 0)


def shuffled_rows(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(s := stages.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.parametrize("direction", ["incoming", "both"])
def test_hub_is_not_opened_for_each_root(spark, direction):
    """60 roots share a node with 3,000 links; the walk to a cap of 6 moves a few rows a link, not 60 times all links."""
    edges = [(f"S#n{i:04d}", "S#hub", 0, i) for i in range(3000)] + [("S#hub", f"S#r{i:02d}", i % 3, 5000 + i) for i in range(60)] + [(f"S#r{i:02d}", "S#hub", 1, 6000 + i) for i in range(60)]
    roots = [f"S#r{i:02d}" for i in range(60)]
    before = shuffled_rows(spark)
    nodes, links = graph.neighbourhoods(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in roots], "id string"), direction, 2, 6)
    got, lk = nodes.collect(), links.collect()
    moved = sum(n for k, n in shuffled_rows(spark).items() if k not in before)
    for x in roots:
        seen, want_links, was_cut = queue_walk(edges, x, direction, 2, 6)
        assert {r.id: (r.depth, r.truncated) for r in got if r.root == x} == {k: (v, was_cut) for k, v in seen.items()}
        assert {(r.src, r.dst) for r in lk if r.root == x} == want_links
    assert moved < 40 * len(edges), moved


def test_neighbourhoods_on_odd_links(spark):
    """Parallel links, links to themselves, a root without links, null ends and roots, a walk within one spec, no cap."""
    edges = random_graph(11)
    edges += [(a, b, o + 1, i + 1000) for a, b, o, i in edges[:8]] + [(edges[0][0], edges[0][0], 0, 2000)]
    e = spark.createDataFrame([*edges, (edges[0][0], None, 0, 3000), (None, edges[0][0], 0, 3001)], EDGE)
    roots = [*sorted({a for a, *_ in edges})[:4], "S0#none"]
    own = [x for x in edges if x[0][:2] == x[1][:2]]
    for cap, same in ((4, False), (4, True), (None, True)):
        nodes, links = graph.neighbourhoods(e, spark.createDataFrame([(x,) for x in [*roots, None, roots[0]]], "id string"), "both", 2, cap, same_spec_only=same)
        got, lk = nodes.collect(), links.collect()
        assert {r.root for r in got} == set(roots)
        for x in roots:
            seen, want_links, was_cut = queue_walk(own if same else edges, x, "both", 2, cap or 1000)
            assert sorted((r.id, r.depth, r.truncated) for r in got if r.root == x) == sorted((k, v, was_cut) for k, v in seen.items())
            assert sorted((r.src, r.dst) for r in lk if r.root == x) == sorted(want_links)


def test_bridges(spark):
    e = spark.createDataFrame([("S#r", "S#m", 0, 1), ("S#m", "S#want", 0, 2), ("S#r", "S#x", 1, 3)], EDGE)
    nodes, links = graph.neighbourhoods(e, spark.createDataFrame([("S#r",)], "id string"), include=["*want"])
    assert {(r.id, r.role) for r in nodes.collect()} == {("S#r", "root"), ("S#m", "bridge"), ("S#want", "matched")}
    assert {(r.src, r.dst) for r in links.collect()} == {("S#r", "S#m"), ("S#m", "S#want")}
    m, d = graph.mermaid(nodes, links).first().diagram, graph.dot(nodes, links).first().diagram
    assert m.startswith("flowchart LR") and m.count("-->") == 2 and d.count("->") == 2


def all_paths(edges, a, b, depth):
    out = {}
    for s, t, o, i in edges:
        out.setdefault(s, []).append((o, i, t))
    found = []

    def walk(x, path, via):
        for o, i, y in sorted(out.get(x, [])):
            if y == b:
                found.append(via + [i])
            elif y not in path and len(via) + 1 < depth:
                walk(y, path | {y}, via + [i])

    walk(a, {a}, [])
    return found


def test_paths(spark):
    edges = random_graph(8, 10, 40)
    edges += [(a, b, o + 1, i + 1000) for a, b, o, i in edges[:5]]  # parallel links
    names = sorted({x for e in edges for x in e[:2]})
    pairs = [(a, b) for a in names[:4] for b in names[-4:]] + [(names[0], names[0])]
    p = spark.createDataFrame(pairs, "source string, target string")
    got = graph.simple_paths(spark.createDataFrame(edges, EDGE), p, 4, 1000).collect()
    first = graph.simple_paths(spark.createDataFrame(edges, EDGE), p, 4, 3).collect()
    for a, b in pairs:
        want = all_paths(edges, a, b, 4) if a != b else []
        assert sorted(list(r.via) for r in got if (r.source, r.target) == (a, b)) == sorted(want)
        few = sorted((r for r in first if (r.source, r.target) == (a, b)), key=lambda r: r.path_no)
        assert [list(r.via) for r in few] == sorted(want[:3], key=len)


def test_closure(spark):
    links = spark.createDataFrame([("a", "b", 5), ("a", "c", 9), ("c", "d", 1), ("b", "a", 1), ("d", "e", 1)], "src string, dst string, n bigint")
    got = graph.closure(links, spark.createDataFrame([("a",)], "id string"), 4).orderBy("rank").collect()
    assert [(r.id, r.depth) for r in got] == [("a", 0), ("c", 1), ("b", 1), ("d", 2)]


def test_propagation_and_witnesses(spark):
    r = random.Random(2)
    edges = [(f"n{r.randrange(12)}", f"n{r.randrange(12)}", r.randrange(3)) for _ in range(30)]
    local = [(f"n{r.randrange(12)}", f"e{r.randrange(3)}") for _ in range(5)]
    blocked = [(edges[0][0], edges[0][1], "e0")]
    want = {(n, e, 0) for n, e in local}
    while True:
        more = {(a, e, max(x, y)) for a, b, x in edges for n, e, y in want if n == b and (a, b, e) not in blocked} - want
        if not more:
            break
        want |= more
    ed, lo = spark.createDataFrame(edges, "src string, dst string, exec int"), spark.createDataFrame(local, "node string, effect string")
    states = effects.propagate(ed, lo, spark.createDataFrame(blocked, "src string, dst string, effect string"))
    assert {(s.node, s.effect, s.exec) for s in states.collect()} == want
    ways = effects.witnesses(states, states.select("node", "effect")).collect()
    assert {(w.node, w.effect) for w in ways} == {(n, e) for n, e, _ in want}
    for w in ways:
        assert (w.path[-1], w.effect) in set(local) and w.path[0] == w.node
        assert all((a, b) in {(x, y) for x, y, _ in edges} for a, b in zip(w.path, w.path[1:]))
    assert effects.propagate(ed, lo, max_states=1).first().partial


def test_rules_specialise(spark):
    rules = [effects.Rule("g", "event.fire", "fire", {"name": None}), effects.Rule("s", "event.fire", "fire an event named (\\w+)", {"name": "$1"}), effects.Rule("x", "script.invoke", "fire", exclude="event")]
    steps = spark.createDataFrame([("S", "a", 0, "1", "fire an event named load"), ("S", "a", 1, "2", "fire it"), ("S", "b", 0, "1", "nothing")], "spec string, anchor string, step_no int, step_path string, text string")
    got = {(r.step_path, r.kind, r.params, tuple(r.rule_ids)) for r in effects.match_rules(steps, rules).collect()}
    assert got == {("1", "event.fire", '{"name":"load"}', ("g", "s")), ("2", "event.fire", '{"name":null}', ("g",)), ("2", "script.invoke", "{}", ("x",))}
    a = spark.createDataFrame([("n", "e1", "x"), ("n", "e2", "y")], "node string, effect string, params string")
    b = spark.createDataFrame([("n", "e1", "x"), ("n", "e3", "z")], "node string, effect string, params string")
    assert {(r.effect, r.action) for r in effects.publication_diff(a, b).collect()} == {("e2", "delete"), ("e3", "upsert")}


def test_types(spark):
    edges = spark.createDataFrame([("a", "b", 0, 1), ("a", "m", 1, 2), ("b", "c", 0, 1), ("m", "c", 0, 1), ("c", "a", 0, 1)], "type_key string, super_key string, basis int, pos int")
    above = state.supertypes(edges, spark.createDataFrame([("a",)], "type_key string"))
    assert [(r.type_key, r.depth) for r in above.orderBy("rank").collect()] == [("a", 0), ("b", 1), ("m", 1), ("c", 2)]
    fields = spark.createDataFrame([("c", "f", "f", "attribute", "S", "c-f", "C.f"), ("m", "g", "g", "attribute", "S", "m-g", "M.g"), ("b", "g", "g", "method", "S", "b-g", "B.g")], "owner_key string, field_key string, name string, kind string, spec string, anchor string, canonical_name string")
    wanted = spark.createDataFrame([("a", "f"), ("a", "g"), ("a", "none")], "root string, field_key string")
    got = {(r.field_key, r.depth, r.result) for r in state.lookup_fields(above, fields, wanted).collect()}
    assert got == {("f", 2, "found"), ("g", 1, "ambiguous")}
    assert {(r.name, r.owner_key, r.inherited) for r in state.type_views(above, fields).collect()} == {("f", "c", 1), ("g", "b", 1)}


def test_omitted_runs(spark):
    paths = ["1", "2", "2.1", "2.2", "3", "4", "5"]
    steps = spark.createDataFrame([("S", "a", i, p, p.rpartition(".")[0] or None) for i, p in enumerate(paths)], "spec string, anchor string, step_no int, step_path string, parent_path string")
    kept = spark.createDataFrame([("S", "a", "1"), ("S", "a", "4")], "spec string, anchor string, step_path string")
    got = {(r.parent_path, r.first_path, r.last_path, r.n_steps) for r in state.omitted_runs(steps, kept).collect()}
    assert got == {(None, "2", "3", 4), (None, "5", "5", 1)}


def test_coverage(spark):
    specs = spark.createDataFrame([(1, "A", "https://a.example/", "p"), (2, "B", "https://b.example/x/", "p")], SCHEMAS["specs"])
    files = spark.createDataFrame([("f", "// https://a.example/#run\n// Step 2. Return it\n// Step 1. Let x be 1\n// Step 9. Nothing\nsee https://b.example/x/page.html#y, and https://c.example/#z")], "path string, content string")
    found = {(r.match_no, r.spec, r.anchor) for r in coverage.scan_addresses(files, specs).collect()}
    assert found == {(0, "A", "run"), (1, "B", "y")}
    steps = spark.createDataFrame([("A", "run", "1", "Let x be 1.", 0), ("A", "run", "2", "Return it.", 1), ("A", "run", "3", "Stop.", 2)], "spec string, anchor string, step_path string, text string, step_no int")
    scanned = coverage.scan_sources(files).filter("what = 'step' and url is not null").select("path", "line", "number", "text", F.lit("A").alias("spec"), F.lit("run").alias("anchor"))
    checked = coverage.validate(scanned, steps, None)
    assert {(r.number, r.verdict) for r in checked.collect()} == {("1", "exact"), ("2", "exact"), ("9", "not_found")}
    c = coverage.coverage(checked, steps).first()
    assert (c.n_steps, c.n_implemented, c.n_missing, c.n_warnings, c.n_reordered) == (3, 2, 1, 1, 1)
    assert [r.step_path for r in coverage.missing_steps(checked, steps).collect()] == ["3"]


def test_pages_to_tables(spark):
    pages = spark.createDataFrame([("A", "https://a.example/", "<h2 id=x>X</h2><p><a href='https://b.example/#y'>y</a>"), ("A", "https://a.example/", None)], "spec string, base_url string, html string")
    rows = H.extract_pages(pages, {"https://b.example/": "B"})
    assert H.items(rows, "section").first().anchor == "x"
    r = H.items(rows, "ref").first()
    assert (r.from_anchor, r.to_spec, r.to_anchor, r.kind) == ("x", "B", "y", "prose")


def test_upsert_and_row_diff(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1), (4, None, None)], "id int, t string, s int")
    new = spark.createDataFrame([(1, "a", 2), (2, "B", 1), (5, "e", 1), (4, None, None)], "id int, t string, s int")
    assert {(r.id, r.action) for r in diff.diff_rows(old, new, ["id"], ["t"], ["s"]).collect()} == {(1, "restructure"), (2, "update"), (3, "delete"), (4, "keep"), (5, "insert")}
    got = diff.upsert(old, new.unionByName(spark.createDataFrame([(1, "z", 9)], new.schema)), ["id"], ["s"])
    assert {(r.id, r.t) for r in got.collect()} == {(1, "z"), (2, "B"), (3, "c"), (4, None), (5, "e")}


def test_refresh(spark):
    checks = spark.createDataFrame([(1, "2021-01-01", "8"), (2, "2021-01-03", "8"), (3, "2021-01-03", None), (4, None, "8")], "spec_id bigint, t string, index_version string").select("spec_id", F.to_timestamp("t").alias("last_checked"), "index_version")
    got = {r.spec_id: r.is_due for r in refresh.due(checks, F.to_timestamp(F.lit("2021-01-03 01:00:00")), "8").collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1}
    f = spark.createDataFrame([(304, "a", None), (200, "a", "a"), (200, "a", "b"), (500, "a", "b"), (None, "a", "a")], "s int, o string, n string")
    assert [r[0] for r in f.select(refresh.freshness(F.col("s"), F.col("o"), F.col("n"))).collect()] == ["not_modified", "same_content", "changed", "failed", "failed"]
    full = spark.createDataFrame([(1, None, None, "h", "7", "e", None, None), (2, None, None, "g", "7", None, None, None)], SCHEMAS["update_checks"])
    out = spark.createDataFrame([(1, "changed", "h2", "e2", None), (2, "failed", None, None, None), (3, "changed", "k", None, None)], "spec_id bigint, outcome string, content_hash string, etag string, last_modified string")
    after = {r.spec_id: r for r in refresh.after_check(full, out, F.to_timestamp(F.lit("2021-01-01")), "8").collect()}
    assert (after[1].content_hash, after[1].index_version, after[1].etag) == ("h2", "8", "e2") and after[3].content_hash == "k"


def test_stream(spark, tmp_path):
    schema = "id bigint, t string, v int"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "A", 2)], schema).coalesce(1).write.parquet(src)
    told = []

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        refresh.apply_deliveries(stream, out, str(tmp_path / "cp"), ["id"], ["t"], ["v"], lambda d, i: told.append({(r.id, r.action) for r in d.collect()})).awaitTermination()
        return {(r.id, r.t) for r in refresh.current_version(spark, out).collect()}

    assert run() == {(1, "A"), (2, "b")}
    spark.createDataFrame([(2, "b", 3), (3, "c", 1)], schema).coalesce(1).write.mode("append").parquet(src)
    assert run() == {(1, "A"), (2, "b"), (3, "c")}
    assert told == [{(1, "insert"), (2, "insert")}, {(3, "insert")}]
    assert run() == {(1, "A"), (2, "b"), (3, "c")}
    twice = refresh.new_contents(spark.createDataFrame([(1, "x y"), (1, "x  y"), (2, "x y")], "spec bigint, content string"))
    assert twice.count() == 2


def test_requests(spark):
    s = Service(spark, PATH)
    ask = lambda **x: json.loads(s.handle_json(json.dumps(x)))
    spec = ask(type="specs")["result"][0]["spec"]
    head = ask(type="list", spec=spec.lower())["result"][0]["anchor"]
    target = f"{spec.lower()}#{head}"
    assert ask(type="query", target=target)["result"]["anchor"] == head
    assert ask(type="exists", target=target)["result"]["exists_now"] == 1
    assert ask(type="exists", target=f"{spec}#nothing")["result"]["exists_now"] == 0
    assert ask(type="search", query="the")["result"][0]["rank_no"] == 1
    assert ask(type="anchors", pattern="*-*", limit=3)["result"]
    assert "nodes" in ask(type="graph", target=target)["result"]
    assert "outgoing" in ask(type="refs", target=target)["result"]
    assert ask(type="trace", **{"from": target, "to": f"{spec}#nothing"})["result"] == []
    for bad, code in (({"type": "nope"}, "invalid_request"), ({"type": "query", "target": "a#b#c"}, "invalid_request"), ({"type": "query", "target": "nope#x"}, "spec_not_indexed"), ({"type": "query", "target": f"{spec}#nothing"}, "not_found"), ({"type": "graph", "target": target, "max_nodes": 0}, "invalid_request"), ({"type": "query", "what": 1}, "invalid_request")):
        assert ask(**bad)["error"]["code"] == code
    assert json.loads(s.handle_json("{"))["error"]["code"] == "invalid_request"


def test_export(spark, tmp_path):
    c = Corpus(Tables(spark, PATH))
    m = export(c, str(tmp_path / "x"), file_rows=50).collect()
    assert all(r.bytes > 0 and len(r.sha256) == 64 for r in m)
    copy = Tables(spark, str(tmp_path / "x"))
    assert copy.snapshots.filter("pr_number is not null").count() == 0
    assert copy.sections.join(copy.snapshots.withColumnRenamed("id", "sid"), F.col("snapshot_id") == F.col("sid"), "left_anti").count() == 0
    with pytest.raises(ValueError):
        export(c, str(tmp_path / "y"), most_bytes=10)


def test_names(spark):
    from docweft.functions import names as N

    rows = spark.createDataFrame([("rfc0791",), ("RFC9110",), ("draft-x-y-02",), ("draft-x",), ("g.711.1",), ("rfcx",)], "n string")
    n = F.col("n")
    got = [tuple(r) for r in rows.select(N.is_ietf(n), N.canonical_ietf(n), N.pinned_revision(n), N.is_itu(n), N.canonical_itu(n)).collect()]
    assert [g[1] for g in got[:4]] == ["RFC791", "RFC9110", "draft-x-y", "draft-x"] and [g[2] for g in got[:4]] == [None, None, "02", None]
    assert [g[0] for g in got] == [True, True, True, True, False, False] and got[4][3:] == (True, "G.711.1")


def test_unlinked(spark):
    sites = spark.createDataFrame([("A.x", "opaque", "n", "1", "Frob the big Name now"), ("A.name", "opaque", "n", "2", "Frob the name")], "field string, class string, node string, step_path string, text string")
    names = spark.createDataFrame([("A.name", "name"), ("A.big", "`big`  name")], "field string, name string")
    want = {("A.name", "n", "1"), ("A.big", "n", "1")}
    for most in (10, 1):
        assert {tuple(r) for r in state.possible_unlinked(sites, names, most).collect()} == want


def test_unlinked_steps(spark):
    steps = [("S", "n", "1", "Frob the name.", "opaque", [], []), ("S", "n", "2", "Frob *x*.[[name]], renamed.", "opaque", [], ["name"]), ("S", "n", "3", "Frob the names and the open() of it", "opaque", [], []), ("S", "n", "4", "Return the name", "return", [], []), ("S", "n", "5", "Mark a big name-tag", "opaque", [], []), ("S", "n", "6", "Use ++ here", "opaque", [], [])]
    df = spark.createDataFrame(steps, "spec string, anchor string, step_path string, text string, kind string, writes array<string>, reads array<string>")
    names = spark.createDataFrame([("A.name", "name"), ("B.name", "Name"), ("A.big", "big name"), ("A.open", "open()"), ("A.plus", "++"), ("A.am", "am")], "field string, name string")
    want = {("A.name", "S#n", "1"), ("B.name", "S#n", "1"), ("A.open", "S#n", "3"), ("A.name", "S#n", "5"), ("B.name", "S#n", "5"), ("A.big", "S#n", "5"), ("A.plus", "S#n", "6")}
    for most in (10_000, 1):
        assert {tuple(r) for r in state.possible_unlinked(df, names, most).collect()} == want


def test_store(spark, tmp_path):
    from docweft.sources import store

    path = str(tmp_path / "sections")
    rows = spark.createDataFrame([(f"S{i % 9}", f"a{i % 20}", i % 3, i) for i in range(200)], "spec string, anchor string, ord int, v int")
    store.write_table(rows, path, keys=["spec", "anchor"], order=["ord", "v"])
    whole = spark.read.parquet(path)
    assert whole.count() == rows.select("spec", "anchor").distinct().count()
    one = store.read_specs(spark, path, ["S3"])
    assert {r.spec for r in one.collect()} == {"S3"}
    assert "spec_bucket" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]
    before = {tuple(r) for r in whole.drop("spec_bucket").collect()}
    store.replace_specs(spark.createDataFrame([("S3", "new", 0, 1), ("S4", "no", 0, 1)], rows.schema), spark.createDataFrame([("S3",), ("S5",)], "spec string"), path)
    after = {tuple(r) for r in spark.read.parquet(path).drop("spec_bucket").collect()}
    assert after == {r for r in before if r[0] not in ("S3", "S5")} | {("S3", "new", 0, 1)}
    arrays = spark.createDataFrame([("S", [("x",), ("y",)])], "spec string, items array<struct<anchor:string>>")
    assert [(r.ord, r.anchor) for r in store.with_ord(arrays, "items", ["spec"]).collect()] == [(0, "x"), (1, "y")]
