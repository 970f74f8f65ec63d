"""The general operators against plain Python on small dirty tables, and their edge cases."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from docweft.operators.hierarchy import descendants, hierarchies, in_subtree
from docweft.operators.references import hot_targets, orphan_references, orphan_report, target_profile
from docweft.operators.snapshots import attribute_history, full_snapshots, snapshot_changes
from docweft.sources.tables import SCHEMAS, empty

SECTION = SCHEMAS["sections"]
SNAPSHOT = SCHEMAS["snapshots"]
REF = SCHEMAS["refs"]


def section(i, snap, anchor, text=None, ord_=0, parent=None, depth=None):
    return (i, snap, anchor, None, text, "prose", parent, None, None, depth, None, ord_)


def snapshot(i, spec, sha, date, pr=None):
    return (i, spec, sha, date, None, 0, pr, None, None, None)


def ref(i, snap, to_spec, to_anchor, kind="step", frm="a"):
    return (i, snap, frm, to_spec, to_anchor, None, None, None, None, kind, 0)


def same(text):
    t = re.sub(r"[ \t\r\n]+", " ", text or "").strip(" ")
    return re.sub(r"\]\([^)#]*#", "](#", t)


def dirty(seed, n_specs=3, n_snaps=14, anchors="abcdefgh"):
    r = random.Random(seed)
    snaps, secs, sid = [], [], 1
    texts = ["x", " x ", "x\n\n y", "x y", None, "", "[l](http://a/#q)", "[l](https://b.c/d#q)", "[l](#q)", "long " * 3000]
    for i in range(1, n_snaps + 1):
        hour, offset = r.randrange(1, 20), r.choice(["Z", "+02:00", "-07:00", ".250Z"])
        snaps.append(snapshot(i, r.randrange(1, n_specs + 1), r.choice(["aa", "AA", f"s{i}", f"s{i}", f"s{i}", None]), r.choice([f"2021-01-{r.randrange(1, 9):02d}T{hour:02d}:00:00{offset}", None, "soon"] if r.random() < 0.2 else [f"2021-01-{r.randrange(1, 9):02d}T{hour:02d}:00:00{offset}"]), r.choice([None, None, None, 7])))
        if r.random() < 0.85:
            for a in anchors:
                for _ in range(r.choice([0, 1, 1, 1, 2])):
                    secs.append(section(sid, i, a, r.choice(texts), r.choice([0, 0, 1, None]), r.choice([*anchors, None, "gone"])))
                    sid += 1
    secs.append(section(sid, None, "a", "x"))
    secs.append(section(sid + 1, 1, None, "x"))
    r.shuffle(secs)
    return snaps, secs


def instant(date):
    try:
        return datetime.fromisoformat((date or "").replace("Z", "+00:00")).astimezone(timezone.utc)
    except ValueError:
        return datetime(1, 1, 1, tzinfo=timezone.utc)


def full_order(snaps, secs):
    have = {s[1] for s in secs if s[1] is not None}
    first = {}
    for s in sorted(snaps):
        if s[6] is None:
            first.setdefault((s[1], s[2].lower() if s[2] is not None else s[0]), s)
    out = defaultdict(list)
    for s in sorted((x for x in first.values() if x[0] in have), key=lambda x: (instant(x[3]), x[0])):
        out[s[1]].append(s)
    return out


def picked(secs):
    big = 2**40
    best = {}
    for s in secs:
        if s[1] is not None and s[2] is not None:
            k = (s[11] if s[11] is not None else big, s[0])
            if (s[1], s[2]) not in best or k < best[s[1], s[2]][0]:
                best[s[1], s[2]] = (k, s)
    return {k: v[1] for k, v in best.items()}


@pytest.mark.parametrize("seed", range(3))
def test_changes_and_history(spark, seed):
    snaps, secs = dirty(seed)
    sn, se = spark.createDataFrame(snaps, SNAPSHOT), spark.createDataFrame(secs, SECTION)
    order, rows = full_order(snaps, secs), picked(secs)
    want, versions = set(), set()
    for spec, line in order.items():
        anchors = {a for s, a in rows if s in {x[0] for x in line}}
        for a in anchors:
            for x, y in zip(line, line[1:]):
                o, n = rows.get((x[0], a)), rows.get((y[0], a))
                kind = "added" if n and not o else "removed" if o and not n else "changed" if o and n and same(o[4]) != same(n[4]) else None
                if kind:
                    want.add((spec, x[0], y[0], a, kind))
            run = None
            for x in [*line, None]:
                t = same(rows[x[0], a][4]) if x and (x[0], a) in rows else None
                if run and (t is None or t != run[2]):
                    versions.add((spec, a, run[0], run[1]))
                    run = None
                if t is not None:
                    run = [run[0] if run else x[0], x[0], t]
    assert want
    got = snapshot_changes(se, sn).select("spec_id", "from_snapshot_id", "to_snapshot_id", "anchor", "change").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    for block in (512, 2):
        h = attribute_history(se, sn, block=block).select("spec_id", "anchor", "first_snapshot_id", "last_snapshot_id").collect()
        assert sorted(map(tuple, h)) == sorted(versions), block


def test_history_periods(spark):
    sn = spark.createDataFrame([snapshot(1, 1, "a", "2021-01-01T00:00:00Z"), snapshot(2, 1, "b", "2021-01-02T00:00:00Z"), snapshot(3, 1, "c", "2021-01-01T12:00:00+01:00")], SNAPSHOT)
    se = spark.createDataFrame([section(1, 1, "x", "t"), section(2, 3, "x", "t"), section(3, 2, "y", "u")], SECTION)
    rows = {r.anchor: r for r in attribute_history(se, sn).collect()}
    assert (rows["x"].first_snapshot_id, rows["x"].last_snapshot_id, rows["x"].n_snapshots, rows["x"].is_current) == (1, 3, 2, False)
    assert rows["x"].valid_to == rows["y"].valid_from and rows["y"].valid_to is None and rows["y"].is_current


def test_empty_tables(spark):
    t = {n: empty(spark, n) for n in ("sections", "snapshots", "specs", "refs", "shared_anchors")}
    assert snapshot_changes(t["sections"], t["snapshots"]).count() == 0
    assert attribute_history(t["sections"], t["snapshots"]).count() == 0
    assert hierarchies(t["sections"]).count() == 0
    assert hot_targets(t["refs"], 20).count() == 0 and target_profile(t["refs"]).count() == 0
    o = orphan_references(t["refs"], t["sections"], t["snapshots"], t["specs"], t["shared_anchors"])
    assert o.count() == 0 and orphan_report(o, t["snapshots"], t["specs"]).count() == 0


def test_extra_columns_with_names_used_inside(spark):
    snaps, secs = dirty(1)
    names = ["spec_id", "seq", "instant", "digest", "block", "side", "s", "_k", "spec", "t", "part", "h1", "level", "loop", "_sha", "next_id", "prev_id", "kind"]
    sn, se = spark.createDataFrame(snaps, SNAPSHOT), spark.createDataFrame(secs, SECTION)
    se2 = se.select("*", *[F.lit("z").alias(n) for n in names])
    sn2 = sn.select("*", *[F.lit("z").alias(n) for n in names if n != "spec_id"])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(snapshot_changes(se, sn)) == key(snapshot_changes(se2, sn2))
    assert key(attribute_history(se, sn)) == key(attribute_history(se2, sn2))
    assert key(hierarchies(se)) == key(hierarchies(se2))
    rf = spark.createDataFrame([ref(1, 1, "S1", "a"), ref(2, 1, "s2", "zz")], REF)
    rf2 = rf.select("*", *[F.lit("z").alias(n) for n in names if n != "kind"])
    sp = spark.createDataFrame([(1, "S1", "b", "p"), (2, "S2", "b", "p")], SCHEMAS["specs"])
    sh = empty(spark, "shared_anchors")
    assert key(orphan_references(rf, se, sn, sp, sh)) == key(orphan_references(rf2, se2, sn2, sp.withColumn("spec_id", F.lit(9)), sh))
    assert key(target_profile(rf)) == key(target_profile(rf2))
    with pytest.raises(ValueError):
        hierarchies(se2, keep=("level",))


def test_repeated_rows_change_nothing(spark):
    snaps, secs = dirty(2)
    specs = [(1, "S1", "b", "p"), (2, "S2", "b", "p"), (3, "S3", "b", "p")]
    refs = [ref(i, 1 + i % 14, f"s{1 + i % 3}", "abcdxyz"[i % 7]) for i in range(60)]
    make = lambda k: [spark.createDataFrame(d * k, SCHEMAS[n]) for d, n in ((refs, "refs"), (secs, "sections"), (snaps, "snapshots"), (specs, "specs"))]
    (r1, se1, sn1, sp1), (_, se2, sn2, sp2) = make(1), make(2)
    key = lambda df: sorted(map(str, df.collect()))
    sh = empty(spark, "shared_anchors")
    assert key(snapshot_changes(se1, sn1)) == key(snapshot_changes(se2, sn2))
    assert key(attribute_history(se1, sn1)) == key(attribute_history(se2, sn2))
    assert key(hierarchies(se1)) == key(hierarchies(se2))
    one, two = (orphan_references(r1, se, sn, sp, sh) for se, sn, sp in ((se1, sn1, sp1), (se2, sn2, sp2)))
    assert key(one) == key(two) and key(orphan_report(one, sn1, sp1)) == key(orphan_report(two, sn2, sp2))


def test_full_snapshots_least_id_counts_even_without_sections(spark):
    sn = spark.createDataFrame([snapshot(1, 1, "AB", "2021-01-01T00:00:00Z"), snapshot(2, 1, "ab", "2021-01-02T00:00:00Z")], SNAPSHOT)
    se = spark.createDataFrame([section(1, 2, "x", "t")], SECTION)
    assert full_snapshots(sn, se).count() == 0


# ---- hierarchies ---------------------------------------------------------------------------------------------------


def walk_up(rows):
    """anchor -> (path, None) or (None, least anchor of the loop)."""
    out = {}
    for a in rows:
        path, at = [a], rows[a]
        while at is not None and at in rows and at not in path:
            path.append(at)
            at = rows[at]
        out[a] = (None, min(path[path.index(at) :])) if at in rows else (path[::-1], None)
    return out


@pytest.mark.parametrize("limit", [200_000, 3])
def test_hierarchies(spark, limit):
    r = random.Random(limit)
    secs, want = [], {}
    for g in range(1, 9):
        names = [f"n{i}" for i in range(r.choice([1, 5, 12]))]
        rows = {a: r.choice([*names, None, "gone"] if g % 2 else [names[max(0, i - 1)] if i else None]) for i, a in enumerate(names)}
        for i, a in enumerate(names):
            secs.append(section(len(secs) + 1, g, a, None, r.randrange(3), rows[a]))
        secs.append(section(len(secs) + 1, g, names[0], None, 9, names[-1]))  # a later row of an anchor counts for nothing
        want |= {(g, a): v for a, v in walk_up(rows).items()}
    se = spark.createDataFrame(secs, SECTION)
    got = hierarchies(se, keep=("depth",), group_rows=limit).collect()
    assert len(got) == len(want)
    kids = defaultdict(set)
    for (g, a), (path, _) in want.items():
        for p in (path or [])[:-1]:
            kids[g, p].add(a)
    starts = defaultdict(dict)
    for x in got:
        path, loop = want[x.snapshot_id, x.anchor]
        assert x.path == path and x.loop == loop, x
        if path:
            assert (x.level, x.root, x.subtree_size) == (len(path) - 1, path[0], 1 + len(kids[x.snapshot_id, x.anchor]))
            starts[x.snapshot_id][x.range_start] = x.anchor
    for x in got:
        if x.level is not None:
            assert {starts[x.snapshot_id][i] for i in range(x.range_start + 1, x.range_end + 1)} == kids[x.snapshot_id, x.anchor]
    loops = hierarchies(se, with_path=False, only_loops=True, group_rows=limit).collect()
    assert {(x.snapshot_id, x.anchor, x.loop) for x in loops} == {(*k, v[1]) for k, v in want.items() if v[1]}
    tree = hierarchies(se, group_rows=limit)
    pairs = {(x.snapshot_id, x.ancestor, x.descendant) for x in descendants(tree).collect()}
    assert pairs == {(g, p, a) for (g, p), s in kids.items() for a in s}
    assert {(x.snapshot_id, x.ancestor, x.descendant) for x in in_subtree(tree, se.select("snapshot_id", "anchor")).collect()} == pairs


def test_deep_chain_and_long_loop(spark):
    n = 3000
    chain = [section(i, 1, f"c{i:05d}", None, 0, f"c{i - 1:05d}" if i else None) for i in range(n)]
    loop = [section(n + i, 2, f"é{i:05d}", None, 0, f"é{(i + 1) % n:05d}") for i in range(n)]
    got = hierarchies(spark.createDataFrame(chain + loop, SECTION), with_path=False)
    assert got.filter("snapshot_id = 1").agg({"level": "max"}).first()[0] == n - 1
    assert got.filter("snapshot_id = 2 and loop = 'é00000' and on_loop").count() == n


def test_siblings_without_order_come_last_in_groups_of_any_size(spark):
    rows = [(1, 1, "r", None, 0), (2, 1, "b", "r", 5), (3, 1, "a", "r", None), (2**60 + 1, 1, "c", "r", 7), (2**60, 1, "d", "r", 7), (None, 1, "e", "r", None)]
    se = spark.createDataFrame(rows, "id bigint, snapshot_id bigint, anchor string, parent_anchor string, ord int")
    for n in (200_000, 1):
        got = {x.anchor: (x.range_start, x.range_end, x.level) for x in hierarchies(se, group_rows=n).collect()}
        assert got == {"r": (0, 5, 0), "b": (1, 1, 1), "d": (2, 2, 1), "c": (3, 3, 1), "a": (4, 4, 1), "e": (5, 5, 1)}, n


def test_large_chain_by_doubling(spark):
    n = 4000
    name = lambda c: F.format_string("c%06d", c)
    chain = spark.range(n).select("id", F.lit(1).alias("snapshot_id"), name(F.col("id")).alias("anchor"), F.when(F.col("id") > 0, name(F.col("id") - 1)).alias("parent_anchor"), F.lit(0).alias("ord"))
    loop = spark.range(n).select("id", F.lit(2).alias("snapshot_id"), name(F.col("id")).alias("anchor"), F.when(F.col("id") >= 900, name((F.col("id") + 1))).otherwise(name(F.col("id") + 1)).alias("parent_anchor"), F.lit(0).alias("ord"))
    loop = loop.withColumn("parent_anchor", F.when(F.col("id") == n - 1, name(F.lit(3000))).otherwise(F.col("parent_anchor")))
    got = hierarchies(chain.unionByName(loop), with_path=False, group_rows=1000)
    one = got.filter("snapshot_id = 1").agg(F.max("level"), F.sum("subtree_size"), F.count_if((F.col("range_start") == F.col("level")) & (F.col("range_end") == n - 1))).first()
    assert tuple(one) == (n - 1, n * (n + 1) // 2, n)
    two = got.filter("snapshot_id = 2").groupBy("on_loop", "loop").count().collect()
    assert {(x.on_loop, x.loop, x["count"]) for x in two} == {(True, "c003000", 1000), (False, "c003000", 3000)}


# ---- references ----------------------------------------------------------------------------------------------------


def test_targets_and_hot_ones(spark):
    rows = [ref(i, i % 3, " Core", "#a%20b" if i % 2 else "a b", "Step" if i % 4 else None, f"f{i % 5}") for i in range(60)]
    rows += [ref(100 + i, 1, "core", f"x{i}") for i in range(38)] + [ref(200, 1, None, None), ref(201, 1, "core", "100%+%zz")]
    r = spark.createDataFrame(rows, REF)
    top = hot_targets(r, 20).collect()
    assert [(x.to_spec, x.to_anchor, x.n_refs) for x in top] == [("core", "a b", 60)]
    p = {(x.to_spec, x.to_anchor): x for x in target_profile(r).collect()}
    hot = p["core", "a b"]
    assert (hot.n_refs, hot.n_step, hot.n_other, hot.n_sections, hot.n_snapshots) == (60, 45, 15, 15, 3)
    assert p[None, None].n_refs == 1 and ("core", "100%+%zz") in p
    assert sum(x.n_refs for x in p.values()) == 100


@pytest.mark.parametrize("seed", range(3))
def test_orphans(spark, seed):
    snaps, secs = dirty(seed, n_snaps=18)
    r = random.Random(seed)
    specs = [(1, "S-One", "b", "p"), (2, "S-Two", "b", "p"), (3, "S-Three", "b", "p"), (4, "Never", "b", "p")]
    shared = [("OTHER", "k", None), ("s-one", "kept", None), (None, "x", None)]
    refs = [ref(i, r.choice([*range(1, 19), 99, None]), r.choice([" s-one", "S-TWO", "s-three ", "never", "unknown", "other", None]), r.choice(["a", "#b", "c", "d", "zz", "k", "kept", None])) for i in range(400)]
    refs += [ref(1000 + i, 1, "s-two", "zz") for i in range(300)]  # a hot target
    order, rows = full_order(snaps, secs), picked(secs)
    by_id = {s[0]: s for s in snaps}
    name = {n.lower(): i for i, n, *_ in specs}
    have = {(s, a) for s, a in rows}
    want = {}
    for x in refs:
        spec, anchor = (x[3] or "").strip().lower(), (x[4] or "").removeprefix("#")
        if (spec, anchor) in {("other", "k"), ("s-one", "kept")}:
            continue
        own = by_id.get(x[1])
        t = instant(own[3]) if own else datetime(1, 1, 1, tzinfo=timezone.utc)
        line = order.get(name.get(spec), []) if x[3] is not None and x[4] is not None else []
        before = [s for s in line if instant(s[3]) <= t]
        if own and x[4] is not None and name.get(spec) == own[1]:
            ok = (own[0], anchor) in have
        else:
            ok = bool(before) and (before[-1][0], anchor) in have
        if not ok:
            want[x[0]] = "deleted" if any((s[0], anchor) in have for s in before) else "late" if any((s[0], anchor) in have for s in line) else "missing"
    t = [spark.createDataFrame(d, SCHEMAS[n]) for d, n in ((refs, "refs"), (secs, "sections"), (snaps, "snapshots"), (specs, "specs"), (shared, "shared_anchors"))]
    for size in (1_500_000, 40):
        got = orphan_references(*t, range_rows=size)
        assert {x.ref_id: x.reason for x in got.collect()} == want, size
        assert got.count() == len(want)
    assert {"deleted", "late", "missing"} <= set(want.values())
    report = orphan_report(orphan_references(*t), t[2], t[3]).collect()
    assert sum(x.n_refs for x in report) == len(want)
