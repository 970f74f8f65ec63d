"""Streaming kernels give the same rows however their input is cut into batches. No Spark."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from docweft.operators import hierarchy, references, snapshots


def cut(table: pa.Table, size: int):
    return table.combine_chunks().to_batches(max_chunksize=size)


def rows(batches) -> list:
    return sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=str)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_merge(size):
    r = random.Random(4)
    recs, want = [], []
    for spec in (1, 2):
        for a in "abcd":
            have = {q: r.choice([b"x", b"y"]) for q in range(1, 12) if r.random() < 0.6}
            for q, d in have.items():
                if q < 11:
                    recs.append((spec, a, q + 1, 0, d, q, q + 1, q))
                if q > 1:
                    recs.append((spec, a, q, 1, d, q - 1, q, q))
            for q in range(1, 11):
                o, n = have.get(q), have.get(q + 1)
                kind = "changed" if o and n and o != n else "removed" if o and not n else "added" if n and not o else None
                if kind:
                    want.append((spec, q, q + 1, a, kind, q if o else None, q + 1 if n else None))
    recs.sort(key=lambda x: x[:4])
    names = ["spec_id", "anchor", "seq", "side", "digest", "from_id", "to_id", "section_id"]
    t = pa.table([pa.array(list(c)) for c in zip(*recs)], names=names)
    assert rows(snapshots._merge(iter(cut(t, size)))) == sorted(want, key=str)
    assert rows(snapshots._merge(iter([]))) == []


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_solver(size, monkeypatch):
    r = random.Random(1)
    recs = [(g, f"n{i}", r.choice([None, *[f"n{j}" for j in range(6)]]), i % 3, i) for g in range(1, 30) for i in range(r.randrange(1, 7))]
    recs.sort()
    t = pa.table([pa.array([x[0] for x in recs], pa.int64()), pa.array([x[1] for x in recs]), pa.array([x[2] for x in recs], pa.string()), pa.array([x[3] for x in recs], pa.int32()), pa.array([x[4] for x in recs], pa.int64())], names=["g", "n", "p", "ord", "id"])
    kinds = {"g": "bigint", "n": "string", "p": "string"} | hierarchy.COLUMNS
    schema = pa.schema([(k, hierarchy._arrow(v)) for k, v in kinds.items()])
    run = lambda: hierarchy._solver("g", "n", "p", ["ord", "id"], [], schema, True, False)
    whole = rows(run()(iter(cut(t, 10_000))))
    monkeypatch.setattr(hierarchy, "_BATCH_ROWS", 4)
    assert rows(run()(iter(cut(t, size)))) == whole and len(whole) == len(recs)


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_probe_with_meeting_hashes(size):
    """Keys that share their first hash are told apart by the second."""
    parents = [(h1, h2, references._FULL, a, a + 5) for h1 in (1, 2) for h2 in range(4) for a in (10 * h2, 40)] + [(3, 0, references._SHARED, 0, 0), (1, 9, references._OWN, 77, 0)]
    refs = [(h1, h2, t, own) for h1 in (1, 2, 3, 4) for h2 in (0, 1, 3, 9) for t in (-5, 3, 12, 42, 60) for own in (references.NO_INSTANT, 77, 78)]

    def brute(h1, h2, t, own):
        mine = [p for p in parents if p[:2] == (h1, h2)]
        if any(p[2] == references._SHARED for p in mine):
            return None
        full = sorted((p[3], p[4]) for p in mine if p[2] == references._FULL)
        before = [p for p in full if p[0] <= t]
        if own != references.NO_INSTANT:
            if any(p[2] == references._OWN and p[3] == own for p in mine):
                return None
        elif before and before[-1][1] > t:
            return None
        return "deleted" if before else "late" if full else "missing"

    data = [(*p, None, None) for p in sorted(parents, key=lambda x: x[2])] + [(h1, h2, references._REF, t, own, i, 0) for i, (h1, h2, t, own) in enumerate(refs)]
    names = ["h1", "h2", "kind", "a", "b", "ref_id", "snapshot_id"]
    t = pa.table([pa.array(list(c), pa.int32() if n == "kind" else pa.int64()) for n, c in zip(names, zip(*data))], names=names)
    want = {i: brute(*x) for i, x in enumerate(refs)}
    assert {r[0]: r[2] for r in rows(references._probe(iter(cut(t, size))))} == {k: v for k, v in want.items() if v}
    only = t.filter(pa.compute.equal(t["kind"], references._REF))
    assert {r[2] for r in rows(references._probe(iter(cut(only, size))))} == {"missing"}


def test_solve_nothing():
    e = np.array([], object)
    assert len(hierarchy.solve(np.array([], int), e, e, np.array([], int))["level"]) == 0
