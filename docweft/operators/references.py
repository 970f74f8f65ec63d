"""References: per-target results under skew, and references to records that do not exist."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.columns import FOREVER, NO_INSTANT, instant, key_hashes, norm_anchor, norm_spec
from docweft.operators.runtime import FINE_BITS, cut, fine_range, join_dim, partitions, place
from docweft.operators.snapshots import full_snapshots

KINDS = ("step", "note", "idl", "prose")


def with_target(refs: DataFrame) -> DataFrame:
    """refs with to_spec and to_anchor in their normal forms."""
    return refs.withColumns({"to_spec": norm_spec(F.col("to_spec")), "to_anchor": norm_anchor(F.col("to_anchor"))})


def target_profile(refs: DataFrame) -> DataFrame:
    """Per target (to_spec, to_anchor, normal forms): how often and from where it is referred to.

    Result: n_refs, n_step, n_note, n_idl, n_prose, n_other (null or unknown kinds), n_sections (distinct snapshot_id
    and from_anchor, nulls counting as one value each), n_snapshots. Null targets form a group of their own.

    Native algebraic aggregates: each task combines its rows in a hash table that spills, and only compact partial
    states are shuffled, first by target and referring section, so that a hot target is spread, then by target and
    snapshot, then by target. No task ever holds more than its share of a hot target.
    """
    kind = F.lower("kind")
    by_section = (
        with_target(refs.select("snapshot_id", "from_anchor", "to_spec", "to_anchor", "kind"))
        .groupBy("to_spec", "to_anchor", "snapshot_id", "from_anchor")
        .agg(F.count("*").alias("n_refs"), *[F.count_if(kind == k).alias(f"n_{k}") for k in KINDS])
    )
    sums = ["n_refs", *[f"n_{k}" for k in KINDS]]
    by_snapshot = by_section.groupBy("to_spec", "to_anchor", "snapshot_id").agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("n_sections"))
    return (
        by_snapshot.groupBy("to_spec", "to_anchor")
        .agg(*[F.sum(c).alias(c) for c in sums], F.sum("n_sections").alias("n_sections"), F.count("*").alias("n_snapshots"))
        .withColumn("n_other", F.col("n_refs") - sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}")))
    )


def target_counts(refs: DataFrame) -> DataFrame:
    """Rows per target (to_spec, to_anchor, normal forms) as n_refs.

    Rows are first combined by the spelling they have, so that the normal form is worked out once per spelling; both
    aggregations combine on the map side.
    """
    spelt = refs.groupBy("to_spec", "to_anchor").agg(F.count("*").alias("n_refs"))
    return with_target(spelt).groupBy("to_spec", "to_anchor").agg(F.sum("n_refs").alias("n_refs"))


def hot_targets(refs: DataFrame, permille: int) -> DataFrame:
    """The targets that hold more than ``permille`` thousandths of all refs rows, with n_refs. Null parts are values."""
    total = refs.agg(F.count("*")).scalar()
    return target_counts(refs).filter(F.col("n_refs") * 1000 > total * permille)


def per_target(refs: DataFrame, *aggs: Column) -> DataFrame:
    """Any algebraic aggregates (sum, count, min, max, ...) per target, combined on the map side."""
    return with_target(refs).groupBy("to_spec", "to_anchor").agg(*aggs)


# ---- references to records that do not exist -------------------------------------------------------------------------

_OWN, _SHARED, _FULL, _REF = 0, 1, 2, 3
_PROBE = "ref_id bigint, snapshot_id bigint, reason string"
#: Rows that one range should hold; ranges with more references are probed by several tasks.
RANGE_ROWS = 1_500_000


class _Parents:
    """The parents of one range as sorted arrays."""

    def __init__(self, t: pa.Table):
        h1, h2, kind = (np.asarray(t[c]) for c in ("h1", "h2", "kind"))
        a, b = np.asarray(t["a"]), np.asarray(t["b"])
        by = np.lexsort((h2, h1))
        s1, s2 = h1[by], h2[by]
        new = np.r_[True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])] if len(by) else np.zeros(0, bool)
        self.k1, self.k2 = s1[new], s2[new]
        key = np.empty(len(by), np.int64)
        key[by] = np.cumsum(new) - 1
        runs = np.diff(np.r_[np.flatnonzero(np.r_[True, self.k1[1:] != self.k1[:-1]]), len(self.k1)]) if len(self.k1) else np.ones(1, int)
        self.most = int(runs.max())  # 1 unless two keys share their first hash
        self.shared = np.zeros(len(self.k1) + 1, bool)
        self.shared[key[kind == _SHARED]] = True
        own = kind == _OWN
        self.snaps = np.unique(a[own])
        self.own = np.unique(key[own] * (len(self.snaps) + 1) + np.searchsorted(self.snaps, a[own]))
        full = kind == _FULL
        self.times = np.unique(a[full])
        when = key[full] * (len(self.times) + 1) + np.searchsorted(self.times, a[full])
        by = np.lexsort((b[full], when))
        self.when, self.until, self.owner = when[by], b[full][by], key[full][by]

    def reasons(self, t: pa.RecordBatch) -> np.ndarray:
        """0 exists, 1 deleted, 2 late, 3 missing for each reference of a batch, by binary searches."""
        h1, h2, t_ref, own_snapshot = (np.asarray(t.column(c)) for c in ("h1", "h2", "a", "b"))
        n = len(h1)
        if not len(self.k1):
            return np.full(n, 3)
        key = np.full(n, -1)
        left = np.searchsorted(self.k1, h1)
        for d in range(self.most):
            at = np.minimum(left + d, len(self.k1) - 1)
            key = np.where((key < 0) & (self.k1[at] == h1) & (self.k2[at] == h2), at, key)
        known = key >= 0
        result = np.full(n, 3)
        exists = known & self.shared[key]
        is_own = own_snapshot != NO_INSTANT
        if len(self.own):
            s = np.searchsorted(self.snaps, own_snapshot)
            code = key * (len(self.snaps) + 1) + s
            at = np.minimum(np.searchsorted(self.own, code), len(self.own) - 1)
            there = s < len(self.snaps)
            there[there] = self.snaps[s[there]] == own_snapshot[there]
            exists |= known & is_own & there & (self.own[at] == code)
        if len(self.when):
            code = key * (len(self.times) + 1) + np.searchsorted(self.times, t_ref, "right")
            at = np.searchsorted(self.when, code) - 1  # the last presence that began at or before the instant
            before = known & (at >= 0) & (self.owner[np.maximum(at, 0)] == key)
            exists |= before & ~is_own & (self.until[np.maximum(at, 0)] > t_ref)
            nxt = np.minimum(at + 1, len(self.when) - 1)
            after = known & (self.owner[nxt] == key) & (at + 1 < len(self.when))
            result[after] = 2
            result[before] = 1
        result[exists] = 0
        return result


_REASONS = np.array([None, "deleted", "late", "missing"], object)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within one range: the parents come first and are kept as sorted arrays, then references stream past them."""
    schema = pa.schema([("ref_id", pa.int64()), ("snapshot_id", pa.int64()), ("reason", pa.string())])
    held: list[pa.RecordBatch] = []
    parents: _Parents | None = None
    for b in batches:
        kind = np.asarray(b.column("kind"))
        n = int(np.searchsorted(kind, _REF))  # sorted by kind
        if n:
            held.append(b.slice(0, n))
        if n == b.num_rows:
            continue
        if parents is None:
            parents = _Parents(pa.Table.from_batches(held, b.schema))
            held = []
        b = b.slice(n)
        why = parents.reasons(b)
        bad = np.flatnonzero(why)
        if len(bad):
            yield pa.record_batch([b.column("ref_id").take(pa.array(bad)), b.column("snapshot_id").take(pa.array(bad)), pa.array(_REASONS[why[bad]], pa.string())], schema=schema)


def orphan_references(refs: DataFrame, sections: DataFrame, snapshots: DataFrame, specs: DataFrame, shared_anchors: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The references whose target does not exist at the time of the referring snapshot.

    Result: ref_id, snapshot_id, reason. Let t be the commit instant of the reference's snapshot. A target exists if it
    is a shared anchor; or, for a target in the spec of that snapshot, if that very snapshot has the anchor; or, for
    another spec, if its last full snapshot with instant <= t has it. Else the reason is ``deleted`` (a full snapshot
    at or before t had it), ``late`` (a later one has it) or ``missing``.

    Null or unknown parts of a target make it missing. An unreadable commit date, or an unknown snapshot, lies before
    all others. Repeated references are all reported.

    Keys are the 128-bit hashes of (spec, anchor). Their ranges are counted (a bounded histogram of 2**12 ranges goes
    to the driver) and joined to partitions of about ``range_rows`` rows. Parents lie in each range as sorted arrays,
    each with the instants from and until which the anchor held; batches of references are probed by binary search. The
    references of a range that is too full, as under a hot target, are spread over several tasks, each with that
    range's parents.
    """
    spark = refs.sparkSession
    names = specs.groupBy(F.col("id").alias("spec_id")).agg(F.min(norm_spec(F.col("name"))).alias("spec"))
    full = full_snapshots(snapshots, sections)
    every = snapshots.filter("id is not null").groupBy(F.col("id").alias("snapshot_id")).agg(F.min("spec_id").alias("spec_id"), F.min(instant(F.col("commit_date"))).alias("t"))
    dims = every.join(full.select("snapshot_id", "next_instant", F.lit(True).alias("is_full")), "snapshot_id", "left").join(names, "spec_id", "left").select("snapshot_id", "spec", "t", "is_full", "next_instant")
    dims = cut(dims)  # counted, broadcast and joined twice

    h = key_hashes(F.col("spec"), F.col("anchor"))
    held = join_dim(sections.select("snapshot_id", "anchor").filter("snapshot_id is not null and anchor is not null"), dims.filter("spec is not null"), "snapshot_id")
    held = held.select(h[0].alias("h1"), h[1].alias("h2"), "snapshot_id", "t", "is_full", "next_instant").distinct()
    both = F.array(
        F.struct(F.lit(_OWN).alias("kind"), F.col("snapshot_id").alias("a"), F.lit(0).cast("bigint").alias("b")),
        F.when(F.col("is_full"), F.struct(F.lit(_FULL).alias("kind"), F.col("t").alias("a"), F.coalesce("next_instant", F.lit(FOREVER)).alias("b"))),
    )
    none = F.lit(None).cast("bigint")
    parents = held.select("h1", "h2", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("p")).select("h1", "h2", "p.kind", "p.a", "p.b", none.alias("ref_id"), none.alias("snapshot_id"))
    s = key_hashes(norm_spec(F.col("spec")), F.col("anchor"))
    shared = shared_anchors.filter("spec is not null and anchor is not null").select(s[0].alias("h1"), s[1].alias("h2"), F.lit(_SHARED).alias("kind"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), none.alias("ref_id"), none.alias("snapshot_id")).distinct()
    parents = parents.unionByName(shared)

    k = key_hashes(F.col("to_spec"), F.col("to_anchor"))
    asked = with_target(refs.select(F.col("id").alias("ref_id"), "snapshot_id", "to_spec", "to_anchor"))
    # null parts must not meet a parent's key: they get a key no parent has
    asked = asked.withColumn("to_spec", F.when(F.col("to_anchor").isNotNull(), F.col("to_spec"))).withColumns({"h1": k[0], "h2": k[1]})
    histogram = {r[0]: r[1] for r in asked.groupBy(fine_range(F.col("h1"))).count().collect()}  # at most 2**FINE_BITS rows
    held_each = 2 * sections.select(F.lit(1)).count() / 2**FINE_BITS  # parents are spread evenly over the ranges
    total = sum(histogram.values()) + int(held_each * 2**FINE_BITS)
    n = partitions(spark, total, range_rows)
    share = max(1, -(-total // n))
    first, parts, room = [], [], 0  # per fine range: its first partition and their number
    at = -1
    for r in range(2**FINE_BITS):
        c = histogram.get(r, 0) + held_each
        if c > 2 * share:
            m = int(-(-c // share))
            first.append(at + 1), parts.append(m)
            at, room = at + m, 0
        else:
            if at < 0 or room < c:
                at, room = at + 1, share
            room -= c
            first.append(at), parts.append(1)
    count = at + 1
    first_of = F.element_at(F.lit(np.array(first, np.int32)), fine_range(F.col("h1")) + 1)
    parts_of = F.element_at(F.lit(np.array(parts, np.int32)), fine_range(F.col("h1")) + 1)
    parents = parents.withColumn("part", F.explode(F.sequence(first_of, first_of + parts_of - 1)))
    asked = join_dim(asked, dims, "snapshot_id", "left").select(
        "h1",
        "h2",
        F.lit(_REF).alias("kind"),
        F.coalesce("t", F.lit(NO_INSTANT)).alias("a"),
        F.when(F.col("spec") == F.col("to_spec"), F.col("snapshot_id")).otherwise(F.lit(NO_INSTANT)).alias("b"),
        "ref_id",
        "snapshot_id",
        (first_of + F.pmod(F.hash("ref_id", "snapshot_id"), parts_of)).alias("part"),
    )
    return place(parents.unionByName(asked), count, "part").sortWithinPartitions("kind").mapInArrow(_probe, _PROBE)


def orphan_report(orphans: DataFrame, snapshots: DataFrame, specs: DataFrame) -> DataFrame:
    """Orphans per referring spec, month of the referring snapshot's commit (UTC, null if unreadable) and reason."""
    snaps = snapshots.groupBy(F.col("id").alias("snapshot_id")).agg(F.min("spec_id").alias("spec_id"), F.min(instant(F.col("commit_date"))).alias("t"))
    per = orphans.groupBy("snapshot_id", "reason").agg(F.count("*").alias("n"))
    named = per.join(snaps, "snapshot_id", "left").join(specs.groupBy(F.col("id").alias("spec_id")).agg(F.min("name").alias("spec")), "spec_id", "left")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t") / 86_400_000_000).cast("int"))  # in UTC, whatever the session's zone
    month = F.when(F.col("t") > NO_INSTANT, F.date_format(day, "yyyy-MM"))
    return named.groupBy("spec", month.alias("month"), "reason").agg(F.sum("n").alias("n_refs"))
