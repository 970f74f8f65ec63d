"""Full snapshots: their order, what changed between neighbours, and each attribute's history."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions.columns import NO_INSTANT, instant, text_digest
from docweft.operators.runtime import cut, join_dim


def full_snapshots(snapshots: DataFrame, sections: DataFrame) -> DataFrame:
    """The full snapshots of each spec in commit order.

    A full snapshot has a null pr_number, is the least id among equal (spec_id, sha ignoring case) and has at least
    one sections row. Result: snapshot_id, spec_id, sha, commit_date, instant (microseconds), seq (1, 2, ... by instant
    then id), prev_id, next_id and next_instant (null at the ends).

    Rows without id or spec_id are ignored; of rows with equal ids the least (spec_id, pr_number, sha, commit_date)
    stands. A null sha equals no other sha. An unreadable commit_date sorts first.
    """
    delivered = sections.select(F.col("snapshot_id")).filter("snapshot_id is not null").distinct()
    one = snapshots.filter("id is not null and spec_id is not null").groupBy("id").agg(F.min(F.struct("spec_id", "pr_number", "sha", "commit_date")).alias("_s")).select("id", "_s.*")
    first = (
        one.filter("pr_number is null")
        .groupBy("spec_id", F.coalesce(F.lower("sha"), F.concat(F.lit("#"), "id")).alias("_sha"))
        .agg(F.min(F.struct("id", "sha", "commit_date")).alias("_s"))
        .select("spec_id", F.col("_s.id").alias("snapshot_id"), "_s.sha", "_s.commit_date", instant(F.col("_s.commit_date")).alias("instant"))
    )
    order = Window.partitionBy("spec_id").orderBy("instant", "snapshot_id")
    return first.join(delivered, "snapshot_id", "left_semi").select(
        "*",
        F.row_number().over(order).cast("bigint").alias("seq"),
        F.lag("snapshot_id").over(order).alias("prev_id"),
        F.lead("snapshot_id").over(order).alias("next_id"),
        F.lead("instant").over(order).alias("next_instant"),
    )


def anchor_rows(sections: DataFrame, *extra: str) -> DataFrame:
    """One row per (snapshot_id, anchor): that of least ord, then least id (null ord and id last).

    Result: snapshot_id, anchor, section_id, digest and the columns named in ``extra``. Rows without snapshot_id or
    anchor are no sections. Partial aggregation reduces repeated rows before the only shuffle.
    """
    big = F.lit(2**62)
    kept = F.struct(
        F.coalesce(F.col("ord").cast("bigint"), big).alias("o"), F.coalesce(F.col("id"), big).alias("i"), F.col("id").alias("section_id"), text_digest(F.col("content_text")).alias("digest"), *extra
    )
    return (
        sections.filter("snapshot_id is not null and anchor is not null")
        .groupBy("snapshot_id", "anchor")
        .agg(F.min(kept).alias("_k"))
        .select("snapshot_id", "anchor", "_k.section_id", "_k.digest", *(f"_k.{c}" for c in extra))
    )


_CHANGES = "spec_id bigint, from_snapshot_id bigint, to_snapshot_id bigint, anchor string, change string, from_section_id bigint, to_section_id bigint"
_KEY = ("spec_id", "anchor", "seq")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two pointers over two sorted streams that lie in one range, each in key order.

    The stream of the older snapshots (side 0) carries the key of its successor. Where both pointers stand on one key
    the records are compared, else the smaller key exists on one side only. Comparisons run on whole batches; the last
    row of a batch waits for the next.
    """
    schema = pa.schema([("spec_id", pa.int64()), ("from_snapshot_id", pa.int64()), ("to_snapshot_id", pa.int64()), ("anchor", pa.string()), ("change", pa.string()), ("from_section_id", pa.int64()), ("to_section_id", pa.int64())])

    def emit(t: pa.Table, final: bool) -> tuple[pa.Table, pa.RecordBatch | None]:
        n = t.num_rows
        if not n:
            return t, None
        same = np.zeros(n, bool)  # row i and i + 1 hold one key
        if n > 1:
            eq = None
            for c in _KEY:
                e = pc.equal(t[c].slice(0, n - 1), t[c].slice(1))
                eq = e if eq is None else pc.and_(eq, e)
            same[:-1] = np.asarray(eq)
        side = np.asarray(t["side"])
        stop = n if final else n - 1 if not (n > 1 and same[n - 2]) else n
        older = np.flatnonzero((side == 0) & (np.arange(n) < stop))
        both = older[same[older]]
        second = np.zeros(n, bool)
        second[both + 1] = True
        alone_old = older[~same[older]]
        alone_new = np.flatnonzero((side == 1) & ~second & (np.arange(n) < stop))
        differs = both[~np.asarray(pc.equal(t["digest"].take(both), t["digest"].take(both + 1)), bool)] if len(both) else both
        at = np.concatenate([differs, alone_old, alone_new])
        new_at = np.concatenate([differs + 1, alone_old, alone_new])
        kind = np.repeat(np.array(["changed", "removed", "added"]), [len(differs), len(alone_old), len(alone_new)])
        old = pa.array(np.arange(len(at)) < len(differs) + len(alone_old))
        new = pa.array((np.arange(len(at)) < len(differs)) | (np.arange(len(at)) >= len(differs) + len(alone_old)))
        none = pa.scalar(None, pa.int64())
        out = pa.table(
            [t["spec_id"].take(at), t["from_id"].take(at), t["to_id"].take(at), t["anchor"].take(at), pa.array(kind.tolist(), pa.string()), pc.if_else(old, t["section_id"].take(at), none), pc.if_else(new, t["section_id"].take(new_at), none)],
            schema=schema,
        )
        return t.slice(stop), out

    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = (pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t).combine_chunks()
        rest, out = emit(t, False)
        if out is not None:
            yield from out.combine_chunks().to_batches()
    if rest is not None:
        _, out = emit(rest, True)
        if out is not None:
            yield from out.combine_chunks().to_batches()


def snapshot_changes(sections: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What was added, removed or changed in content_text between consecutive full snapshots.

    Result: spec_id, from_snapshot_id, to_snapshot_id, anchor, change (added, removed, changed), from_section_id,
    to_section_id. Two records are the same if their comparable texts are (``columns.comparable_text``).

    Each record goes once into the stream of older records, under the key of the next snapshot, and once into that of
    newer ones, under its own. Both streams are range-partitioned together and sorted by (spec, anchor, snapshot), then
    merged range by range with two pointers in constant memory. As the key holds the snapshot, any boundary between
    ranges is right, so a hot spec or anchor is split like all else. Only digests travel, never texts.
    """
    full = cut(full_snapshots(snapshots, sections).select("snapshot_id", "spec_id", "seq", "prev_id", "next_id"))
    rows = join_dim(anchor_rows(sections), full, "snapshot_id")
    keep = ("spec_id", "anchor", "digest", "section_id")
    sides = F.explode(
        F.filter(
            F.array(
                F.when(F.col("next_id").isNotNull(), F.struct((F.col("seq") + 1).alias("seq"), F.lit(0).alias("side"), F.col("snapshot_id").alias("from_id"), F.col("next_id").alias("to_id"))),
                F.when(F.col("prev_id").isNotNull(), F.struct(F.col("seq").alias("seq"), F.lit(1).alias("side"), F.col("prev_id").alias("from_id"), F.col("snapshot_id").alias("to_id"))),
            ),
            lambda x: x.isNotNull(),
        )
    ).alias("s")
    streams = rows.select(*keep, sides).select(*keep, "s.*")
    ranged = streams.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY, "side")
    return ranged.mapInArrow(_merge, _CHANGES)


#: Length of the stretches of consecutive snapshots in which islands are first built.
HISTORY_BLOCK = 512


def attribute_history(sections: DataFrame, snapshots: DataFrame, block: int = HISTORY_BLOCK) -> DataFrame:
    """Every version of content_text of each (spec_id, anchor), whatever is_latest says.

    Result: spec_id, anchor, first_snapshot_id, last_snapshot_id, section_id (of the first), digest, n_snapshots,
    valid_from, valid_to (null while it holds), is_current. A version is a longest run of consecutive full snapshots
    with the same text; absence ends it, and a text that comes back is a new version.

    Gaps and islands: a lag of digest and position marks changes, a running sum numbers the islands, minimum and next
    start give the validity. Islands are built within blocks of ``block`` snapshots, so a key that holds a third of all
    rows is spread; only islands that touch a block's edge meet again in a second, far smaller pass.
    """
    full = cut(full_snapshots(snapshots, sections).select("snapshot_id", "spec_id", "seq", "instant", "next_instant"))
    rows = join_dim(anchor_rows(sections), full, "snapshot_id").withColumn("block", F.floor((F.col("seq") - 1) / block))
    first_level = rows.select(
        "spec_id", "anchor", "block", "digest", F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"), F.col("snapshot_id").alias("first_snapshot_id"), F.col("snapshot_id").alias("last_snapshot_id"), "section_id", "instant", "next_instant", F.lit(1).cast("bigint").alias("n_snapshots")
    )

    def islands(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("first_seq")
        starts = ~((F.lag("digest").over(w) == F.col("digest")) & (F.lag("last_seq").over(w) + 1 == F.col("first_seq")))
        numbered = df.withColumn("_new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(w))
        return numbered.groupBy(*keys, "_island").agg(
            F.min("first_seq").alias("first_seq"),
            F.max("last_seq").alias("last_seq"),
            F.first("digest").alias("digest"),
            F.min_by(F.struct("first_snapshot_id", "section_id", "instant"), "first_seq").alias("_a"),
            F.max_by(F.struct("last_snapshot_id", "next_instant"), "last_seq").alias("_z"),
            F.sum("n_snapshots").alias("n_snapshots"),
        ).select(*keys, "digest", "first_seq", "last_seq", "n_snapshots", "_a.first_snapshot_id", "_a.section_id", "_a.instant", "_z.last_snapshot_id", "_z.next_instant")

    blocks = islands(first_level, "spec_id", "anchor", "block")
    at_edge = ((F.col("last_seq") % block == 0) & F.col("next_instant").isNotNull()) | ((F.col("first_seq") % block == 1) & (F.col("first_seq") > 1))
    long_specs = full.filter(F.col("seq") > block).limit(1).count() > 0
    if not long_specs:  # no spec reaches a block's edge: every island is whole already
        done = blocks.drop("block")
    else:
        blocks = cut(blocks.withColumn("_edge", at_edge))
        done = blocks.filter("not _edge").drop("block", "_edge").unionByName(islands(blocks.filter("_edge").drop("block", "_edge"), "spec_id", "anchor"))
    return done.select(
        "spec_id",
        "anchor",
        "first_snapshot_id",
        "last_snapshot_id",
        "section_id",
        "digest",
        "n_snapshots",
        F.when(F.col("instant") > NO_INSTANT, F.timestamp_micros("instant")).alias("valid_from"),
        F.timestamp_micros("next_instant").alias("valid_to"),
        F.col("next_instant").isNull().alias("is_current"),
    )
