"""Differences between two states of a table, and applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.columns import text_digest
from docweft.operators.corpus import Corpus, first_rows
from docweft.operators.runtime import join_dim


def digest(*cols: str) -> Column:
    """16 bytes that are equal for equal values of the columns, null being a value of its own."""
    return F.unhex(F.md5(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(f"c{i}") for i, c in enumerate(cols)]))))


def pr_diff(corpus: Corpus) -> DataFrame:
    """What each pull request changes against its base: pr_snapshot_id, anchor, status (added, modified).

    The base is the full snapshot of the same spec with sha = merge_base_sha, else the spec's current one. Contents that
    are the same text are no change, nor is a title alone. Removals are not told, as a request holds only its own pages.
    """
    full = corpus.full.select("spec_id", F.lower("sha").alias("_sha"), F.col("snapshot_id").alias("base_id"))
    current = corpus.full.filter("next_id is null").select("spec_id", F.col("snapshot_id").alias("current_id"))
    prs = corpus.tables.snapshots.filter("pr_number is not null and id is not null").select(F.col("id").alias("snapshot_id"), "spec_id", F.lower("merge_base_sha").alias("_sha"))
    prs = prs.join(full, ["spec_id", "_sha"], "left").join(current, "spec_id", "left").select("snapshot_id", F.coalesce("base_id", "current_id").alias("base_id"))
    rows = corpus.tables.sections.filter("snapshot_id is not null and anchor is not null").select("snapshot_id", "anchor", "ord", "id", text_digest(F.col("content_text")).alias("digest"))
    head = first_rows(join_dim(rows, prs, "snapshot_id"), ["snapshot_id", "anchor"], ["ord", "id"])
    bases = prs.select(F.col("base_id").alias("snapshot_id")).filter("snapshot_id is not null").distinct()
    base = first_rows(join_dim(rows, bases, "snapshot_id"), ["snapshot_id", "anchor"], ["ord", "id"]).select(F.col("snapshot_id").alias("base_id"), "anchor", F.col("digest").alias("_d"))
    both = head.join(base, ["base_id", "anchor"], "left")
    status = F.when(F.col("_d").isNull(), "added").when(F.col("_d") != F.col("digest"), "modified")
    return both.select(F.col("snapshot_id").alias("pr_snapshot_id"), "anchor", status.alias("status")).filter("status is not null")


def diff_rows(old: DataFrame, new: DataFrame, keys: list[str], text: list[str], structure: list[str] = ()) -> DataFrame:
    """Key by key: keys and action, one of insert, delete, update (a text column differs), restructure (only a structure
    column differs) or keep. Keys must be unique; nulls compare as equal. One shuffle of digests, no values travel."""
    side = lambda df, s: df.select(*keys, digest(*text).alias(f"{s}t"), (digest(*structure) if structure else F.lit(b"")).alias(f"{s}s"))
    both = side(old, "o").join(side(new, "n"), keys, "full")
    action = F.when(F.col("ot").isNull(), "insert").when(F.col("nt").isNull(), "delete").when(F.col("ot") != F.col("nt"), "update").when(F.col("os") != F.col("ns"), "restructure").otherwise("keep")
    return both.select(*keys, action.alias("action"))


def section_diff(corpus: Corpus) -> DataFrame:
    """Counts of inserted, deleted, updated, restructured and kept sections between each full snapshot and the next:
    spec_id, from_snapshot_id, to_snapshot_id, n_insert, n_delete, n_update, n_restructure, n_keep.

    Title, text and type make an update; links in the tree, depth, number and order make a restructuring.
    """
    full = corpus.full.select("snapshot_id", "spec_id", "prev_id", "next_id")
    rows = corpus.tables.sections.filter("snapshot_id is not null and anchor is not null").select(
        "snapshot_id", "anchor", "ord", "id", digest("title", "content_text", "section_type").alias("t"), digest("parent_anchor", "prev_anchor", "next_anchor", "depth", "number", "ord").alias("s")
    )
    live = first_rows(join_dim(rows, full, "snapshot_id"), ["snapshot_id", "anchor"], ["ord", "id"])
    old = live.filter("next_id is not null").select("spec_id", F.col("next_id").alias("to_snapshot_id"), "anchor", F.col("t").alias("ot"), F.col("s").alias("os"))
    new = live.filter("prev_id is not null").select("spec_id", F.col("snapshot_id").alias("to_snapshot_id"), "anchor", F.col("t").alias("nt"), F.col("s").alias("ns"))
    both = old.join(new, ["spec_id", "to_snapshot_id", "anchor"], "full")
    o, n = F.col("ot"), F.col("nt")
    counts = both.groupBy("spec_id", "to_snapshot_id").agg(
        F.count_if(o.isNull()).alias("n_insert"),
        F.count_if(n.isNull()).alias("n_delete"),
        F.count_if(o != n).alias("n_update"),
        F.count_if((o == n) & (F.col("os") != F.col("ns"))).alias("n_restructure"),
        F.count_if((o == n) & (F.col("os") == F.col("ns"))).alias("n_keep"),
    )
    return counts.join(full.select(F.col("snapshot_id").alias("to_snapshot_id"), F.col("prev_id").alias("from_snapshot_id")), "to_snapshot_id").select("spec_id", "from_snapshot_id", "to_snapshot_id", "n_insert", "n_delete", "n_update", "n_restructure", "n_keep")


def ref_group_diff(corpus: Corpus) -> DataFrame:
    """Groups of references (by from_anchor) that must be rewritten between neighbouring full snapshots: spec_id,
    to_snapshot_id, from_anchor, action (insert, delete, rewrite). A group is rewritten whole if any row or the order
    of its rows differs.

    The state of a group is an order-sensitive sum over its rows (two 64-bit hashes of place and content, which combine
    on the map side), so a hot section's references need not come together.
    """
    full = corpus.full.select("snapshot_id", "spec_id", "prev_id", "next_id")
    content = ["to_spec", "to_anchor", "step_path", "step_text", "guard_path", "call_site_id", "kind"]
    rows = corpus.tables.refs.filter("snapshot_id is not null and from_anchor is not null").select(
        "snapshot_id", "from_anchor", F.xxhash64("ord", *content).alias("h1"), F.xxhash64(F.lit("b"), *content, "ord").alias("h2")
    )
    # sums of hashes wrap around without error: they are added as two halves
    low, high = (lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1))), (lambda c: F.shiftright(F.col(c), 32))
    groups = rows.groupBy("snapshot_id", "from_anchor").agg(F.count("*").alias("n"), *[F.sum(f(c)).alias(f"{c}{i}") for c in ("h1", "h2") for i, f in enumerate((low, high))])
    live = join_dim(groups, full, "snapshot_id").withColumn("state", F.struct("n", "h10", "h11", "h20", "h21"))
    old = live.filter("next_id is not null").select("spec_id", F.col("next_id").alias("to_snapshot_id"), "from_anchor", F.col("state").alias("o"))
    new = live.filter("prev_id is not null").select("spec_id", F.col("snapshot_id").alias("to_snapshot_id"), "from_anchor", F.col("state").alias("n"))
    both = old.join(new, ["spec_id", "to_snapshot_id", "from_anchor"], "full")
    return both.select("spec_id", "to_snapshot_id", "from_anchor", F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(F.col("o") != F.col("n"), "rewrite").alias("action")).filter("action is not null")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The base with each key's latest update laid over it; of updates with equal keys the last in order wins."""
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in updates.columns if c not in keys]), F.struct(*order)).alias("_u")).select(*keys, *[F.col(f"_u.{c}").alias(c) for c in updates.columns if c not in keys])
    kept = base.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.select(*base.columns))


def prune(table: DataFrame, keep: DataFrame, key: str, keep_key: str = "id") -> DataFrame:
    """Rows of a table whose parent is kept (delete by cascade): a semi join, null keys go."""
    return table.join(keep.select(F.col(keep_key).alias(key)).distinct(), key, "left_semi").select(*table.columns)


def content_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with the same text: digest, n_rows, first_key; one shuffle of digests, combined on the map side."""
    return rows.select(F.col(key).alias("_k"), text_digest(F.col(text)).alias("_d")).groupBy("_d").agg(F.count("*").alias("n_rows"), F.min("_k").alias("first_key")).select(F.lower(F.hex("_d")).alias("digest"), "n_rows", "first_key")
