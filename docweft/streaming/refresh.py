"""Incremental refresh: which sources are due, what a check found, and a stream of deliveries applied as differences."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweft.functions.columns import text_digest
from docweft.operators.diff import diff_rows, upsert

#: A source is checked again after so many hours; a writer's claim is stale after so many seconds. Fixed values.
CHECK_HOURS, CLAIM_SECONDS = 24, 120


def due(checks: DataFrame, now: Column, index_version: str) -> DataFrame:
    """Checks with is_due (1 or 0): the last one is older than CHECK_HOURS, never was, or another version indexed it."""
    late = F.col("last_checked").isNull() | (F.col("last_checked") < now - F.expr(f"INTERVAL {CHECK_HOURS} HOURS"))
    other = ~F.col("index_version").eqNullSafe(F.lit(index_version))
    return checks.withColumn("is_due", (late | other).cast("int"))


def freshness(status: Column, old_hash: Column, new_hash: Column) -> Column:
    """What a conditional request found: not_modified (304), same_content, changed or failed."""
    return F.when(status == 304, "not_modified").when(~status.between(200, 299) | status.isNull() | new_hash.isNull(), "failed").when(old_hash.eqNullSafe(new_hash), "same_content").otherwise("changed")


def after_check(checks: DataFrame, outcomes: DataFrame, now: Column, index_version: str) -> DataFrame:
    """update_checks after a round of requests. outcomes: spec_id, outcome, content_hash, etag, last_modified.

    A failed request changes nothing; not_modified and same_content move last_checked (and validators, if new ones
    came); changed also moves last_indexed, the hash and the version. Checks unknown so far are added.
    """
    o = outcomes.select("spec_id", "outcome", F.col("content_hash").alias("_h"), F.col("etag").alias("_e"), F.col("last_modified").alias("_m"))
    both = checks.join(o, "spec_id", "full")
    ok, changed = F.col("outcome").isin("not_modified", "same_content", "changed"), F.col("outcome") == "changed"
    new = lambda cond, value, old: F.when(F.coalesce(cond, F.lit(False)), value).otherwise(F.col(old)).alias(old)
    cols = {
        "last_checked": new(ok, now, "last_checked"),
        "last_indexed": new(changed, now, "last_indexed"),
        "content_hash": new(changed, F.col("_h"), "content_hash"),
        "index_version": new(changed, F.lit(index_version), "index_version"),
        "etag": new(ok, F.coalesce("_e", "etag"), "etag"),
        "last_modified": new(ok, F.coalesce("_m", "last_modified"), "last_modified"),
    }
    return both.filter(ok | F.col("outcome").isNull() | (F.col("outcome") == "failed") & F.col("last_checked").isNotNull()).select(*[cols.get(c, F.col(c)) for c in checks.columns])


def new_contents(stream: DataFrame, key: str = "spec", text: str = "content", seen_at: str | None = None, delay: str = "7 days") -> DataFrame:
    """A stream (or table) with each (key, content) passed on once; with an event-time column the state is bounded."""
    hashed = stream.withColumn("content_hash", F.hex(text_digest(F.col(text))))
    if seen_at is None:
        return hashed.dropDuplicates([key, "content_hash"])
    return hashed.withWatermark(seen_at, delay).dropDuplicatesWithinWatermark([key, "content_hash"])


def apply_deliveries(stream: DataFrame, target: str, checkpoint: str, keys: list[str], text: list[str], order: list[str], on_diff: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Apply a stream of delivered rows to the table below ``target``, batch by batch, writing only when rows differ.

    Each batch is written as a new version (``v=<batch id>``), and a batch that comes again after a failure finds its
    version and does nothing, so the table is the same however often executors or the driver are lost. ``on_diff`` gets
    each batch's differences (keys and action).
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, batch_id: int) -> None:
        fs = spark._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = fs.Path(target)
        files = root.getFileSystem(conf)
        done = sorted(int(s.getPath().getName()[2:]) for s in files.listStatus(root) if s.getPath().getName().startswith("v=") and files.exists(fs.Path(s.getPath(), "_SUCCESS"))) if files.exists(root) else []
        if batch_id in done:
            return
        older = [v for v in done if v < batch_id]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in batch.columns if c not in keys])
        if older:
            base = spark.read.schema(batch.schema).parquet(os.path.join(target, f"v={older[-1]}"))
            changes = diff_rows(base.join(last.select(*keys), keys, "left_semi"), last, keys, text).filter("action <> 'keep'")
            if on_diff is not None:
                on_diff(changes, batch_id)
            elif changes.isEmpty():
                return
            last = upsert(base, batch, keys, order)
        elif on_diff is not None:
            on_diff(last.select(*keys, F.lit("insert").alias("action")), batch_id)
        last.write.mode("overwrite").parquet(os.path.join(target, f"v={batch_id}"))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_version(spark, target: str) -> DataFrame:
    """The table as of its last whole version."""
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(target)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[2:]) for s in files.listStatus(root) if s.getPath().getName().startswith("v=") and files.exists(fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(os.path.join(target, f"v={max(done)}"))
