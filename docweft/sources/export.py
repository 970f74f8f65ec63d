"""Publishing a pruned copy of the tables with a manifest of its files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.operators.corpus import Corpus
from docweft.operators.diff import prune

#: Published copies may not be larger, in bytes; files hold at most so many rows. Fixed values.
MOST_BYTES, FILE_ROWS = 900 * 2**20, 200_000


def export(corpus: Corpus, target: str, providers: list[str] = (), most_bytes: int = MOST_BYTES, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write specs, current snapshots, sections, refs and idl_defs below ``target`` and a manifest; returns the manifest
    (path, bytes, sha256).

    Only specs of the given providers (any case; none means all) and no pull requests are written. A copy above
    ``most_bytes`` is an error. Files are hashed where they lie, in parallel.
    """
    t = corpus.tables
    spark = t.spark
    current = corpus.current
    if providers:
        current = current.filter(F.lower("provider").isin([p.lower() for p in providers]))
    ids = current.select(F.col("snapshot_id").alias("id"))
    tables = {
        "specs": prune(t.specs, current, "id", "spec_id"),
        "snapshots": prune(t.snapshots, ids, "id", "id"),
        **{name: prune(getattr(t, name), ids, "snapshot_id") for name in ("sections", "refs", "idl_defs")},
    }
    for name, df in tables.items():
        df.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(os.path.join(target, f"{name}.parquet"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([os.path.join(target, f"{n}.parquet") for n in tables])
    manifest = files.select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if total > most_bytes:
        raise ValueError(f"the copy has {total} bytes, more than {most_bytes}")
    manifest.coalesce(1).write.mode("overwrite").json(os.path.join(target, "manifest"))
    return manifest


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON texts with sorted names, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def to_document(rows: list[dict]) -> str:
    """Rows of an answer as one JSON document."""
    return json.dumps(rows, ensure_ascii=False, sort_keys=True, default=str)
