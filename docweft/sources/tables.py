"""Typed access to the parquet tables of one data directory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "specs": "id bigint, name string, base_url string, provider string",
    "snapshots": "id bigint, spec_id bigint, sha string, commit_date string, indexed_at timestamp, is_latest int, "
    "pr_number bigint, merge_base_sha string, pr_pages string, index_version string",
    "sections": "id bigint, snapshot_id bigint, anchor string, title string, content_text string, section_type string, "
    "parent_anchor string, prev_anchor string, next_anchor string, depth int, number string, ord int",
    "refs": "id bigint, snapshot_id bigint, from_anchor string, to_spec string, to_anchor string, step_path string, "
    "step_text string, guard_path array<string>, call_site_id string, kind string, ord int",
    "idl_defs": "id bigint, snapshot_id bigint, anchor string, name string, owner string, kind string, "
    "canonical_name string, idl_text string, ord int",
    "update_checks": "spec_id bigint, last_checked timestamp, last_indexed timestamp, content_hash string, "
    "index_version string, etag string, last_modified string, source_hash string",
    "shared_anchors": "spec string, anchor string, title string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, spec string, title string, "
    "created_at timestamp",
    "mix_targets": "source string, target_share double, max_repeats int",
    "run_limits": "name string, amount int",
}


@dataclass(frozen=True)
class Tables:
    """Lazily opened tables below one directory: ``Tables(spark, dir).sections``."""

    spark: SparkSession
    path: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def limit(self, name: str) -> int:
        """A value of the fixed table run_limits (one row is read)."""
        row = self.run_limits.filter(f"name = '{name}'").select("amount").first()
        if row is None:
            raise KeyError(f"run_limits has no row named {name}")
        return row[0]


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A table of the right shape without rows."""
    return spark.createDataFrame([], SCHEMAS[name])
