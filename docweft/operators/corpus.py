"""The current state of all specs: one row per live section, definition and reference."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions.columns import norm_anchor, norm_spec
from docweft.operators.runtime import cut, join_dim
from docweft.operators.snapshots import full_snapshots
from docweft.sources.tables import Tables


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the one first in order (nulls last); the order-preserving distinct of all operators.

    Rows whose keys are null form groups of their own. The rank is limited on the map side before the shuffle, so
    repeated rows do not gather, and columns that are not asked for later are never read.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return rows.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def section_url(base_url: Column, provider: Column, anchor: Column) -> Column:
    """The address of a section: a bare base for providers of PDF files, ``base#a`` for one page, else ``base/#a``."""
    return F.when(provider == "itu", base_url).when(base_url.endswith(".html"), F.concat(base_url, F.lit("#"), anchor)).otherwise(F.concat(F.rtrim(base_url, F.lit("/")), F.lit("/#"), anchor))


@dataclass
class Corpus:
    """Current views over the tables of one directory. Each is a plan; only the order of the full snapshots, on which all
    others build, is worked out once, when it is first used."""

    tables: Tables

    @cached_property
    def full(self) -> DataFrame:
        return cut(full_snapshots(self.tables.snapshots, self.tables.sections))

    @cached_property
    def current(self) -> DataFrame:
        """The last full snapshot of each spec: snapshot_id, spec_id, spec, base_url, provider, sha, commit_date."""
        last = self.full.filter("next_id is null").select("snapshot_id", "spec_id", "sha", "commit_date")
        specs = self.tables.specs.select(F.col("id").alias("spec_id"), F.col("name").alias("spec"), "base_url", "provider")
        return last.join(specs, "spec_id")

    def _of_current(self, rows: DataFrame, *cols: str) -> DataFrame:
        return join_dim(rows.filter("snapshot_id is not null"), self.current.select("snapshot_id", "spec", *cols), "snapshot_id")

    @cached_property
    def sections(self) -> DataFrame:
        """The sections of the current snapshots, first row of each anchor, with spec, base_url and provider."""
        live = self._of_current(self.tables.sections.filter("anchor is not null"), "base_url", "provider")
        return first_rows(live, ["snapshot_id", "anchor"], ["ord", "id"])

    @cached_property
    def idl_defs(self) -> DataFrame:
        """Definitions of the current snapshots, first row of each (anchor, kind)."""
        return first_rows(self._of_current(self.tables.idl_defs.filter("anchor is not null")), ["snapshot_id", "anchor", "kind"], ["ord", "id"])

    @cached_property
    def refs(self) -> DataFrame:
        """References of the current snapshots; to_spec is the registered name where the spec is known, else upper case."""
        names = self.tables.specs.select(norm_spec(F.col("name")).alias("_n"), F.col("name").alias("_name")).groupBy("_n").agg(F.min("_name").alias("_name"))
        live = self._of_current(self.tables.refs).withColumns({"_n": norm_spec(F.col("to_spec")), "to_anchor": norm_anchor(F.col("to_anchor"))})
        return join_dim(live, names, "_n", "left").withColumn("to_spec", F.coalesce("_name", F.upper("_n"))).drop("_n", "_name")

    @cached_property
    def edges(self) -> DataFrame:
        """Distinct links between sections: spec, anchor, to_spec, to_anchor, with the first ord and id. No self-links."""
        r = self.refs.filter("from_anchor is not null and to_anchor is not null and to_spec is not null")
        return (
            r.filter(~((F.col("spec") == F.col("to_spec")) & (F.col("from_anchor") == F.col("to_anchor"))))
            .groupBy("spec", F.col("from_anchor").alias("anchor"), "to_spec", "to_anchor")
            .agg(F.min(F.struct("ord", "id")).alias("_f"))
            .select("spec", "anchor", "to_spec", "to_anchor", F.col("_f.ord").alias("ord"), F.col("_f.id").alias("id"))
        )


def node(spec: str | Column = "spec", anchor: str | Column = "anchor") -> Column:
    """The name of a section in the reference graph: ``spec#anchor``."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(c(spec), F.lit("#"), c(anchor))
