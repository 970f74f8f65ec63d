"""Control flow and statements of all algorithms, parsed section by section where they are read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.functions import steps as S
from docweft.operators.corpus import Corpus
from docweft.operators.lookup import algorithm_calls
from docweft.operators.runtime import spread

_STRINGS = pa.list_(pa.string())


def algorithms(corpus: Corpus) -> DataFrame:
    return corpus.sections.filter("section_type = 'algorithm' and content_text is not null").select("spec", "anchor", "content_text")


def _emit(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def flow_graphs(corpus: Corpus) -> DataFrame:
    """The control flow of every algorithm, one row per node, edge or issue: spec, anchor, item (node, edge, issue), no,
    id (node or source), target, kind (of node or edge, or the issue's code), text."""
    calls = algorithm_calls(corpus).filter("step_path is not null").groupBy("spec", "anchor").agg(F.array_sort(F.collect_list(F.struct("step_path", "first_ord", F.concat("to_spec", F.lit("#"), "to_anchor").alias("to")))).alias("calls"))
    src = algorithms(corpus).join(calls, ["spec", "anchor"], "left")
    schema = pa.schema([("spec", pa.string()), ("anchor", pa.string()), ("item", pa.string()), ("no", pa.int32()), ("id", pa.string()), ("target", pa.string()), ("kind", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for spec, anchor, text, called in zip(*(b.column(c).to_pylist() for c in ("spec", "anchor", "content_text", "calls"))):
                by: dict[str, list[str]] = {}
                for c in called or []:
                    by.setdefault(c["step_path"], []).append(c["to"])
                nodes, edges, issues = S.flow(text, by)
                out += [(spec, anchor, "node", i, n, None, k, t) for i, (n, k, t) in enumerate(nodes)]
                out += [(spec, anchor, "edge", i, a, z, k, None) for i, (a, z, k) in enumerate(edges)]
                out += [(spec, anchor, "issue", i, s, None, k, None) for i, (s, k) in enumerate(issues)]
            yield _emit(schema, out)

    return spread(src).mapInArrow(run, "spec string, anchor string, item string, no int, id string, target string, kind string, text string")


def steps_of(corpus: Corpus) -> DataFrame:
    """Every step of every algorithm as a statement: spec, anchor, step_no, step_path, parent_path, depth, text, kind,
    action, reason (of opaque ones), defs, uses, writes, reads, calls. A step of no known form is ``opaque``, never left out."""
    schema = pa.schema([("spec", pa.string()), ("anchor", pa.string()), ("step_no", pa.int32()), ("step_path", pa.string()), ("parent_path", pa.string()), ("depth", pa.int32()), ("text", pa.string()), ("kind", pa.string()), ("action", pa.string()), ("reason", pa.string()), *[(c, _STRINGS) for c in ("defs", "uses", "writes", "reads", "calls")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for spec, anchor, text in zip(*(b.column(c).to_pylist() for c in ("spec", "anchor", "content_text"))):
                steps = S.parse_steps(text)
                for i, s in enumerate(steps):
                    st = S.statement(s.text)
                    out.append((spec, anchor, i, s.path, steps[s.parent].path if s.parent >= 0 else None, s.path.count(".") + 1, S.plain(s.text), st["kind"], st["action"], st["reason"], st["defs"], st["uses"], st["writes"], st["reads"], st["calls"]))
            yield _emit(schema, out)

    arrays = ", ".join(f"{c} array<string>" for c in ("defs", "uses", "writes", "reads", "calls"))
    return spread(algorithms(corpus)).mapInArrow(run, f"spec string, anchor string, step_no int, step_path string, parent_path string, depth int, text string, kind string, action string, reason string, {arrays}")


def numeric_path(path: str = "step_path"):
    """A step path as an array of numbers, for sorting 2 before 10."""
    return F.transform(F.split(F.col(path), r"\."), lambda x: x.cast("int"))
