"""Requests and answers as JSON: one request enum for every lookup, with an error envelope."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators import diff, effects, graph, lookup, state
from docweft.operators.corpus import Corpus, node
from docweft.operators.flow import flow_graphs, steps_of
from docweft.operators.search import search
from docweft.session import ship
from docweft.sources.tables import Tables

#: Default limits of the requests. Fixed values.
LIMITS = {"search": 20, "anchors": 20, "refs": 20, "idl": 20, "graph_depth": 2, "graph_nodes": 150, "trace_depth": 6, "traces": 20, "effects": 12}


class ApiError(Exception):
    def __init__(self, code: str, message: str, details=None):
        super().__init__(message)
        self.code, self.details = code, details


#: An answer of more rows is refused instead of being gathered at the driver.
ANSWER_ROWS = 100_000


def _rows(df: DataFrame, *order: str) -> list[dict]:
    """The rows of an answer, at most ANSWER_ROWS; whole tables are the operators' work, not a request's."""
    got = (df.orderBy(*order) if order else df).limit(ANSWER_ROWS + 1).collect()
    if len(got) > ANSWER_ROWS:
        raise ApiError("answer_too_large", f"the answer has more than {ANSWER_ROWS} rows")
    return [r.asDict(recursive=True) for r in got]


class Service:
    """Answers requests over one directory of tables."""

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self.spark, self.corpus = spark, Corpus(Tables(spark, path))

    def _target(self, text: str) -> tuple[str, str]:
        one = self.spark.createDataFrame([(text,)], "target string")
        r = lookup.resolve_targets(self.corpus, one).first()
        if r.error == "invalid_target":
            raise ApiError("invalid_request", f"not a target: {text}")
        if r.error:
            raise ApiError("spec_not_indexed", f"no such spec: {text}")
        return r.spec, r.anchor

    def _section(self, text: str) -> tuple[str, str, DataFrame]:
        spec, anchor = self._target(text)
        here = self.corpus.sections.filter((F.col("spec") == spec) & (F.col("anchor") == anchor)).select("spec", "anchor")
        if here.isEmpty():
            raise ApiError("not_found", f"no such section: {text}")
        return spec, anchor, here

    def specs(self):
        return _rows(lookup.specs_list(self.corpus), "spec")

    def query(self, target: str):
        spec, anchor, here = self._section(target)
        view = _rows(lookup.section_views(self.corpus, with_text=True).join(here, ["spec", "anchor"], "left_semi"))[0]
        view["references"] = _rows(lookup.reference_lists(self.corpus).join(here, ["spec", "anchor"], "left_semi"), "direction")
        view["outgoing"] = _rows(self.corpus.edges.join(here, ["spec", "anchor"], "left_semi").select("to_spec", "to_anchor", "ord"), "ord", "to_spec", "to_anchor")
        return view

    def exists(self, target: str):
        spec, anchor = self._target(target)
        return _rows(lookup.exists(self.corpus, self.spark.createDataFrame([(spec, anchor)], "spec string, anchor string")))[0]

    def search(self, query: str, spec: str | None = None, limit: int = LIMITS["search"]):
        return _rows(search(self.corpus, [query], spec, limit, with_snippet=True).drop("query_no"), "rank_no")

    def anchors(self, pattern: str, spec: str | None = None, limit: int = LIMITS["anchors"]):
        return _rows(lookup.anchors(self.corpus, [pattern], spec, limit).drop("query_no"), "spec", "anchor")

    def list(self, spec: str):
        return _rows(lookup.list_headings(self.corpus).filter(F.lower("spec") == spec.lower()), "entry_no")

    def refs(self, target: str, direction: str = "outgoing", kind: str | None = None, limit: int = LIMITS["refs"]):
        if direction not in ("outgoing", "incoming", "both"):
            raise ApiError("invalid_request", f"no such direction: {direction}")
        if "#" in target:
            spec, anchor = self._target(target)
            found = self.spark.createDataFrame([(spec, anchor)], "spec string, anchor string")
        else:
            found = lookup.shorthand(self.corpus, [target], limit).select("spec", "anchor")
        out = {"matches": _rows(found)}
        for d in ("outgoing", "incoming") if direction == "both" else (direction,):
            out[d] = _rows(lookup.ref_edges(self.corpus, found, d, kind), "spec", "anchor", "id")
        return out

    def idl(self, query: str, spec: str | None = None, limit: int = LIMITS["idl"]):
        return _rows(lookup.idl(self.corpus, [query], spec, limit).drop("query_no"), "rank_no")

    def graph(self, target: str, direction: str = "outgoing", max_depth: int = LIMITS["graph_depth"], max_nodes: int = LIMITS["graph_nodes"], include: list[str] = (), exclude: list[str] = (), same_spec_only: bool = False):
        spec, anchor = self._target(target)
        roots = self.spark.createDataFrame([(f"{spec}#{anchor}",)], "id string")
        try:
            nodes, links = graph.neighbourhoods(graph.node_edges(self.corpus), roots, direction, max_depth, max_nodes, include, exclude, same_spec_only)
        except ValueError as e:
            raise ApiError("invalid_request", str(e)) from e
        return {"nodes": _rows(graph.with_metadata(nodes, self.corpus), "id"), "edges": _rows(links, "src", "dst")}

    def trace(self, source: str, target: str, max_depth: int = LIMITS["trace_depth"], kind: str | None = None, max_traces: int = LIMITS["traces"]):
        a, b = ("#".join(self._target(x)) for x in (source, target))
        r = self.corpus.refs if kind is None else self.corpus.refs.filter(F.col("kind") == kind)
        edges = r.filter("from_anchor is not null and to_anchor is not null").select(node("spec", "from_anchor").alias("src"), node("to_spec", "to_anchor").alias("dst"), "ord", "id")
        return _rows(graph.simple_paths(edges, self.spark.createDataFrame([(a, b)], "source string, target string"), max_depth, max_traces), "path_no")

    def flow(self, target: str):
        spec, anchor, here = self._section(target)
        rows = _rows(flow_graphs(self.corpus).filter((F.col("spec") == spec) & (F.col("anchor") == anchor)), "item", "no")
        if not rows:
            raise ApiError("not_found", f"{target} is no algorithm")
        return rows

    def effects(self, target: str):
        spec, anchor, _ = self._section(target)
        e = effects.Effects(self.corpus, steps_of(self.corpus))
        return _rows(effects.preview(e.summaries().filter(F.col("node") == f"{spec}#{anchor}"), LIMITS["effects"]), "effect_no")

    def effects_paths(self, target: str, effect_id: str):
        spec, anchor, _ = self._section(target)
        e = effects.Effects(self.corpus, steps_of(self.corpus))
        states = e.states()
        wanted = states.filter((F.col("node") == f"{spec}#{anchor}") & F.startswith("effect", F.lit(effect_id))).select("node", "effect")
        return _rows(effects.witnesses(states, wanted))

    def state(self, selector: str):
        views = state.field_views(state.sites(steps_of(self.corpus)))
        rows = _rows(views.filter(F.lower("field").like(lookup.like_of_glob(selector.lower()))), "field")
        if not rows:
            raise ApiError("not_found", f"no such field: {selector}")
        return rows

    def state_coverage(self, spec: str):
        s = steps_of(self.corpus).filter(F.lower("spec") == spec.lower())
        return _rows(s.groupBy("kind").agg(F.count("*").alias("n")), "kind")

    def pr_diff(self, pr_snapshot_id: int):
        return _rows(diff.pr_diff(self.corpus).filter(F.col("pr_snapshot_id") == pr_snapshot_id), "anchor")

    def handle(self, request: dict) -> dict:
        """``{"type": name, ...arguments}`` to ``{"type": name, "result": ...}`` or ``{"error": {code, message}}``."""
        kind = request.get("type") if isinstance(request, dict) else None
        known = ("specs", "query", "exists", "search", "anchors", "list", "refs", "idl", "graph", "trace", "flow", "effects", "effects_paths", "state", "state_coverage", "pr_diff")
        try:
            if kind not in known:
                raise ApiError("invalid_request", f"no such request: {kind}")
            args = {k: v for k, v in request.items() if k != "type"}
            if kind == "trace":
                args = {{"from": "source", "to": "target"}.get(k, k): v for k, v in args.items()}
            try:
                import inspect

                inspect.signature(getattr(self, kind)).bind(**args)
            except TypeError as e:
                raise ApiError("invalid_request", str(e)) from e
            return {"type": kind, "result": getattr(self, kind)(**args)}
        except ApiError as e:
            return {"error": {"code": e.code, "message": str(e)} | ({"details": e.details} if e.details else {})}

    def handle_json(self, text: str) -> str:
        try:
            request = json.loads(text)
        except ValueError as e:
            return json.dumps({"error": {"code": "invalid_request", "message": str(e)}})
        return json.dumps(self.handle(request), ensure_ascii=False, default=str)


def main(args: list[str]) -> int:
    """``python -m docweft DIRECTORY REQUEST...``: one answer a line."""
    if len(args) < 2:
        print(main.__doc__)
        return 2
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    service = Service(spark, args[0])
    answers = [service.handle_json(x) for x in args[1:]]
    print("\n".join(answers))
    return int(any('"error"' in a[:10] for a in answers))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
