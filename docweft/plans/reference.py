"""Queries of the corpus operators over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators import coverage as C
from docweft.operators import diff as D
from docweft.operators import effects as E
from docweft.operators import graph as G
from docweft.operators import lookup as L
from docweft.operators import state as S
from docweft.operators.corpus import Corpus, node
from docweft.operators.flow import flow_graphs, steps_of
from docweft.operators.search import search
from docweft.operators.selectors import idl_members, resolve_selectors
from docweft.plans.general import _FULL, _TARGET
from docweft.plans.steps_sql import SQL_PARTS, STEPS
from docweft.sources.tables import Tables
from docweft.streaming.refresh import due

GLOBS = ["sec-*", "*-queue", "concept-*-map", "dom-*(*"]
IDL = ["open()", "Segment", "close", "Record.freeze"]
WORDS = ["queue", "sealed", "record.open", "policy", "zone.map"]
SEARCHES = ["sealed queue", '"trailing packet"', "ledger OR monitor", "title: algorithm NOT record", "anch* fence", "buffered AND (glyph OR mesh)"]


def _corpus(spark: SparkSession, path: str) -> Corpus:
    return Corpus(Tables(spark, path))


def _algorithms(c: Corpus) -> DataFrame:
    return c.sections.filter("section_type = 'algorithm'").select(node().alias("id"))


def specs_list(spark, path):
    return L.specs_list(_corpus(spark, path))


def section_views(spark, path):
    return L.section_views(_corpus(spark, path))


def children(spark, path):
    return L.children(_corpus(spark, path))


def list_headings(spark, path):
    return L.list_headings(_corpus(spark, path))


def section_tree(spark, path):
    return L.section_tree(_corpus(spark, path))


def target_exists(spark, path):
    c = _corpus(spark, path)
    targets = c.refs.filter("to_spec is not null and to_anchor is not null").select(F.col("to_spec").alias("spec"), F.col("to_anchor").alias("anchor")).distinct()
    return L.exists(c, targets)


def anchors_glob(spark, path):
    return L.anchors(_corpus(spark, path), GLOBS, limit=50)


def idl_lookup(spark, path):
    return L.idl(_corpus(spark, path), IDL)


def refs_shorthand(spark, path):
    return L.shorthand(_corpus(spark, path), WORDS)


def refs_outgoing(spark, path):
    return L.ref_edges(_corpus(spark, path), direction="outgoing").select("spec", "anchor", "to_spec", "to_anchor", "kind", "step_path", "edge_no")


def refs_incoming(spark, path):
    return L.ref_edges(_corpus(spark, path), direction="incoming", kind="step").select("spec", "anchor", "from_spec", "from_anchor", "step_path", "edge_no")


def distinct_links(spark, path):
    return _corpus(spark, path).edges.select("spec", "anchor", "to_spec", "to_anchor", "ord")


def algorithm_calls(spark, path):
    return L.algorithm_calls(_corpus(spark, path))


def spec_dependencies(spark, path):
    return L.spec_dependencies(_corpus(spark, path))


def pr_pages(spark, path):
    return L.pr_pages(_corpus(spark, path))


def unindexed_specs(spark, path):
    return L.unindexed_specs(_corpus(spark, path))


def call_sites(spark, path):
    return L.call_sites(_corpus(spark, path))


def callers(spark, path):
    return L.callers(_corpus(spark, path), 3)


def contents_short(spark, path):
    return L.contents(_corpus(spark, path))


def call_bindings(spark, path):
    return S.bindings(_corpus(spark, path))


def state_unlinked(spark, path):
    c = _corpus(spark, path)
    return S.possible_unlinked(steps_of(c), S.fields(c).select(F.col("canonical_name").alias("field"), "name"))


def pr_overlay(spark, path):
    return L.pr_overlay(_corpus(spark, path))


def pr_diff(spark, path):
    return D.pr_diff(_corpus(spark, path))


def section_diff(spark, path):
    return D.section_diff(_corpus(spark, path))


def ref_group_diff(spark, path):
    return D.ref_group_diff(_corpus(spark, path))


def upsert_last_index(spark, path):
    t = Tables(spark, path)
    base = t.update_checks.select("spec_id", F.col("last_indexed").alias("at"), F.col("index_version").alias("version"))
    new = t.snapshots.filter("pr_number is null").select("spec_id", F.col("indexed_at").alias("at"), F.col("index_version").alias("version"))
    return D.upsert(base, new, ["spec_id"], ["at", "version"]).select("spec_id", F.unix_micros("at").alias("at_us"), "version")


def same_documents(spark, path):
    return D.content_groups(Tables(spark, path).documents, "doc_id", "text")


def search_bm25(spark, path):
    return search(_corpus(spark, path), SEARCHES).withColumn("score", F.round("score", 6))


def graph_neighbourhood(spark, path):
    c = _corpus(spark, path)
    return G.neighbourhoods(G.node_edges(c), _algorithms(c), "outgoing", 2, None)[0].select("root", "id", "depth")


def graph_nodes(spark, path):
    c = _corpus(spark, path)
    return G.with_metadata(graph_neighbourhood(spark, path), c)


def query_refs(spark, path):
    return L.reference_lists(_corpus(spark, path))


def members_declared(spark, path):
    return idl_members(_corpus(spark, path)).distinct()


SELECTORS = ["Segment", "segment", "StagedDigest.publish", "Realm.*", "mesh-grid-301#sec-*", "MESH-GRID-301#no-such", "", "a#b#c", "NoSuchType", "NoSuchType.x"]


def state_selectors(spark, path):
    return resolve_selectors(_corpus(spark, path), spark.createDataFrame(list(enumerate(SELECTORS)), "selector_no int, selector string"))


def graph_capped(spark, path):
    c = _corpus(spark, path)
    return G.neighbourhoods(G.node_edges(c), _algorithms(c), "both", 2, 40, include=["*#sec-*", "*#concept-*"], exclude=["re:map$"])[0]


def graph_distances(spark, path):
    c = _corpus(spark, path)
    return G.distances(G.node_edges(c), _algorithms(c), 3)


def trace_paths(spark, path):
    """Every path of at most 6 references from any section to any algorithm; parallel references are paths of their own."""
    c = _corpus(spark, path)
    links = c.refs.filter("from_anchor is not null and to_anchor is not null and to_spec is not null").select(node("spec", "from_anchor").alias("src"), node("to_spec", "to_anchor").alias("dst"), "ord", "id").filter("src <> dst")
    return G.traces(links, c.sections.select(node().alias("id")), _algorithms(c), 6).select("source", "target", "path_no", "hops", F.array_join("path", " > ").alias("way"), F.array_join(F.col("via").cast("array<string>"), " ").alias("via"))


def dependency_closure(spark, path):
    c = _corpus(spark, path)
    links = L.spec_dependencies(c).select(F.col("spec").alias("src"), F.col("to_spec").alias("dst"), F.col("n_refs").alias("n"))
    return G.closure(links, c.current.select(F.col("spec").alias("id")), 64).select("root", "id", "depth")


def flow_all(spark, path):
    return flow_graphs(_corpus(spark, path)).drop("no")


def statements(spark, path):
    join = lambda c, sort: F.array_join(F.array_sort(c) if sort else F.col(c), " ").alias(c)
    return steps_of(_corpus(spark, path)).select("spec", "anchor", "step_no", "step_path", "parent_path", "depth", "text", "kind", "action", "reason", join("defs", False), join("uses", True), join("writes", False), join("reads", True), join("calls", True))


def effect_calls(spark, path):
    return E.call_edges(_corpus(spark, path)).select("src", "dst", "relation", "exec")


def effect_issues(spark, path):
    return E.unresolved_calls(_corpus(spark, path))


def effect_occurrences(spark, path):
    """The effects of every step of every algorithm."""
    c = _corpus(spark, path)
    return E.Effects(c, steps_of(c)).local().select("node", "step_path", "kind", "params", F.array_join("rule_ids", ",").alias("rules"))


def effect_states(spark, path):
    """Effects (kind and parameters) of every step, propagated along calls."""
    c = _corpus(spark, path)
    effects = E.Effects(c, steps_of(c))
    local = effects.local_once
    names = local.groupBy("effect").agg(F.min("kind").alias("kind"), F.min("params").alias("params"))
    return effects.states().groupBy("node", "effect", "exec").agg(F.min("distance").alias("distance")).join(names, "effect").select("node", "kind", "params", "exec", "distance")


def effect_summaries(spark, path):
    c = _corpus(spark, path)
    return E.preview(E.Effects(c, steps_of(c)).summaries()).drop("effect")


def state_fields(spark, path):
    return S.field_views(S.sites(steps_of(_corpus(spark, path))))


def state_members(spark, path):
    return S.member_view(steps_of(_corpus(spark, path)))


def state_counts(spark, path):
    return S.occurrence_counts(S.sites(steps_of(_corpus(spark, path))))


def state_types(spark, path):
    c = _corpus(spark, path)
    fields = S.fields(c)
    above = S.supertypes(S.type_edges(c), fields.select(F.col("owner_key").alias("type_key")).distinct())
    return S.type_views(above, fields)


def algorithm_views(spark, path):
    return S.algorithm_views(steps_of(_corpus(spark, path)))


def slices_forward(spark, path):
    c = _corpus(spark, path)
    return S.slices(c, S.first_definitions(steps_of(c)))


def slices_backward(spark, path):
    """What may decide the last step of each algorithm."""
    c = _corpus(spark, path)
    last = steps_of(c).groupBy("spec", "anchor").agg(F.max_by("step_path", "step_no").alias("target"))
    return S.backward_slices(c, last)


def omitted_runs(spark, path):
    c = _corpus(spark, path)
    steps = steps_of(c)
    return S.omitted_runs(steps, S.slices(c, S.first_definitions(steps)))


def source_addresses(spark, path):
    t = Tables(spark, path)
    return C.scan_addresses(t.documents, t.specs, "doc_id", "text")


def step_drift(spark, path):
    """The steps of each current algorithm against those of the snapshot before."""
    c = _corpus(spark, path)
    before = c.full.filter("next_id is null and prev_id is not null").select(F.col("prev_id").alias("snapshot_id"))
    old = Corpus(c.tables)
    old.__dict__["current"] = c.full.join(before, "snapshot_id", "left_semi").select("snapshot_id", "spec_id", "sha", "commit_date").join(c.tables.specs.select(F.col("id").alias("spec_id"), F.col("name").alias("spec"), "base_url", "provider"), "spec_id")
    return C.step_drift(c, steps_of(c), steps_of(old))


def checks_due(spark, path):
    t = Tables(spark, path)
    now = t.update_checks.agg(F.max("last_checked")).scalar()
    return due(t.update_checks, now, "8").select("spec_id", "is_due")


QUERIES = {
    f.__name__: f
    for f in (
        specs_list, section_views, children, list_headings, section_tree, target_exists, anchors_glob, idl_lookup, refs_shorthand, refs_outgoing, refs_incoming, distinct_links, algorithm_calls, spec_dependencies, pr_pages, unindexed_specs, call_sites, callers, contents_short, call_bindings, state_unlinked, pr_overlay, pr_diff, section_diff,
        ref_group_diff, upsert_last_index, same_documents, search_bm25, graph_neighbourhood, graph_nodes, query_refs, members_declared, state_selectors, graph_capped, graph_distances, trace_paths, dependency_closure, flow_all, statements, effect_calls, effect_occurrences, effect_states, effect_issues, effect_summaries,
        state_fields, state_members, state_counts, state_types, algorithm_views, slices_forward, slices_backward, omitted_runs, source_addresses, step_drift, checks_due,
    )
}

# ---- SQL -----------------------------------------------------------------------------------------------------------

_SQL_FULL = _FULL[: _FULL.index("texts AS (")].rstrip().rstrip(",")
_CORPUS = (
    _SQL_FULL
    + f""",
cur AS (SELECT f.snapshot_id, f.spec_id, s.name AS spec, s.base_url, s.provider, x.sha, x.commit_date FROM full_snaps f JOIN specs s ON s.id = f.spec_id JOIN snapshots x ON x.id = f.snapshot_id WHERE f.next_id IS NULL),
sec AS (SELECT p.*, c.spec, c.base_url, c.provider FROM picked p JOIN cur c USING (snapshot_id)),
idl AS (SELECT * FROM (SELECT d.*, c.spec, row_number() OVER (PARTITION BY d.snapshot_id, anchor, kind ORDER BY ord, d.id) AS k FROM idl_defs d JOIN cur c USING (snapshot_id)) WHERE k = 1),
cref AS (
  SELECT r.*, c.spec, coalesce(n.name, upper(r.tspec)) AS t_spec
  FROM (SELECT id, snapshot_id, from_anchor, to_spec AS tspec, to_anchor AS t_anchor, step_path, step_text, kind, ord FROM (SELECT id, snapshot_id, from_anchor, step_path, step_text, kind, ord, {_TARGET} FROM refs)) r
  JOIN cur c USING (snapshot_id) LEFT JOIN specs n ON lower(n.name) = r.tspec),
edge AS (SELECT spec, from_anchor AS anchor, t_spec AS to_spec, t_anchor AS to_anchor, min(ord) AS ord, spec || '#' || from_anchor AS src, t_spec || '#' || t_anchor AS dst FROM cref WHERE NOT (spec = t_spec AND from_anchor = t_anchor) GROUP BY ALL)
"""
)
_REC = _CORPUS.replace("WITH firsts", "WITH RECURSIVE firsts", 1)


def _search_sql() -> str:
    """BM25 for SEARCHES, term by term, over tokens with their places."""
    tok = r"list_filter(string_split_regex(strip_accents(lower(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    docs = ", ".join(f"{tok.format(c=c)} AS {a}" for c, a in (("anchor", "ta"), ("title", "tt"), ("content_text", "tc")))
    word = lambda w, fs=("ta", "tt", "tc"): " + ".join(f"len(list_filter({f}, lambda t: t = '{w}'))" for f in fs)
    prefix = lambda w: " + ".join(f"len(list_filter({f}, lambda t: starts_with(t, '{w}')))" for f in ("ta", "tt", "tc"))
    pair = lambda a, b: " + ".join(f"len(list_filter(range(1, len({f})), lambda i: {f}[i] = '{a}' AND {f}[i + 1] = '{b}'))" for f in ("ta", "tt", "tc"))
    terms = [word("sealed"), word("queue"), pair("trailing", "packet"), word("ledger"), word("monitor"), word("algorithm", ("tt",)), word("record"), prefix("anch"), word("fence"), word("buffered"), word("glyph"), word("mesh")]
    tf = ", ".join(f"({t}) AS f{i}" for i, t in enumerate(terms))
    idf = ", ".join(f"greatest(1e-6, ln((count(*) - count(*) FILTER (f{i} > 0) + 0.5) / (count(*) FILTER (f{i} > 0) + 0.5))) AS i{i}" for i in range(len(terms)))
    part = lambda *xs: " + ".join(f"i{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / avgn))" for i in xs)
    queries = [("f0 > 0 AND f1 > 0", (0, 1)), ("f2 > 0", (2,)), ("f3 > 0 OR f4 > 0", (3, 4)), ("f5 > 0 AND NOT f6 > 0", (5,)), ("f7 > 0 AND f8 > 0", (7, 8)), ("f9 > 0 AND (f10 > 0 OR f11 > 0)", (9, 10, 11))]
    union = " UNION ALL ".join(f"SELECT {q} AS query_no, -({part(*xs)}) AS score, spec, anchor, title, section_type, ord FROM counted, stats WHERE {cond}" for q, (cond, xs) in enumerate(queries))
    return (
        _CORPUS
        + f""", tokened AS (SELECT spec, anchor, title, section_type, ord, {docs} FROM sec),
counted AS (SELECT spec, anchor, title, section_type, ord, len(ta) + len(tt) + len(tc) AS n, {tf} FROM tokened),
stats AS (SELECT avg(n) AS avgn, {idf} FROM counted),
hits AS ({union})
SELECT * EXCLUDE (ord, score), round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score, spec, ord, anchor) AS rank_no FROM hits) WHERE rank_no <= 20"""
    )


def _glob_sql() -> str:
    each = " UNION ALL ".join(f"SELECT {i} AS query_no, anchor, spec, title, section_type, ord FROM sec WHERE lower(anchor) LIKE '{g.replace('*', '%').lower()}'" for i, g in enumerate(GLOBS))
    return _CORPUS + f""", hits AS ({each}), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY spec, ord, anchor) AS n FROM hits) WHERE n <= 50)
SELECT query_no, anchor, spec, title, section_type FROM (SELECT *, row_number() OVER (PARTITION BY query_no, anchor ORDER BY n) AS k FROM top) WHERE k = 1"""


def _idl_sql() -> str:
    asks = ["open", "segment", "close", "record.freeze"]
    each = " UNION ALL ".join(
        f"""SELECT {i} AS query_no, CASE WHEN lower(canonical_name) = '{q}' THEN 100 WHEN lower(name) = '{q}' THEN 95 WHEN lower(anchor) = '{q}' THEN 90 WHEN lower(canonical_name) LIKE '%{q}%' THEN 80 ELSE 70 END AS score, * FROM idl
WHERE lower(canonical_name) LIKE '%{q}%' OR lower(name) LIKE '%{q}%' OR lower(anchor) = '{q}'"""
        for i, q in enumerate(asks)
    )
    return _CORPUS + f""", hits AS ({each}), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, spec, canonical_name, ord, anchor, kind) AS rank_no FROM hits) WHERE rank_no <= 20)
SELECT query_no, rank_no, score, t.spec, t.anchor, canonical_name, t.kind, s.title FROM top t LEFT JOIN sec s ON s.spec = t.spec AND s.anchor = t.anchor"""


def _shorthand_sql() -> str:
    each = []
    a, t = "lower(anchor)", "lower(coalesce(title, ''))"
    for i, q in enumerate(WORDS):
        owner, dot, member = q.partition(".")
        part = member if dot else q
        if dot:
            score = f"""CASE WHEN contains({a}, '{member}') THEN 40 ELSE 0 END + CASE WHEN contains({a}, '{owner}') THEN 35 ELSE -20 END + CASE WHEN contains({a}, '{owner}-{member}') THEN 50 ELSE 0 END
+ CASE WHEN ends_with({a}, '-{member}') THEN 10 ELSE 0 END + CASE WHEN {t} = '{member}' THEN 50 WHEN contains({t}, '{member}') THEN 20 ELSE 0 END + CASE section_type WHEN 'idl' THEN 10 WHEN 'definition' THEN 5 ELSE 0 END"""
        else:
            score = f"""CASE WHEN {a} = '{q}' THEN 100 ELSE 0 END + CASE WHEN {t} = '{q}' THEN 90 ELSE 0 END + CASE WHEN contains({a}, '{q}') THEN 40 ELSE 0 END + CASE WHEN contains({t}, '{q}') THEN 30 ELSE 0 END
+ CASE WHEN section_type IN ('idl', 'definition') THEN 5 ELSE 0 END"""
        each.append(f"SELECT {i} AS query_no, {score} AS score, spec, anchor, title, section_type FROM (SELECT * FROM sec WHERE contains({a}, '{part}') OR contains({t}, '{part}') ORDER BY spec, ord, anchor LIMIT 1000)")
    return _CORPUS + f""", hits AS ({" UNION ALL ".join(each)})
SELECT * FROM (SELECT query_no, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, spec, anchor) AS rank_no, score, spec, anchor, title, section_type FROM hits WHERE score > 0) WHERE rank_no <= 10"""


#: What the default rules say, said once more: kind, pattern, parameters as SQL, rule.
_RULES = [
    ("scheduling.enqueue", r"\bqueue (?:a|an|the) (\w+ \w+)", r"""'{"queue":"' || regexp_extract(text, '\bqueue (?:a|an|the) (\w+ \w+)', 1, 'i') || '"}'""", "queue-step"),
    ("scheduling.promise-continuation", r"^wait until\b", "'{}'", "wait-step"),
    ("scheduling.parallel", r"\bin parallel\b", "'{}'", "in-parallel"),
    ("event.dispatch", r"\bpost the (\w+ \w+)", r"""'{"name":"' || regexp_extract(text, '\bpost the (\w+ \w+)', 1, 'i') || '"}'""", "post-step"),
    ("script.invoke", r"^reject the (\w+ \w+)", """'{"mechanism":"reject"}'""", "reject-step"),
    ("script.invoke", r"^resolve\b", """'{"mechanism":"resolve"}'""", "resolve-step"),
    ("script.opportunity", r"\bthrow a\b", "'{}'", "throw-step"),
]


def _rules_sql(what: str) -> str:
    out = [f"SELECT node, step_path, '{kind}' AS kind, {params} AS params, '{rule}' AS rule FROM steps WHERE regexp_matches(text, '{p}', 'i')" for kind, p, params, rule in _RULES]
    return _REC + STEPS + f", hits AS ({' UNION ALL '.join(out)})" + what


_CALLED = r"""coalesce(regexp_matches(step_text, '\b(abort|append|appl(?:y|ied|ying)|call|clean|continu(?:e|ing)|dispatch|enqueu(?:e|ing)|evaluat(?:e|ing)|execut(?:e|ing)|fir(?:e|ing)|invok(?:e|ing)|load|navigat(?:e|ing)|obtain|pars(?:e|ing)|perform|prepar(?:e|ing)|queu(?:e|ing)|resum(?:e|ing)|run|ran|running|schedul(?:e|ing)|serializ(?:e|ing)|wait)(s|d|ed|ing)?\b', 'i'), false)"""
_CALLS = f""",
calls AS (SELECT DISTINCT c.spec || '#' || from_anchor AS src, t_spec || '#' || t_anchor AS dst, step_path,
  CASE WHEN coalesce(s.section_type <> 'algorithm', true) THEN 'mention' WHEN {_CALLED} THEN 'invoke' ELSE 'candidate_invoke' END AS relation,
  CASE WHEN regexp_matches(step_text, '\\bin parallel\\b', 'i') THEN 2 WHEN s.section_type = 'algorithm' AND {_CALLED} THEN 0 ELSE 1 END AS exec
  FROM cref c LEFT JOIN sec s ON s.spec = c.t_spec AND s.anchor = c.t_anchor WHERE c.kind = 'step')
"""
_STATES = (
    _CALLS
    + """, own AS (SELECT DISTINCT node, step_path, kind, params FROM hits), has AS (SELECT DISTINCT node, kind, params FROM own),
go AS (SELECT DISTINCT src, dst, exec FROM calls WHERE relation <> 'mention'), sites AS (SELECT DISTINCT src, dst, exec, step_path FROM calls WHERE relation <> 'mention'),
stays AS (SELECT a.src, a.dst, a.exec, h.kind, h.params FROM sites a JOIN has h ON h.node = a.dst LEFT JOIN own o ON o.node = a.src AND o.step_path = a.step_path AND o.kind = h.kind AND o.params = h.params GROUP BY ALL HAVING count(*) = count(o.node)),
walk AS (SELECT node, kind, params, 0 AS exec, 0 AS distance FROM has
  UNION SELECT g.src, w.kind, w.params, greatest(g.exec, w.exec), w.distance + 1 FROM walk w JOIN go g ON g.dst = w.node
  WHERE w.distance < 40 AND NOT (w.distance = 0 AND EXISTS (SELECT 1 FROM stays x WHERE x.src = g.src AND x.dst = g.dst AND x.exec = g.exec AND x.kind = w.kind AND x.params = w.params)))"""
)

_NEAR = """
walk AS (
  SELECT spec || '#' || anchor AS root, spec || '#' || anchor AS id, 0 AS depth FROM sec WHERE section_type = 'algorithm'
  UNION SELECT w.root, e.{to}, w.depth + 1 FROM walk w JOIN edge e ON e.{at} = w.id WHERE w.depth < {most})"""

SQL = {
    "specs_list": _CORPUS + "SELECT spec, base_url, provider, sha, commit_date FROM cur",
    "section_views": _CORPUS
    + """, t AS (SELECT spec, anchor, coalesce(title, anchor) AS title FROM sec),
kids AS (SELECT spec, parent_anchor AS anchor, string_agg(anchor, ' ' ORDER BY ord, anchor) AS children FROM sec WHERE parent_anchor IS NOT NULL GROUP BY ALL),
o AS (SELECT spec, anchor, count(*) AS n FROM edge GROUP BY ALL), i AS (SELECT to_spec AS spec, to_anchor AS anchor, count(*) AS n FROM edge GROUP BY ALL)
SELECT s.spec, s.anchor, s.title, s.section_type, p.title AS parent_title, v.title AS prev_title, x.title AS next_title, k.children, coalesce(o.n, 0) AS n_outgoing, coalesce(i.n, 0) AS n_incoming,
 CASE WHEN provider = 'itu' THEN base_url WHEN ends_with(base_url, '.html') THEN base_url || '#' || s.anchor ELSE rtrim(base_url, '/') || '/#' || s.anchor END AS url
FROM sec s LEFT JOIN t p ON p.spec = s.spec AND p.anchor = s.parent_anchor LEFT JOIN t v ON v.spec = s.spec AND v.anchor = s.prev_anchor LEFT JOIN t x ON x.spec = s.spec AND x.anchor = s.next_anchor
LEFT JOIN kids k ON k.spec = s.spec AND k.anchor = s.anchor LEFT JOIN o ON o.spec = s.spec AND o.anchor = s.anchor LEFT JOIN i ON i.spec = s.spec AND i.anchor = s.anchor""",
    "children": _CORPUS + "SELECT spec, parent_anchor, anchor, title, row_number() OVER (PARTITION BY spec, parent_anchor ORDER BY ord, anchor) AS child_no FROM sec WHERE parent_anchor IS NOT NULL",
    "list_headings": _CORPUS + "SELECT spec, row_number() OVER (PARTITION BY spec ORDER BY ord, anchor) AS entry_no, anchor, title, coalesce(depth, 0) AS depth, number FROM sec WHERE section_type = 'heading'",
    "section_tree": _CORPUS
    + """, n AS (SELECT spec, anchor, section_type = 'heading' AND depth IS NOT NULL AS h, depth, row_number() OVER (PARTITION BY spec ORDER BY ord, anchor) AS i FROM sec),
p AS (SELECT n.spec, n.anchor, n.i, CASE WHEN n.h THEN n.depth END AS d, (SELECT arg_max(x.anchor, x.i) FROM n x WHERE x.spec = n.spec AND x.i < n.i AND x.h AND x.depth BETWEEN 1 AND 6 AND (NOT n.h OR x.depth < n.depth)) AS tree_parent FROM n)
SELECT spec, anchor, tree_parent, lag(anchor) OVER w AS tree_prev, lead(anchor) OVER w AS tree_next FROM p WINDOW w AS (PARTITION BY spec, tree_parent, d ORDER BY i)""",
    "target_exists": _CORPUS + "SELECT DISTINCT r.t_spec AS spec, r.t_anchor AS anchor, CAST(s.anchor IS NOT NULL AS int) AS exists_now, s.section_type FROM cref r LEFT JOIN sec s ON s.spec = r.t_spec AND s.anchor = r.t_anchor",
    "anchors_glob": _glob_sql(),
    "idl_lookup": _idl_sql(),
    "refs_shorthand": _shorthand_sql(),
    "refs_outgoing": _CORPUS + "SELECT spec, from_anchor AS anchor, t_spec AS to_spec, t_anchor AS to_anchor, kind, step_path, row_number() OVER (PARTITION BY spec, from_anchor, t_spec, t_anchor ORDER BY ord, id) AS edge_no FROM cref",
    "refs_incoming": _CORPUS + "SELECT t_spec AS spec, t_anchor AS anchor, spec AS from_spec, from_anchor, step_path, row_number() OVER (PARTITION BY spec, from_anchor, t_spec, t_anchor ORDER BY ord, id) AS edge_no FROM cref WHERE kind = 'step'",
    "distinct_links": _CORPUS + "SELECT spec, anchor, to_spec, to_anchor, ord FROM edge",
    "algorithm_calls": _CORPUS + "SELECT c.spec, from_anchor AS anchor, t_spec AS to_spec, t_anchor AS to_anchor, step_path, min(c.ord) AS first_ord FROM cref c JOIN sec s ON s.spec = t_spec AND s.anchor = t_anchor AND s.section_type = 'algorithm' WHERE c.kind = 'step' GROUP BY ALL",
    "spec_dependencies": _CORPUS + "SELECT spec, t_spec AS to_spec, count(*) AS n_refs FROM cref WHERE spec <> t_spec GROUP BY ALL",
    "pr_pages": "SELECT id AS snapshot_id, row_number() OVER (PARTITION BY id ORDER BY i) AS page_no, page FROM (SELECT id, generate_subscripts(string_split(pr_pages, ','), 1) AS i, unnest(string_split(pr_pages, ',')) AS page FROM snapshots WHERE pr_number IS NOT NULL AND pr_pages IS NOT NULL) WHERE page <> ''",
    "unindexed_specs": _CORPUS + "SELECT t_spec AS to_spec, count(*) AS n_refs, count(DISTINCT spec) AS n_specs FROM cref WHERE t_spec NOT IN (SELECT spec FROM cur) GROUP BY ALL",
    "call_sites": _CORPUS
    + """SELECT r.id, x.call_site_id, CASE WHEN provider = 'itu' THEN base_url WHEN ends_with(base_url, '.html') THEN base_url || '#' || x.call_site_id ELSE rtrim(base_url, '/') || '/#' || x.call_site_id END AS url
FROM cref r JOIN refs x ON x.id = r.id JOIN cur c ON c.spec = r.spec WHERE contains(x.call_site_id, ':')""",
    "callers": _CORPUS
    + """, k AS (SELECT DISTINCT t_spec, t_anchor, c.spec || '#' || from_anchor AS caller, step_path FROM cref c JOIN sec s ON s.spec = t_spec AND s.anchor = t_anchor AND s.section_type = 'algorithm' WHERE c.kind = 'step'),
q AS (SELECT t_spec, t_anchor, caller, count(*) AS n FROM k GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY t_spec, t_anchor ORDER BY caller) AS i FROM q)
SELECT t_spec AS to_spec, t_anchor AS to_anchor, CAST(sum(n) AS BIGINT) AS n_calls, count(*) AS n_callers, greatest(count(*) - 3, 0) AS more, string_agg(caller, ' ' ORDER BY caller) FILTER (i <= 3) AS callers FROM g GROUP BY ALL""",
    "pr_overlay": _SQL_FULL
    + """, pr AS (SELECT p.id, b.snapshot_id AS base FROM snapshots p LEFT JOIN (SELECT f.snapshot_id, f.spec_id, lower(s.sha) AS sha FROM full_snaps f JOIN snapshots s ON s.id = f.snapshot_id) b ON b.spec_id = p.spec_id AND b.sha = lower(p.merge_base_sha) WHERE p.pr_number IS NOT NULL),
x AS (SELECT pr.id AS pr_snapshot_id, anchor, s.id AS section_id, 1 AS from_pr, ord FROM pr JOIN sections s ON s.snapshot_id = pr.id UNION ALL SELECT pr.id, anchor, s.id, 0, ord FROM pr JOIN sections s ON s.snapshot_id = pr.base)
SELECT pr_snapshot_id, anchor, section_id, from_pr FROM (SELECT *, row_number() OVER (PARTITION BY pr_snapshot_id, anchor ORDER BY from_pr DESC, ord, section_id) AS k FROM x) WHERE k = 1""",
    "pr_diff": _SQL_FULL
    + r""", norm AS (SELECT snapshot_id, anchor, regexp_replace(trim(regexp_replace(coalesce(content_text, ''), '[ \t\r\n]+', ' ', 'g')), '\]\([^)#]*#', '](#', 'g') AS txt FROM picked),
pr AS (SELECT p.id, coalesce(b.snapshot_id, c.snapshot_id) AS base FROM snapshots p LEFT JOIN (SELECT f.snapshot_id, f.spec_id, lower(s.sha) AS sha FROM full_snaps f JOIN snapshots s ON s.id = f.snapshot_id) b ON b.spec_id = p.spec_id AND b.sha = lower(p.merge_base_sha)
 LEFT JOIN full_snaps c ON c.spec_id = p.spec_id AND c.next_id IS NULL WHERE p.pr_number IS NOT NULL)
SELECT pr.id AS pr_snapshot_id, h.anchor, CASE WHEN o.anchor IS NULL THEN 'added' ELSE 'modified' END AS status FROM pr JOIN norm h ON h.snapshot_id = pr.id LEFT JOIN norm o ON o.snapshot_id = pr.base AND o.anchor = h.anchor WHERE o.anchor IS NULL OR o.txt <> h.txt""",
    "section_diff": _SQL_FULL
    + """, v AS (SELECT f.spec_id, f.snapshot_id, f.prev_id, f.next_id, p.anchor, (p.title, p.content_text, p.section_type) AS t, (p.parent_anchor, p.prev_anchor, p.next_anchor, p.depth, p.number, p.ord) AS s FROM picked p JOIN full_snaps f USING (snapshot_id)),
b AS (SELECT coalesce(n.spec_id, o.spec_id) AS spec_id, coalesce(n.snapshot_id, o.next_id) AS to_snapshot_id, n.anchor AS na, o.anchor AS oa, n.t IS NOT DISTINCT FROM o.t AS same_t, n.s IS NOT DISTINCT FROM o.s AS same_s
 FROM (SELECT * FROM v WHERE prev_id IS NOT NULL) n FULL JOIN (SELECT * FROM v WHERE next_id IS NOT NULL) o ON o.next_id = n.snapshot_id AND o.anchor = n.anchor)
SELECT b.spec_id, f.prev_id AS from_snapshot_id, b.to_snapshot_id, count(*) FILTER (oa IS NULL) AS n_insert, count(*) FILTER (na IS NULL) AS n_delete, count(*) FILTER (oa IS NOT NULL AND na IS NOT NULL AND NOT same_t) AS n_update,
 count(*) FILTER (oa IS NOT NULL AND na IS NOT NULL AND same_t AND NOT same_s) AS n_restructure, count(*) FILTER (oa IS NOT NULL AND na IS NOT NULL AND same_t AND same_s) AS n_keep
FROM b JOIN full_snaps f ON f.snapshot_id = b.to_snapshot_id GROUP BY ALL""",
    "ref_group_diff": _SQL_FULL
    + """, g AS (SELECT f.spec_id, f.snapshot_id, f.prev_id, f.next_id, from_anchor, list((ord, to_spec, to_anchor, step_path, step_text, guard_path, call_site_id, kind) ORDER BY ord, to_spec, to_anchor, step_path, step_text, guard_path, call_site_id, kind) AS rows FROM refs r JOIN full_snaps f USING (snapshot_id) GROUP BY ALL)
SELECT coalesce(n.spec_id, o.spec_id) AS spec_id, coalesce(n.snapshot_id, o.next_id) AS to_snapshot_id, coalesce(n.from_anchor, o.from_anchor) AS from_anchor, CASE WHEN o.spec_id IS NULL THEN 'insert' WHEN n.spec_id IS NULL THEN 'delete' ELSE 'rewrite' END AS action
FROM (SELECT * FROM g WHERE prev_id IS NOT NULL) n FULL JOIN (SELECT * FROM g WHERE next_id IS NOT NULL) o ON o.next_id = n.snapshot_id AND o.from_anchor = n.from_anchor WHERE n.rows IS DISTINCT FROM o.rows""",
    "upsert_last_index": """
WITH n AS (SELECT spec_id, max(struct_pack(a := indexed_at, b := index_version)) AS x FROM snapshots WHERE pr_number IS NULL GROUP BY ALL)
SELECT spec_id, epoch_us(x.a) AS at_us, x.b AS version FROM n
UNION ALL SELECT spec_id, epoch_us(last_indexed), index_version FROM update_checks WHERE spec_id NOT IN (SELECT spec_id FROM n)""",
    "same_documents": r"""
SELECT md5(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g')), '\]\([^)#]*#', '](#', 'g')) AS digest, count(*) AS n_rows, min(doc_id) AS first_key FROM documents GROUP BY 1""",
    "search_bm25": _search_sql(),
    "graph_neighbourhood": _REC + "," + _NEAR.format(to="dst", at="src", most=2) + " SELECT root, id, min(depth) AS depth FROM walk GROUP BY ALL",
    "graph_nodes": _REC + "," + _NEAR.format(to="dst", at="src", most=2) + " SELECT w.*, s.title, s.section_type FROM (SELECT root, id, min(depth) AS depth FROM walk GROUP BY ALL) w LEFT JOIN sec s ON s.spec || '#' || s.anchor = w.id",
    "query_refs": _CORPUS
    + """, b AS (SELECT spec, anchor, 'outgoing' AS direction, '' AS s, '' AS a, e.ord AS o, (SELECT min(id) FROM cref c WHERE c.spec = e.spec AND c.from_anchor = e.anchor AND c.t_spec = e.to_spec AND c.t_anchor = e.to_anchor AND c.ord = e.ord) AS i, dst AS item FROM edge e
UNION ALL SELECT to_spec, to_anchor, 'incoming', spec, anchor, 0, 0, src FROM edge)
SELECT spec, anchor, direction, count(*) AS total, CASE WHEN count(*) < 5 THEN string_agg(item, ' ' ORDER BY s, a, o, i, item) END AS items, CASE WHEN count(*) >= 5 THEN 'refs ' || spec || '#' || anchor || ' --direction ' || direction END AS command FROM b GROUP BY spec, anchor, direction""",
    "members_declared": _CORPUS
    + r""", t AS (SELECT spec, anchor, lower(regexp_extract(idl_text, '(?:interface|dictionary)\s+(?:mixin\s+)?(\w+)', 1)) AS owner_key, trim(unnest(string_split(regexp_extract(idl_text, '\{((?s:.*))\}', 1), E'\n'))) AS line FROM idl WHERE idl_text IS NOT NULL)
SELECT DISTINCT spec, anchor, owner_key, lower(regexp_extract(line, '(\w+)\s*(?:\(.*\))?\s*;$', 1)) AS field_key, CASE WHEN contains(line, '(') THEN 'method' ELSE 'attribute' END AS kind,
 trim(regexp_extract(regexp_replace(line, '^(readonly\s+)?(attribute\s+)?', ''), '^(.*?)\s*\w+\s*(?:\(.*\))?\s*;$', 1)) AS type,
 CASE WHEN NOT contains(line, '(') OR regexp_matches(line, '\(\s*\)') THEN 0 ELSE len(string_split(regexp_replace(regexp_extract(line, '\((.*)\)', 1), '<[^<>]*>|\{[^{}]*\}', '', 'g'), ',')) END AS n_args
FROM t WHERE line LIKE '%;' AND owner_key <> ''""",
    "state_selectors": _CORPUS
    + r""", ty AS (SELECT DISTINCT spec, anchor, name FROM idl WHERE owner IS NULL AND name IS NOT NULL), me AS (SELECT lower(owner) AS o, lower(name) AS m, spec, anchor FROM idl WHERE owner IS NOT NULL AND name IS NOT NULL),
h AS (SELECT 0 AS n, spec, anchor FROM ty WHERE CASE WHEN EXISTS (SELECT 1 FROM ty WHERE name = 'Segment') THEN name = 'Segment' ELSE lower(name) = 'segment' END
 UNION ALL SELECT 1, spec, anchor FROM ty WHERE CASE WHEN EXISTS (SELECT 1 FROM ty WHERE name = 'segment') THEN name = 'segment' ELSE lower(name) = 'segment' END
 UNION ALL SELECT 2, spec, anchor FROM me WHERE o = 'stageddigest' AND m = 'publish' UNION ALL SELECT 3, spec, anchor FROM me WHERE o = 'realm'
 UNION ALL SELECT 4, spec, anchor FROM sec WHERE lower(spec) = 'mesh-grid-301' AND starts_with(lower(anchor), 'sec-') UNION ALL SELECT 5, spec, anchor FROM sec WHERE lower(spec) = 'mesh-grid-301' AND anchor = 'no-such'),
k AS (SELECT * FROM (VALUES (0, 'type'), (1, 'type'), (2, 'field'), (3, 'type_glob'), (4, 'spec_glob'), (5, 'anchor'), (6, 'invalid'), (7, 'invalid'), (8, 'type'), (9, 'field')) v(n, kind)),
c AS (SELECT k.n, kind, count(h.n) AS m, min((spec, anchor)) AS f FROM k LEFT JOIN h USING (n) GROUP BY ALL)
SELECT n AS selector_no, kind, CASE WHEN kind = 'invalid' THEN 'invalid' WHEN m = 0 THEN 'not_found' WHEN kind LIKE '%glob' THEN 'list' WHEN m > 1 THEN 'ambiguous' ELSE kind END AS answer, m AS n_matches,
 CASE WHEN m = 1 AND kind NOT LIKE '%glob' THEN f[1] END AS spec, CASE WHEN m = 1 AND kind NOT LIKE '%glob' THEN f[2] END AS anchor FROM c""",
    "state_unlinked": _REC
    + SQL_PARTS["statements"].rsplit(" SELECT spec, anchor, step_no", 1)[0]
    + r""", nm AS (SELECT DISTINCT canonical_name AS field, trim(lower(replace(name, '`', ''))) AS n FROM idl WHERE owner IS NOT NULL AND name IS NOT NULL AND canonical_name IS NOT NULL),
op AS (SELECT node, step_path, trim(lower(replace(text, '`', ''))) AS low, list_transform(reads, lambda r: lower(r)) AS ls FROM st WHERE kind = 'opaque')
SELECT DISTINCT field, node, step_path FROM op JOIN nm ON contains(low, n) AND regexp_matches(low, '(^|[^\p{L}\p{N}_])' || regexp_escape(n) || '([^\p{L}\p{N}_]|$)') WHERE n <> '' AND NOT list_contains(ls, n) AND NOT list_contains(ls, lower(field))""",
    "graph_distances": _REC + "," + _NEAR.format(to="src", at="dst", most=3) + " SELECT root AS target, id, min(depth) AS distance FROM walk GROUP BY ALL",
    "trace_paths": _REC
    + """, lk AS (SELECT spec || '#' || from_anchor AS src, t_spec || '#' || t_anchor AS dst, ord, id FROM cref WHERE spec || '#' || from_anchor <> t_spec || '#' || t_anchor),
goal AS (SELECT spec || '#' || anchor AS id FROM sec WHERE section_type = 'algorithm'),
near AS (SELECT id, 0 AS d FROM goal UNION SELECT l.src, n.d + 1 FROM near n JOIN lk l ON l.dst = n.id WHERE n.d < 6), far AS (SELECT id, min(d) AS d FROM near GROUP BY id),
paths AS (SELECT spec || '#' || anchor AS source, [spec || '#' || anchor] AS way, CAST([] AS STRUCT(o INT, i BIGINT)[]) AS via FROM sec
  UNION ALL SELECT p.source, list_append(p.way, l.dst), list_append(p.via, {'o': l.ord, 'i': l.id}) FROM paths p JOIN lk l ON l.src = p.way[-1] JOIN far f ON f.id = l.dst AND len(p.way) + f.d <= 6 WHERE NOT list_contains(p.way, l.dst))
SELECT source, way[-1] AS target, row_number() OVER (PARTITION BY source, way[-1] ORDER BY len(via), via) AS path_no, len(via) AS hops, array_to_string(way, ' > ') AS way, array_to_string(list_transform(via, lambda v: v.i), ' ') AS via
FROM paths WHERE len(way) > 1 AND way[-1] IN (SELECT id FROM goal)""",
    "dependency_closure": _REC
    + """, d AS (SELECT DISTINCT spec, t_spec FROM cref WHERE spec <> t_spec), walk AS (SELECT spec AS root, spec AS id, 0 AS depth FROM cur UNION SELECT root, t_spec, depth + 1 FROM walk JOIN d ON d.spec = id WHERE depth < 40)
SELECT root, id, min(depth) AS depth FROM walk GROUP BY ALL""",
    "effect_calls": _CORPUS + _CALLS + "SELECT DISTINCT src, dst, relation, exec FROM calls",
    "effect_issues": _CORPUS
    + f"""SELECT DISTINCT node, code FROM (SELECT c.spec || '#' || from_anchor AS node, CASE WHEN t_spec NOT IN (SELECT spec FROM cur) THEN 'missing_spec' WHEN s.anchor IS NULL THEN 'missing_anchor' WHEN s.section_type = 'algorithm' AND NOT {_CALLED} THEN 'unresolved_invocation' END AS code
FROM cref c LEFT JOIN sec s ON s.spec = c.t_spec AND s.anchor = c.t_anchor WHERE c.kind = 'step') WHERE code IS NOT NULL""",
    "effect_occurrences": _rules_sql(" SELECT node, step_path, kind, params, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM hits GROUP BY ALL"),
    "effect_states": _rules_sql(_STATES + " SELECT node, kind, params, exec, min(distance) AS distance FROM walk GROUP BY ALL"),
    "effect_summaries": _rules_sql(
        _STATES
        + """, least_ AS (SELECT node, kind, params, exec, min(distance) AS distance FROM walk GROUP BY ALL),
s AS (SELECT node, kind, params, string_agg(DISTINCT CASE exec WHEN 0 THEN 'inline' WHEN 1 THEN 'unknown' ELSE 'separate' END, ',' ORDER BY CASE exec WHEN 0 THEN 'inline' WHEN 1 THEN 'unknown' ELSE 'separate' END) AS unordered, list_sort(list(DISTINCT exec)) AS xs, min(distance) AS distance FROM least_ GROUP BY ALL),
n AS (SELECT node, kind, params, count(DISTINCT step_path) AS local_sites FROM hits GROUP BY ALL),
r AS (SELECT s.node, s.kind, CASE WHEN s.kind IN ('scheduling.enqueue', 'scheduling.parallel', 'scheduling.promise-continuation') THEN 0 WHEN s.kind IN ('script.invoke', 'script.opportunity') THEN 1 WHEN s.kind IN ('event.fire', 'event.dispatch') THEN 2 ELSE 3 END AS category_rank,
  s.params, array_to_string(list_transform(xs, lambda x: ['inline', 'unknown', 'separate'][x + 1]), ',') AS executions, coalesce(local_sites, 0) AS local_sites, distance FROM s LEFT JOIN n USING (node, kind, params)),
o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY category_rank, kind, params) AS effect_no, greatest(count(*) OVER (PARTITION BY node) - 12, 0) AS omitted FROM r)
SELECT * FROM o WHERE effect_no <= 12"""
    ),
    "state_types": _REC
    + r""", f AS (SELECT lower(trim(owner)) AS ok, lower(trim(name)) AS fk, name, kind, spec, anchor FROM idl WHERE owner IS NOT NULL)
SELECT ok AS root, arg_min(name, (spec, anchor, kind, name)) AS name, ok AS owner_key, 0 AS depth, arg_min(kind, (spec, anchor, kind, name)) AS kind, 0 AS inherited FROM f GROUP BY ok, fk""",
    "checks_due": "SELECT spec_id, CAST(last_checked IS NULL OR last_checked < (SELECT max(last_checked) FROM update_checks) - INTERVAL 24 HOUR OR index_version IS DISTINCT FROM '8' AS int) AS is_due FROM update_checks",
    **{k: _REC + v for k, v in SQL_PARTS.items()},
}
