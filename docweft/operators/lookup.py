"""Lookups over the corpus, each for a whole table of targets or a stated list of queries at once."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions.columns import ascii_lower
from docweft.functions.markdown import transform_content
from docweft.operators.corpus import Corpus, first_rows, section_url

#: Lists of queries are literals of the plan; longer lists belong into a table.
MOST_QUERIES = 1000


def queries_frame(corpus: Corpus, queries: list[str]) -> DataFrame:
    """A stated set of queries: query_no, query."""
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    return corpus.tables.spark.createDataFrame(list(enumerate(queries)), "query_no int, query string")


# ---- names and addresses -------------------------------------------------------------------------------------------


def parse_target(target: Column) -> Column:
    """``SPEC#anchor`` or an address as struct(base, anchor, error): more than one ``#`` or none is an error."""
    parts = F.split(F.trim(target), "#", -1)
    whole = (F.size(parts) == 2) & (F.length(parts[0]) > 0) & (F.length(parts[1]) > 0)
    return F.struct(F.when(whole, parts[0]).alias("base"), F.when(whole, parts[1]).alias("anchor"), F.when(~F.coalesce(whole, F.lit(False)), F.lit("invalid_target")).alias("error"))


def url_key(url: Column) -> Column:
    """An address without scheme, ``www.``, page name, query and outer slashes, lower case: equal for one document."""
    bare = F.regexp_replace(F.lower(url), r"^[a-z]+://(?:www\.)?|[?#].*$", "")
    return F.rtrim(F.regexp_replace(bare, r"(?:index|overview)\.html$", ""), F.lit("/"))


def base_depth(keys: DataFrame) -> int:
    """The most path parts of any base key (_k); no deeper ancestor of an address can be a base."""
    return keys.agg(F.max(F.size(F.split("_k", "/")))).first()[0] or 1


def ancestors(key: Column, most: int) -> Column:
    """An address key and all that it lies below, of at most ``most`` path parts: array of struct(up, k), up counting the
    parts left out."""
    parts = F.split(key, "/")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))), lambda n: F.struct((F.size(parts) - n).alias("up"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("k")))


def resolve_targets(corpus: Corpus, targets: DataFrame, col: str = "target") -> DataFrame:
    """Each target with spec (registered name), anchor, base_url, provider and error (invalid_target, spec_not_found).

    A target names its spec by name, in any case, or by the address of its base or of a page at any depth below it; of
    several bases above a page the longest stands.
    """
    specs = corpus.tables.specs
    t = targets.withColumn("_t", parse_target(F.col(col))).select(*targets.columns, F.col("_t.base").alias("_b"), F.col("_t.anchor").alias("anchor"), F.col("_t.error").alias("_e"))
    is_url = F.col("_b").contains("/")
    key = F.when(is_url, url_key(F.col("_b"))).otherwise(F.lower("_b"))
    bases = specs.filter("base_url is not null").select(url_key(F.col("base_url")).alias("_k"), "name", "base_url", "provider")
    names = specs.select(F.lower("name").alias("_k"), "name", "base_url", "provider").unionByName(bases)
    first = F.min(F.struct("name", "base_url", "provider")).alias("_s")
    t = t.withColumn("_k", key)
    exact = t.select("_k").distinct().join(names.groupBy("_k").agg(first), "_k").select("_k", F.lit(0).alias("up"), "_s")
    below = t.filter(is_url).select("_k").distinct().select("_k", F.inline(ancestors(F.col("_k"), base_depth(bases)))).filter("up > 0")
    below = below.join(bases.groupBy(F.col("_k").alias("k")).agg(first), "k").select("_k", "up", "_s")
    found = exact.unionByName(below).groupBy("_k").agg(F.min_by("_s", "up").alias("_s"))
    return t.join(found, "_k", "left").select(*targets.columns, F.col("_s.name").alias("spec"), "anchor", F.col("_s.base_url").alias("base_url"), F.col("_s.provider").alias("provider"), F.coalesce("_e", F.when(F.col("_s").isNull(), F.lit("spec_not_found"))).alias("error"))


def specs_list(corpus: Corpus, providers: list[str] = ()) -> DataFrame:
    """The indexed specs: spec, base_url, provider, sha, commit_date; of the given providers (any case), none means all."""
    current = corpus.current
    if providers:
        current = current.filter(F.lower("provider").isin([p.lower() for p in providers]))
    return current.select("spec", "base_url", "provider", "sha", "commit_date")


# ---- sections ------------------------------------------------------------------------------------------------------


def children(corpus: Corpus) -> DataFrame:
    """spec, parent_anchor, anchor, child_no (1, 2, ... in document order) of all sections with a parent."""
    w = Window.partitionBy("spec", "parent_anchor").orderBy(F.col("ord").asc_nulls_last(), "anchor")
    return corpus.sections.filter("parent_anchor is not null").select("spec", "parent_anchor", "anchor", "title", F.row_number().over(w).alias("child_no"))


def list_headings(corpus: Corpus) -> DataFrame:
    """Headings in document order: spec, entry_no, anchor, title, depth (0 where unknown), number."""
    w = Window.partitionBy("spec").orderBy(F.col("ord").asc_nulls_last(), "anchor")
    return corpus.sections.filter("section_type = 'heading'").select("spec", F.row_number().over(w).alias("entry_no"), "anchor", "title", F.coalesce("depth", F.lit(0)).alias("depth"), "number")


def section_views(corpus: Corpus, with_text: bool = False) -> DataFrame:
    """Each section with its neighbours: titles of parent, previous and next, its children in order, the numbers of
    distinct sections it refers to and is referred to from, and its address. One join a neighbour, none per section."""
    s = corpus.sections
    title = s.select("spec", "anchor", F.coalesce("title", "anchor").alias("_t"))
    out = s
    for kind in ("parent", "prev", "next"):
        out = out.join(title.select("spec", F.col("anchor").alias(f"{kind}_anchor"), F.col("_t").alias(f"{kind}_title")), ["spec", f"{kind}_anchor"], "left")
    kids = children(corpus).groupBy("spec", "parent_anchor").agg(F.array_sort(F.collect_list(F.struct("child_no", "anchor"))).alias("_k")).select("spec", F.col("parent_anchor").alias("anchor"), F.array_join(F.col("_k.anchor"), " ").alias("children"))
    e = corpus.edges
    outgoing = e.groupBy("spec", "anchor").agg(F.count("*").alias("n_outgoing"))
    incoming = e.groupBy(F.col("to_spec").alias("spec"), F.col("to_anchor").alias("anchor")).agg(F.count("*").alias("n_incoming"))
    out = out.join(kids, ["spec", "anchor"], "left").join(outgoing, ["spec", "anchor"], "left").join(incoming, ["spec", "anchor"], "left")
    return out.select(
        "spec", "anchor", "title", "section_type", "parent_title", "prev_title", "next_title", "children", F.coalesce("n_outgoing", F.lit(0)).alias("n_outgoing"), F.coalesce("n_incoming", F.lit(0)).alias("n_incoming"), section_url(F.col("base_url"), F.col("provider"), F.col("anchor")).alias("url"), *(["content_text"] if with_text else [])
    )


def section_tree(corpus: Corpus) -> DataFrame:
    """The tree that document order and heading depth imply: tree_parent, tree_prev and tree_next of each section.

    A heading hangs below the nearest earlier heading of smaller depth, anything else below the nearest earlier heading;
    neighbours share parent and depth. Depths run from 1 to 6, so the last heading of each depth is carried along by six
    running windows over one sort, instead of looking back row by row.
    """
    w = Window.partitionBy("spec").orderBy(F.col("ord").asc_nulls_last(), "anchor").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("spec").orderBy(F.col("ord").asc_nulls_last(), "anchor")
    heading = (F.col("section_type") == "heading") & F.col("depth").isNotNull()
    s = corpus.sections.select("spec", "anchor", "ord", "section_type", "depth", F.row_number().over(order).alias("_n"))
    for d in range(1, 7):
        s = s.withColumn(f"_h{d}", F.last(F.when(heading & (F.col("depth") == d), F.struct("_n", "anchor")), True).over(w))
    above = [F.when(~heading | (F.col("depth") > d), F.col(f"_h{d}")) for d in range(1, 7)]
    s = s.withColumn("tree_parent", F.greatest(*above)["anchor"]).withColumn("_d", F.when(heading, F.col("depth")))
    near = Window.partitionBy("spec", "tree_parent", "_d").orderBy("_n")
    return s.select("spec", "anchor", "tree_parent", F.lag("anchor").over(near).alias("tree_prev"), F.lead("anchor").over(near).alias("tree_next"))


def exists(corpus: Corpus, targets: DataFrame) -> DataFrame:
    """Whether each (spec, anchor) of ``targets`` stands in the current snapshots: exists_now, section_type."""
    s = corpus.sections.select("spec", "anchor", "section_type")
    return targets.join(s, ["spec", "anchor"], "left").select(*targets.columns, F.col("section_type").isNotNull().cast("int").alias("exists_now"), "section_type")


def like_of_glob(pattern: str) -> str:
    """``*`` becomes ``%``; ``%`` and ``_`` stay wildcards; the escape sign of LIKE is made a plain character."""
    return pattern.replace("\\", "\\\\").replace("*", "%")


def anchors(corpus: Corpus, patterns: list[str], spec: str | None = None, limit: int = 50) -> DataFrame:
    """For each glob the first ``limit`` matching sections by spec and document order, then only the first of each
    anchor: query_no, anchor, spec, title, section_type. Letters A to Z match in either case."""
    q = queries_frame(corpus, [like_of_glob(p) for p in patterns])
    s = corpus.sections.select("spec", "anchor", "title", "section_type", "ord", "id")
    if spec is not None:
        s = s.filter(F.lower("spec") == spec.lower())
    hit = s.join(F.broadcast(q), F.like(ascii_lower(s["anchor"]), ascii_lower(q["query"])))
    w = Window.partitionBy("query_no").orderBy("spec", F.col("ord").asc_nulls_last(), "anchor")
    top = hit.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    return first_rows(top.select("query_no", "anchor", "spec", "title", "section_type", "_n"), ["query_no", "anchor"], ["_n"]).drop("_n")


def idl(corpus: Corpus, queries: list[str], spec: str | None = None, limit: int = 20) -> DataFrame:
    """Definitions for names like ``Owner.member()``, best first: query_no, rank_no, score, spec, anchor, canonical_name,
    kind, title. Scores: canonical name 100, name 95, anchor 90, part of the canonical name 80, part of the name 70."""
    q = queries_frame(corpus, [_idl_query(x) for x in queries])
    d = corpus.idl_defs
    if spec is not None:
        d = d.filter(F.lower("spec") == spec.lower())
    name, canonical, anchor, ask = (ascii_lower(F.col(c)) for c in ("name", "canonical_name", "anchor", "query"))
    score = F.when(canonical == ask, 100).when(name == ask, 95).when(anchor == ask, 90).when(F.contains(canonical, ask), 80).when(F.contains(name, ask), 70)
    hit = d.join(F.broadcast(q), F.contains(canonical, ask) | F.contains(name, ask) | (anchor == ask)).withColumn("score", score)
    titles = corpus.sections.select("spec", "anchor", "title")
    w = Window.partitionBy("query_no").orderBy(F.desc("score"), "spec", "canonical_name", F.col("ord").asc_nulls_last(), "anchor", "kind")
    top = hit.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= limit)
    return top.join(titles, ["spec", "anchor"], "left").select("query_no", "rank_no", "score", "spec", "anchor", "canonical_name", "kind", "title")


def _idl_query(query: str) -> str:
    owner, dot, member = query.strip().rpartition(".")
    member = re.sub(r"(\(\))+$", "", member.strip())
    return f"{owner.strip()}.{member}" if dot else member


#: The shorthand search looks at the first so many sections by spec and document order.
SHORTHAND_ROWS = 1000


def shorthand(corpus: Corpus, queries: list[str], limit: int = 10) -> DataFrame:
    """Sections meant by words or by ``owner.member``, best first: query_no, rank_no, score, spec, anchor, title,
    section_type. Among the first SHORTHAND_ROWS sections whose anchor or title holds the word or member."""
    rows = []
    for i, x in enumerate(queries):
        x = x.strip().lower()
        owner, dot, member = x.partition(".")
        rows.append((i, x, owner.strip() if dot else None, member.strip() if dot else None, member if dot else x))
    q = corpus.tables.spark.createDataFrame(rows, "query_no int, q string, owner string, member string, part string").filter("q <> ''")
    a, t = ascii_lower(F.col("anchor")), ascii_lower(F.coalesce("title", F.lit("")))
    s = corpus.sections.select("spec", "anchor", "title", "section_type", "ord").withColumns({"a": a, "t": t})
    hit = s.join(F.broadcast(q), F.contains(s["a"], q["part"]) | F.contains(s["t"], q["part"]))
    first = Window.partitionBy("query_no").orderBy("spec", F.col("ord").asc_nulls_last(), "anchor")
    hit = hit.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= SHORTHAND_ROWS)
    give = lambda cond, points: F.when(cond, points).otherwise(0)
    A, T, O, M, Q = (F.col(c) for c in ("a", "t", "owner", "member", "q"))
    kind = F.col("section_type")
    plain = give(A == Q, 100) + give(T == Q, 90) + give(F.contains(A, Q), 40) + give(F.contains(T, Q), 30) + give(kind.isin("idl", "definition"), 5)
    dotted = (
        give(F.contains(A, M), 40) + F.when(F.contains(A, O), 35).otherwise(-20) + give(F.contains(A, F.concat(O, F.lit("-"), M)), 50) + give(F.endswith(A, F.concat(F.lit("-"), M)), 10)
        + F.when(T == M, 50).when(F.contains(T, M), 20).otherwise(0) + F.when(kind == "idl", 10).when(kind == "definition", 5).otherwise(0)
    )
    scored = hit.withColumn("score", F.when(O.isNull(), plain).otherwise(dotted)).filter("score > 0")
    w = Window.partitionBy("query_no").orderBy(F.desc("score"), "spec", "anchor")
    return scored.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= limit).select("query_no", "rank_no", "score", "spec", "anchor", "title", "section_type")


# ---- references ----------------------------------------------------------------------------------------------------


def ref_edges(corpus: Corpus, targets: DataFrame | None = None, direction: str = "outgoing", kind: str | None = None) -> DataFrame:
    """References from (outgoing) or to (incoming) each target section with their step context and edge_no.

    Without ``targets``, of all sections. A kind excludes references of unknown kind. edge_no counts the references
    between the same two sections in the order of ord.
    """
    r = corpus.refs
    if kind is not None:
        r = r.filter(F.col("kind") == kind)
    if direction == "outgoing":
        out = r.select("spec", F.col("from_anchor").alias("anchor"), "to_spec", "to_anchor", "kind", "step_path", "step_text", "guard_path", "call_site_id", "ord", "id")
        other = ["to_spec", "to_anchor"]
    else:
        out = r.select(F.col("to_spec").alias("spec"), F.col("to_anchor").alias("anchor"), F.col("spec").alias("from_spec"), "from_anchor", "kind", "step_path", "step_text", "guard_path", "call_site_id", "ord", "id")
        other = ["from_spec", "from_anchor"]
    if targets is not None:
        out = out.join(targets.select("spec", "anchor").distinct(), ["spec", "anchor"], "left_semi")
    # numbered within (target, source): no window ever holds a hot target's rows
    near = Window.partitionBy("spec", "anchor", *other).orderBy(F.col("ord").asc_nulls_last(), "id")
    return out.withColumn("edge_no", F.row_number().over(near)).drop("ord")


def algorithm_calls(corpus: Corpus) -> DataFrame:
    """Calls between algorithms: distinct (spec, anchor, to_spec, to_anchor, step_path) of step references whose target
    is an algorithm of the corpus, with the first ord."""
    targets = corpus.sections.filter("section_type = 'algorithm'").select(F.col("spec").alias("to_spec"), F.col("anchor").alias("to_anchor"))
    return (
        corpus.refs.filter("kind = 'step'")
        .join(targets, ["to_spec", "to_anchor"], "left_semi")
        .groupBy("spec", F.col("from_anchor").alias("anchor"), "to_spec", "to_anchor", "step_path")
        .agg(F.min("ord").alias("first_ord"))
    )


def spec_dependencies(corpus: Corpus) -> DataFrame:
    """How many references lead from each spec to each other spec: spec, to_spec, n_refs."""
    return corpus.refs.filter("to_spec is not null and spec <> to_spec").groupBy("spec", "to_spec").agg(F.count("*").alias("n_refs"))


# ---- pull requests -------------------------------------------------------------------------------------------------


def pr_overlay(corpus: Corpus) -> DataFrame:
    """The sections of each pull request over those of its merge base: pr_snapshot_id, anchor, section_id, from_pr.

    The merge base is the full snapshot of the same spec with sha = merge_base_sha; without one only the request's own
    rows stand. Of equal anchors the request's wins.
    """
    base = corpus.full.select("spec_id", F.lower("sha").alias("_sha"), F.col("snapshot_id").alias("base_id"))
    prs = corpus.tables.snapshots.filter("pr_number is not null").select(F.col("id").alias("pr_id"), "spec_id", F.lower("merge_base_sha").alias("_sha")).join(base, ["spec_id", "_sha"], "left")
    sources = prs.select(F.col("pr_id").alias("pr_snapshot_id"), F.explode(F.array(F.struct(F.col("pr_id").alias("sid"), F.lit(1).alias("from_pr")), F.struct(F.col("base_id").alias("sid"), F.lit(0).alias("from_pr")))).alias("x")).select("pr_snapshot_id", F.col("x.sid").alias("snapshot_id"), "x.from_pr").filter("snapshot_id is not null")
    rows = corpus.tables.sections.filter("anchor is not null").select("snapshot_id", "anchor", F.col("id").alias("section_id"), "ord").join(sources, "snapshot_id")
    rows = rows.withColumn("_late", 1 - F.col("from_pr"))
    return first_rows(rows.select("pr_snapshot_id", "anchor", "_late", "ord", "section_id", "from_pr"), ["pr_snapshot_id", "anchor"], ["_late", "ord", "section_id"]).select("pr_snapshot_id", "anchor", "section_id", "from_pr")


def pr_pages(corpus: Corpus) -> DataFrame:
    """The pages of each pull request: snapshot_id, page_no (from 1), page; empty entries are skipped."""
    pages = F.filter(F.split(F.col("pr_pages"), ","), lambda p: p != "")
    return corpus.tables.snapshots.filter("pr_number is not null").select(F.col("id").alias("snapshot_id"), F.posexplode(pages).alias("_i", "page")).select("snapshot_id", (F.col("_i") + 1).alias("page_no"), "page")


# ---- targets outside the corpus, call sites, callers ---------------------------------------------------------------


def unindexed_specs(corpus: Corpus) -> DataFrame:
    """Specs that references name but the corpus does not hold: to_spec, n_refs, n_specs (that refer to it)."""
    r = corpus.refs.filter("to_spec is not null").groupBy("to_spec", "spec").agg(F.count("*").alias("n"))
    gone = r.join(corpus.current.select(F.col("spec").alias("to_spec")), "to_spec", "left_anti")
    return gone.groupBy("to_spec").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_specs"))


def call_sites(corpus: Corpus) -> DataFrame:
    """The addresses of call sites: id (of the reference), call_site_id, url. An id without a colon names its target
    from anywhere, so it is no call site."""
    base = corpus.current.select("spec", "base_url", "provider")
    r = corpus.refs.filter(F.col("call_site_id").contains(":")).select("id", "spec", "call_site_id")
    return r.join(base, "spec").select("id", "call_site_id", section_url(F.col("base_url"), F.col("provider"), F.col("call_site_id")).alias("url"))


def callers(corpus: Corpus, limit: int = 20) -> DataFrame:
    """Who calls each algorithm: to_spec, to_anchor, n_calls, n_callers, more (callers beyond the first ``limit``),
    callers (the first ones by name). Calls are combined by caller before any come together by callee."""
    c = algorithm_calls(corpus).groupBy("to_spec", "to_anchor", F.concat("spec", F.lit("#"), "anchor").alias("caller")).agg(F.count("*").alias("n"))
    counts = c.groupBy("to_spec", "to_anchor").agg(F.sum("n").alias("n_calls"), F.count("*").alias("n_callers"))
    w = Window.partitionBy("to_spec", "to_anchor").orderBy("caller")
    first = c.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).groupBy("to_spec", "to_anchor").agg(F.array_join(F.array_sort(F.collect_list("caller")), " ").alias("callers"))
    return counts.join(first, ["to_spec", "to_anchor"]).select("to_spec", "to_anchor", "n_calls", "n_callers", F.greatest(F.col("n_callers") - limit, F.lit(0)).alias("more"), "callers")


def contents(corpus: Corpus, links: str = "short", asides: bool = False) -> DataFrame:
    """Section contents reshaped for readers: spec, anchor, content (see ``functions.markdown.transform_content``)."""
    @F.pandas_udf("string")
    def reshape(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: transform_content(t, links, asides), na_action="ignore")

    return corpus.sections.select("spec", "anchor", reshape("content_text").alias("content"))


#: From so many references on, a section's view tells their number and the request that lists them. Fixed value.
REFS_LISTED_BELOW = 5


def reference_lists(corpus: Corpus) -> DataFrame:
    """Per section and direction: spec, anchor, direction, total, items (``spec#anchor`` in order, if there are fewer than
    REFS_LISTED_BELOW) or command (the request for the whole list).

    Outgoing ones are ordered by their place, incoming ones by spec and anchor. Ranks are limited where they are computed,
    so a section with very many references gathers only the few that can be shown.
    """
    e = corpus.edges
    name = lambda s, a: F.concat(F.col(s), F.lit("#"), F.col(a))
    out = e.select("spec", "anchor", F.lit("outgoing").alias("direction"), F.struct(F.lit("").alias("s"), F.lit("").alias("a"), "ord", "id").alias("o"), name("to_spec", "to_anchor").alias("item"))
    back = e.select(F.col("to_spec").alias("spec"), F.col("to_anchor").alias("anchor"), F.lit("incoming").alias("direction"), F.struct(F.col("spec").alias("s"), F.col("anchor").alias("a"), "ord", "id").alias("o"), name("spec", "anchor").alias("item"))
    both = out.unionByName(back)
    key = ["spec", "anchor", "direction"]
    total = both.groupBy(*key).agg(F.count("*").alias("total"))
    w = Window.partitionBy(*key).orderBy("o", "item")
    few = both.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") < REFS_LISTED_BELOW).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "item"))), lambda x: x["item"]), " ").alias("items"))
    small = F.col("total") < REFS_LISTED_BELOW
    return total.join(few, key).select(*key, "total", F.when(small, F.col("items")).alias("items"), F.when(~small, F.concat(F.lit("refs "), "spec", F.lit("#"), "anchor", F.lit(" --direction "), "direction")).alias("command"))
