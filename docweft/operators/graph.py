"""The reference graph: neighbourhoods, distances, paths and closures, for many roots at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.operators.corpus import Corpus, node
from docweft.operators.runtime import cut, union


def node_edges(corpus: Corpus) -> DataFrame:
    """Distinct links as src, dst (``spec#anchor``) with pos, their place among the links of src."""
    return corpus.edges.select(node().alias("src"), node("to_spec", "to_anchor").alias("dst"), "ord", "id")


def pattern_regex(pattern: str) -> str:
    """A node pattern as a regular expression: ``re:`` leads a raw one; else ``*`` and ``?`` are wildcards."""
    if pattern.startswith("re:"):
        re.compile(pattern[3:])
        return pattern[3:]
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def _matches(c: Column, include: list[str], exclude: list[str]) -> Column:
    yes = F.lit(True)
    if include:
        yes = F.lit(False)
        for p in include:
            yes = yes | c.rlike(pattern_regex(p))
    for p in exclude:
        yes = yes & ~c.rlike(pattern_regex(p))
    return yes


def _numbered(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, links): name, n, is_root of each node, with n in the order of names; links with their ends as numbers."""
    links = edges.filter("src is not null and dst is not null")
    ends = F.explode(F.array("src", "dst")).alias("name")
    known = links.select(ends, F.lit(False).alias("is_root")).unionByName(roots.select(F.col("id").alias("name"), F.lit(True).alias("is_root")).filter("name is not null"))
    names = cut(known.groupBy("name").agg(F.max("is_root").alias("is_root")).orderBy("name").select("name", F.monotonically_increasing_id().alias("n"), "is_root"), bare=True)
    for end in ("src", "dst"):
        links = links.join(names.select(F.col("name").alias(end), F.col("n").alias(f"_{end}")), end)
    return names, cut(links.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "ord", "id"), bare=True)


def _named(rows: DataFrame, names: DataFrame, *cols: str) -> DataFrame:
    """The rows with names for the numbers in cols."""
    for c in cols:
        rows = rows.join(names.select(F.col("n").alias(c), F.col("name").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return rows


def _first_links(links: DataFrame, direction: str, max_nodes: int | None) -> DataFrame:
    """at, to, no: the nodes to which each node leads, numbered in the order of its links, outgoing before incoming.

    With a cap only the first ``max_nodes`` + 1 of a node are kept. No root needs more: a node is admitted or shut out
    only after all that stand before it are seen, and at most ``max_nodes`` ever are. Without a cap no is 1.
    """
    ways = []
    if direction != "incoming":
        ways.append(links.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.struct(F.lit(0).alias("way"), F.lit(0).cast("bigint").alias("from"), "ord", "id").alias("pos")))
    if direction != "outgoing":
        ways.append(links.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.struct(F.lit(1).alias("way"), F.col("src").alias("from"), "ord", "id").alias("pos")))
    steps = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    if max_nodes is None:
        return steps.select("at", "to", F.lit(1).alias("no"))
    w = Window.partitionBy("at").orderBy("pos", "to")
    first = steps.groupBy("at", "to").agg(F.min("pos").alias("pos")).withColumn("no", F.row_number().over(w))
    return cut(first.filter(F.col("no") <= max_nodes + 1).select("at", "to", "no"), bare=True)


def _links_within(seen: DataFrame, links: DataFrame, direction: str, max_depth: int) -> DataFrame:
    """root, src, dst of the links between nodes that a root has seen, where the walk met them: from nodes above max_depth.

    Each link is looked up from its end with fewer links, so a hub that many roots have seen is never opened.
    """
    pairs = links.select("src", "dst").distinct()
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").agg(F.count("*").alias("_links"))
    for end in ("src", "dst"):
        pairs = pairs.join(ends.select(F.col("n").alias(end), F.col("_links").alias(f"_{end}")), end)
    out = F.struct("_src", "src") <= F.struct("_dst", "dst")
    arcs = pairs.select(F.when(out, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(out, F.col("dst")).otherwise(F.col("src")).alias("hi"), out.alias("out"))
    lo, hi = seen.select("root", F.col("id").alias("lo"), F.col("depth").alias("_lo")), seen.select("root", F.col("id").alias("hi"), F.col("depth").alias("_hi"))
    from_src, from_dst = F.when(F.col("out"), F.col("_lo")).otherwise(F.col("_hi")), F.when(F.col("out"), F.col("_hi")).otherwise(F.col("_lo"))
    met = {"outgoing": from_src, "incoming": from_dst, "both": F.least("_lo", "_hi")}[direction] < max_depth
    return lo.join(arcs, "lo").join(hi, ["root", "hi"]).filter(met).select("root", F.when(F.col("out"), F.col("lo")).otherwise(F.col("hi")).alias("src"), F.when(F.col("out"), F.col("hi")).otherwise(F.col("lo")).alias("dst"))


def neighbourhoods(edges: DataFrame, roots: DataFrame, direction: str = "outgoing", max_depth: int = 2, max_nodes: int | None = 150, include: list[str] = (), exclude: list[str] = (), same_spec_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph around each root: (nodes, links).

    nodes: root, id, depth, role, truncated; links: root, src, dst. Breadth first from the root to ``max_depth``; a node
    is admitted in the order in which a queue would reach it (rank of its predecessor, outgoing before incoming, place
    of the link) until ``max_nodes`` stand; then truncated is true. With patterns, nodes that match (and the root) are
    kept together with the bridges on their shortest undirected paths to the root; of several predecessors the least id
    is the bridge. Roles: root, matched, bridge; null without patterns. ``same_spec_only`` keeps to the root's spec.
    Links with a null end are left out.

    One round per level for all roots together, on numbers in place of names; each round joins the frontier with the
    links and writes the nodes that are new. ``max_nodes`` None sets no cap. With a cap, each node brings only its first
    ``max_nodes`` + 1 neighbours, so a hub in many frontiers costs no more than they.
    """
    if max_nodes is not None and max_nodes <= 0:
        raise ValueError("max_nodes must be greater than 0")
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError("direction is outgoing, incoming or both")
    spec_of = lambda c: F.substring_index(c, "#", 1)
    if same_spec_only:  # all that a root reaches is in its spec, so the links within specs are those within its own
        edges = edges.filter(spec_of(F.col("src")) == spec_of(F.col("dst")))
    names, numbered = _numbered(edges, roots)
    steps = _first_links(numbered, direction, max_nodes)
    parts = [cut(names.filter("is_root").select(F.col("n").alias("root"), F.col("n").alias("id"), F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("rank")), bare=True)]
    stands = F.lit(True) if max_nodes is None else F.col("rank") <= max_nodes  # the first node shut out is kept as a mark
    for depth in range(1, max_depth + 1):
        last = parts[-1].filter(F.col("depth") == depth - 1)
        front = last.filter(stands).join(last.filter(~stands).select("root"), "root", "left_anti") if max_nodes is not None else last
        place = F.lit(1).cast("bigint") if max_nodes is None else F.col("rank") * (max_nodes + 2) + F.col("no")
        walked = front.select("root", F.col("id").alias("at"), "rank").join(steps, "at").select("root", F.col("to").alias("id"), place.alias("_o"))
        seen = union(parts).filter(stands).select("root", "id", F.lit(0).cast("bigint").alias("_o"))
        new = walked.unionByName(seen).groupBy("root", "id").agg(F.min("_o").alias("_o")).withColumn("rank", F.lit(1).cast("bigint"))
        if max_nodes is not None:  # what is seen comes first, so that a rank counts on from there
            new = new.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("_o")).cast("bigint")).filter(F.col("rank") <= max_nodes + 1)
        new = cut(new.filter("_o > 0").select("root", "id", F.lit(depth).alias("depth"), "rank"), bare=True)
        if new.isEmpty():
            break
        parts.append(new)
    nodes = union(parts)
    over = nodes.filter(~stands).select("root", F.lit(True).alias("truncated"))
    nodes = nodes.filter(stands).select("root", "id", "depth")
    links = _links_within(nodes, numbered, direction, max_depth)
    if include or exclude:
        matched = names.filter(_matches(F.col("name"), list(include), list(exclude))).select(F.col("n").alias("id"))
        links = cut(links, bare=True)
        keep = _with_bridges(nodes, links, matched)
        nodes = nodes.join(keep, ["root", "id"])
        links = links.join(keep.select("root", F.col("id").alias("src")), ["root", "src"], "left_semi").join(keep.select("root", F.col("id").alias("dst")), ["root", "dst"], "left_semi")
    else:
        nodes = nodes.withColumn("role", F.lit(None).cast("string"))
    nodes = nodes.join(over, "root", "left") if max_nodes is not None else nodes.withColumn("truncated", F.lit(False))
    nodes = nodes.withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    return _named(nodes, names, "root", "id").select("root", "id", "depth", "role", "truncated"), _named(links, names, "root", "src", "dst").select("root", "src", "dst")


def _with_bridges(seen: DataFrame, links: DataFrame, matched: DataFrame) -> DataFrame:
    """root, id, role of matched nodes and of those on their shortest undirected paths to the root. Ids are numbers from 0."""
    both = links.select("root", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(links.select("root", F.col("dst").alias("a"), F.col("src").alias("b")))
    none = F.lit(-1).cast("bigint").alias("up")
    parts = [cut(seen.filter("depth = 0").select("root", "id", none, F.lit(0).alias("d")), bare=True)]
    d = 0
    while True:  # the undirected distance from the root may exceed max_depth only where links turn back
        d += 1
        met = parts[-1].filter(F.col("d") == d - 1).select("root", F.col("id").alias("a")).join(both, ["root", "a"]).select("root", F.col("b").alias("id"), F.col("a").alias("up"))
        nxt = met.unionByName(union(parts).select("root", "id", none)).groupBy("root", "id").agg(F.min("up").alias("up")).filter("up >= 0")
        nxt = cut(nxt.withColumn("d", F.lit(d)), bare=True)
        if nxt.isEmpty():
            break
        parts.append(nxt)
    tree = union(parts).select("root", "id", "up")
    tree = cut(tree.join(matched.withColumn("m", F.lit(True)), "id", "left").select("root", "id", "up", ((F.col("id") == F.col("root")) | F.coalesce("m", F.lit(False))).alias("m")), bare=True)
    kept = [tree.filter("m")]
    for _ in range(d):
        ups = kept[-1].filter("up >= 0").select("root", F.col("up").alias("id")).distinct().join(union(kept).select("root", "id"), ["root", "id"], "left_anti")
        more = cut(tree.join(ups, ["root", "id"], "left_semi").select("root", "id", "up", "m"), bare=True)
        if more.isEmpty():
            break
        kept.append(more)
    return union(kept).select("root", "id", F.when(F.col("id") == F.col("root"), "root").when(F.col("m"), "matched").otherwise("bridge").alias("role"))


def distances(edges: DataFrame, targets: DataFrame, max_depth: int = 6) -> DataFrame:
    """The least number of links from each node to each target, up to ``max_depth``: target, id, distance."""
    seen = cut(targets.select(F.col("id").alias("target")).filter("target is not null").distinct().select("target", F.col("target").alias("id"), F.lit(0).alias("distance")))
    back = edges.select(F.col("dst").alias("_at"), F.col("src").alias("id"))
    for depth in range(1, max_depth + 1):
        front = seen.filter(F.col("distance") == depth - 1).select("target", F.col("id").alias("_at"))
        new = front.join(back, "_at").select("target", "id").distinct().join(seen.select("target", "id"), ["target", "id"], "left_anti")
        new = cut(new.withColumn("distance", F.lit(depth)))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
    return seen


def simple_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 6, max_paths: int = 20) -> DataFrame:
    """Simple paths of at most ``max_depth`` links between pairs of nodes: source, target, path_no, hops, path, via.

    ``edges`` has src, dst and any order columns ord, id; parallel links are paths of their own (via holds their ids).
    A path ends when it meets its target, and never meets a node twice; a pair of equal nodes has none. Of each pair the
    first ``max_paths`` in depth-first order (by the order of links) are kept, then numbered by length.

    Paths grow level by level; one that cannot reach its target within the rest of the depth is cut at once by a join
    with the distances to the target.
    """
    pairs = pairs.select("source", "target").filter("source is not null and target is not null and source <> target").distinct()
    dist = distances(edges.select("src", "dst").distinct(), pairs.select(F.col("target").alias("id")), max_depth)
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.struct("ord", "id").alias("pos"), F.col("id").alias("via_id"))
    open_ = cut(pairs.select("source", "target", F.col("source").alias("at"), F.array("source").alias("path"), F.expr("cast(array() as array<struct<ord:int,id:bigint>>)").alias("order"), F.expr("cast(array() as array<bigint>)").alias("via")))
    done = []
    for depth in range(1, max_depth + 1):
        left = dist.select("target", F.col("id").alias("to"), F.col("distance").alias("left"))
        grown = (
            open_.join(step, "at")
            .filter(~F.array_contains("path", F.col("to")))
            .join(left.filter(F.col("left") <= max_depth - depth), ["target", "to"])
            .select("source", "target", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), F.concat("order", F.array(F.struct(F.col("pos.ord").cast("int").alias("ord"), F.col("pos.id").cast("bigint").alias("id")))).alias("order"), F.concat("via", F.array(F.col("via_id").cast("bigint"))).alias("via"))
        )
        grown = cut(grown)
        done.append(grown.filter("at = target"))
        open_ = grown.filter("at <> target")
        if open_.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    w = Window.partitionBy("source", "target").orderBy("order")
    first = out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_paths)
    by_length = Window.partitionBy("source", "target").orderBy(F.size("via"), "_n")
    return first.select("source", "target", F.row_number().over(by_length).alias("path_no"), F.size("via").alias("hops"), "path", "via")


def traces(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = 6) -> DataFrame:
    """Every simple path of at most ``max_depth`` links from any source to any target: source, target, path_no, hops,
    path, via. The rows of simple_paths for all pairs, without its limit of paths.

    edges: src, dst, ord, id, where parallel links are paths of their own; sources, targets: id. Paths grow once a source
    for all its targets; one that can reach no target within the rest of the depth is cut at once.
    """
    goal = targets.select("id").filter("id is not null").distinct()
    back = edges.select("src", "dst").distinct().unionByName(goal.select(F.col("id").alias("src"), F.lit("").alias("dst")))
    near = distances(back, edges.sparkSession.createDataFrame([("",)], "id string"), max_depth + 1).filter("distance > 0").select(F.col("id").alias("to"), (F.col("distance") - 1).alias("_left"))
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("ord").cast("int").alias("ord"), F.col("id").cast("bigint").alias("id"))
    open_ = sources.select(F.col("id").alias("source")).filter("source is not null").distinct().select("source", F.col("source").alias("at"), F.array("source").alias("path"), F.expr("cast(array() as array<struct<ord:int,id:bigint>>)").alias("order"))
    done = []
    for depth in range(1, max_depth + 1):
        grown = open_.join(step, "at").filter(~F.array_contains("path", F.col("to"))).join(near.filter(F.col("_left") <= max_depth - depth), "to")
        open_ = cut(grown.select("source", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), F.concat("order", F.array(F.struct("ord", "id"))).alias("order"), (F.col("_left") == 0).alias("ends")))
        done.append(open_.filter("ends").drop("ends"))
        open_ = open_.drop("ends")
        if open_.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    w = Window.partitionBy("source", "target").orderBy(F.size("order"), "order")
    return out.withColumn("target", F.col("at")).select("source", "target", F.row_number().over(w).alias("path_no"), F.size("order").alias("hops"), "path", F.col("order.id").alias("via"))


def closure(links: DataFrame, roots: DataFrame, cap: int = 64) -> DataFrame:
    """What each root depends on, breadth first, heavier links first: root, id, depth, rank (at most ``cap`` a root).

    links: src, dst, n. The root itself has rank 1.
    """
    seen = cut(roots.select(F.col("id").alias("root")).distinct().select("root", F.col("root").alias("id"), F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("rank")))
    depth = 0
    while True:
        depth += 1
        front = seen.filter(F.col("depth") == depth - 1).select("root", F.col("id").alias("src"), F.col("rank").alias("_r"))
        new = front.join(links, "src").groupBy("root", F.col("dst").alias("id")).agg(F.min(F.struct("_r", (-F.col("n")).alias("n"), F.col("dst").alias("name"))).alias("_o")).join(seen.select("root", "id"), ["root", "id"], "left_anti")
        have = seen.groupBy("root").agg(F.count("*").alias("_have"))
        w = Window.partitionBy("root").orderBy("_o")
        new = new.withColumn("_n", F.row_number().over(w)).join(have, "root").withColumn("rank", (F.col("_n") + F.col("_have")).cast("bigint")).filter(F.col("rank") <= cap)
        new = cut(new.select("root", "id", F.lit(depth).alias("depth"), "rank"))
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new))


def mermaid(nodes: DataFrame, links: DataFrame, by: str = "root") -> DataFrame:
    """One flowchart text per root: nodes by id, then links by their ends."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit("'")), F.lit('"'))
    name = lambda c: F.concat(F.lit("n"), F.hex(F.xxhash64(c)))
    lines = nodes.select(by, F.lit(0).alias("_k"), F.col("id").alias("_s"), F.concat(F.lit("  "), name(F.col("id")), F.lit("["), quote(F.col("id")), F.lit("]")).alias("_line")).unionByName(
        links.select(by, F.lit(1).alias("_k"), F.concat_ws(" ", "src", "dst").alias("_s"), F.concat(F.lit("  "), name(F.col("src")), F.lit(" --> "), name(F.col("dst"))).alias("_line"))
    )
    return lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_k", "_s", "_line"))).alias("_l")).select(by, F.concat(F.lit("flowchart LR\n"), F.array_join("_l._line", "\n")).alias("diagram"))


def dot(nodes: DataFrame, links: DataFrame, by: str = "root") -> DataFrame:
    """One DOT text per root."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = nodes.select(by, F.lit(0).alias("_k"), F.concat(F.lit("  "), quote(F.col("id")), F.lit(";")).alias("_line")).unionByName(links.select(by, F.lit(1).alias("_k"), F.concat(F.lit("  "), quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(";")).alias("_line")))
    return lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_k", "_line"))).alias("_l")).select(by, F.concat(F.lit("digraph g {\n"), F.array_join("_l._line", "\n"), F.lit("\n}")).alias("diagram"))


def with_metadata(nodes: DataFrame, corpus: Corpus) -> DataFrame:
    """Nodes with title and section_type of their section in the current corpus, null where it has none."""
    known = corpus.sections.select(node().alias("id"), "title", "section_type")
    return nodes.join(known, "id", "left").select(*nodes.columns, "title", "section_type")


def trace_hops(traces_: DataFrame, refs: DataFrame) -> DataFrame:
    """The links of each trace in order: source, target, path_no, hop_no, src, dst, kind, step_path, step_text.

    refs: id, kind, step_path, step_text. ``edges`` detail is src and dst, ``compact`` adds kind and step_path, ``verbose``
    is all.
    """
    each = traces_.select("source", "target", "path_no", "path", F.posexplode("via").alias("_i", "id"))
    r = refs.select("id", "kind", "step_path", "step_text")
    return each.join(r, "id", "left").select("source", "target", "path_no", (F.col("_i") + 1).alias("hop_no"), F.get("path", F.col("_i")).alias("src"), F.get("path", F.col("_i") + 1).alias("dst"), "kind", "step_path", "step_text")


def flow_mermaid(rows: DataFrame) -> DataFrame:
    """One flowchart text per algorithm of flow_graphs: spec, anchor, diagram. Branches are diamonds, ends are rounded."""
    name = lambda c: F.concat(F.lit("n"), F.hex(F.xxhash64(c)))
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", "id"), F.lit('"'), F.lit("'")), F.lit('"'))
    box = F.when(F.col("kind") == "branch", F.concat(F.lit("{"), quoted, F.lit("}"))).when(F.col("kind") == "terminal", F.concat(F.lit("(["), quoted, F.lit("])"))).otherwise(F.concat(F.lit("["), quoted, F.lit("]")))
    line = F.when(F.col("item") == "node", F.concat(F.lit("  "), name(F.col("id")), box)).when(F.col("item") == "edge", F.concat(F.lit("  "), name(F.col("id")), F.lit(" -->|"), F.col("kind"), F.lit("| "), name(F.col("target"))))
    lines = rows.select("spec", "anchor", F.when(F.col("item") == "node", 0).otherwise(1).alias("_k"), "no", line.alias("_line")).filter("_line is not null")
    return lines.groupBy("spec", "anchor").agg(F.array_sort(F.collect_list(F.struct("_k", "no", "_line"))).alias("_l")).select("spec", "anchor", F.concat(F.lit("flowchart TD\n"), F.array_join("_l._line", "\n")).alias("diagram"))
