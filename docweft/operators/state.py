"""State: which sections write which fields, type hierarchies, and slices of algorithms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import steps as S
from docweft.operators.corpus import Corpus, node
from docweft.operators.flow import algorithms
from docweft.operators.runtime import cut, spread, union

#: Order of the bases of supertypes. Fixed values.
BASES = ["inheritance", "includes", "override"]


def fold_name(c: Column) -> Column:
    """Lower case, without backticks, blanks folded."""
    return F.lower(F.trim(F.regexp_replace(F.replace(c, F.lit("`"), F.lit("")), r"\s+", " ")))


def site_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def sites(steps: DataFrame) -> DataFrame:
    """Every place that touches a field: site_id, field, class (write, read, opaque), node, step_path, text.

    A field an opaque statement names is an ``opaque`` site, not a read: whether it writes is not known.
    """
    s = steps.withColumn("node", node())
    each = F.explode(F.concat(F.transform("writes", lambda f: F.struct(f.alias("field"), F.lit("write").alias("class"))), F.transform("reads", lambda f: F.struct(f.alias("field"), F.when(F.col("kind") == "opaque", "opaque").otherwise("read").alias("class"))))).alias("x")
    return s.select("node", "step_path", "text", each).select(site_id(F.col("node"), F.col("step_path"), F.col("x.field"), F.col("x.class")).alias("site_id"), "x.field", "x.class", "node", "step_path", "text")


def occurrence_counts(all_sites: DataFrame) -> DataFrame:
    """field, class, n: one aggregation, combined on the map side, so a hot field is no hot task."""
    return all_sites.groupBy("field", "class").agg(F.count("*").alias("n"))


def field_views(all_sites: DataFrame, limit: int = 50) -> DataFrame:
    """Per field: n_writes, n_reads, n_opaque, n_writers (sections), status (complete unless opaque sites exist) and the
    first ``limit`` writing sites (node and step), by node and step."""
    counts = all_sites.groupBy("field").agg(*[F.count_if(F.col("class") == c).alias(n) for c, n in (("write", "n_writes"), ("read", "n_reads"), ("opaque", "n_opaque"))])
    per_node = all_sites.filter("class = 'write'").groupBy("field", "node").agg(F.count("*").alias("_n"))
    writers = per_node.groupBy("field").agg(F.count("*").alias("n_writers"))
    w = Window.partitionBy("field").orderBy("node", "step_path")
    first = all_sites.filter("class = 'write'").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).groupBy("field").agg(F.array_sort(F.collect_list(F.struct("_n", F.concat_ws(":", "node", "step_path").alias("s")))).alias("_s"))
    return counts.join(writers, "field", "left").join(first, "field", "left").select("field", "n_writes", "n_reads", "n_opaque", F.coalesce("n_writers", F.lit(0)).alias("n_writers"), F.when(F.col("n_opaque") == 0, "complete").otherwise("partial").alias("status"), F.array_join("_s.s", " ").alias("writing_sites"))


# ---- types ---------------------------------------------------------------------------------------------------------


def types(corpus: Corpus) -> DataFrame:
    """Types by folded name: type_key, name, spec, kind and n_rows of all definitions without an owner."""
    d = corpus.idl_defs.filter("owner is null and name is not null").withColumn("type_key", fold_name(F.col("name")))
    return d.groupBy("type_key").agg(F.min(F.struct("spec", "anchor", "name", "kind")).alias("d"), F.count("*").alias("n_rows")).select("type_key", "d.name", "d.spec", "d.anchor", "d.kind", "n_rows")


def fields(corpus: Corpus) -> DataFrame:
    """Members by owner: owner_key, field_key, name, kind, spec, anchor, canonical_name."""
    return corpus.idl_defs.filter("owner is not null and name is not null").select(fold_name(F.col("owner")).alias("owner_key"), fold_name(F.col("name")).alias("field_key"), "name", "kind", "spec", "anchor", "canonical_name")


def type_edges(corpus: Corpus) -> DataFrame:
    """Supertypes told by definition texts: type_key, super_key, basis, pos (``A : B`` inherits, ``A includes B``)."""
    text = F.coalesce("idl_text", F.lit(""))
    found = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(r"(?:interface|dictionary)\s+(\w+\s*:\s*\w+)"), 1), lambda x: F.struct(F.lit(0).alias("basis"), F.split(x, r"\s*:\s*").alias("p"))),
        F.transform(F.regexp_extract_all(text, F.lit(r"(\w+\s+includes\s+\w+)\s*;"), 1), lambda x: F.struct(F.lit(1).alias("basis"), F.split(x, r"\s+includes\s+").alias("p"))),
    )
    e = corpus.idl_defs.select("spec", "ord", F.posexplode(found).alias("i", "e")).select(fold_name(F.col("e.p")[0]).alias("type_key"), fold_name(F.col("e.p")[1]).alias("super_key"), "e.basis", F.struct("spec", "ord", "i").alias("o"))
    w = Window.partitionBy("type_key").orderBy("basis", "o")
    return e.groupBy("type_key", "super_key").agg(F.min(F.struct("basis", "o")).alias("b")).select("type_key", "super_key", "b.basis", "b.o").withColumn("pos", F.row_number().over(w)).select("type_key", "super_key", "basis", "pos")


def supertypes(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every type above each root, breadth first: root, type_key, depth, rank, path. Inheritance comes before includes
    before override, then declaration order; a type met again is left out, so loops end.

    edges: type_key, super_key, pos; roots: type_key. One round per depth for all roots together.
    """
    seen = cut(roots.select(F.col("type_key").alias("root")).filter("root is not null").distinct().select("root", F.col("root").alias("type_key"), F.lit(0).alias("depth"), F.array(F.lit(0)).alias("order"), F.array("root").alias("path")))
    depth = 0
    parts = [seen]
    while True:
        depth += 1
        front = seen.filter(F.col("depth") == depth - 1).select("root", "type_key", "order", "path")
        up = front.join(edges, "type_key").select("root", F.col("super_key").alias("type_key"), F.concat("order", F.array("pos")).alias("order"), F.concat("path", F.array("super_key")).alias("path"))
        new = up.groupBy("root", "type_key").agg(F.min(F.struct("order", "path")).alias("o")).join(seen.select("root", "type_key"), ["root", "type_key"], "left_anti")
        new = cut(new.select("root", "type_key", F.lit(depth).alias("depth"), "o.order", "o.path"), bare=True)
        if new.isEmpty():
            break
        parts.append(new)
        seen = union(parts)
    w = Window.partitionBy("root").orderBy("depth", "order", "type_key")
    return seen.withColumn("rank", F.row_number().over(w)).select("root", "type_key", "depth", "rank", "path")


def lookup_fields(above: DataFrame, all_fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """A field looked up along supertypes: root, field_key, depth, n_matches, owner_key, result (found, ambiguous).

    The first depth with a match decides; two or more there are ambiguous. wanted: root, field_key.
    """
    hit = wanted.join(above, "root").join(all_fields.withColumnRenamed("owner_key", "type_key"), ["type_key", "field_key"])
    per = hit.groupBy("root", "field_key", "depth").agg(F.count("*").alias("n_matches"), F.min("type_key").alias("owner_key"))
    return per.groupBy("root", "field_key").agg(F.min(F.struct("depth", "n_matches", "owner_key")).alias("m")).select("root", "field_key", "m.depth", "m.n_matches", "m.owner_key", F.when(F.col("m.n_matches") == 1, "found").otherwise("ambiguous").alias("result"))


def type_views(above: DataFrame, all_fields: DataFrame) -> DataFrame:
    """Own and inherited members of each root: root, name, owner_key, depth, kind, inherited. Of members of one name the
    first along the supertypes stands."""
    rows = above.join(all_fields.withColumnRenamed("owner_key", "type_key"), "type_key")
    first = rows.groupBy("root", "field_key").agg(F.min(F.struct("rank", "spec", "anchor", "kind", "name", "type_key", "depth")).alias("f"))
    return first.select("root", "f.name", F.col("f.type_key").alias("owner_key"), "f.depth", "f.kind", (F.col("f.depth") > 0).cast("int").alias("inherited"))


def member_view(steps: DataFrame) -> DataFrame:
    """Per field that is grown or shrunk: field, n_adds, n_removes (appends and sets add; removes and unsets remove)."""
    s = steps.select("action", F.lower(F.substring("text", 1, 6)).alias("_t"), F.explode("writes").alias("field"))
    removes = (F.col("action") == "remove") | (F.col("_t") == "unset ")
    return s.groupBy("field").agg(F.count_if(~removes).alias("n_adds"), F.count_if(removes).alias("n_removes"))


def algorithm_views(steps: DataFrame) -> DataFrame:
    """Per algorithm: n_steps, max_depth, a histogram of statement kinds, n_variables, n_writes, n_calls, n_opaque."""
    per_kind = steps.groupBy("spec", "anchor", "kind").agg(F.count("*").alias("n"))
    hist = per_kind.groupBy("spec", "anchor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat_ws("=", x["kind"], x["n"].cast("string"))), " ").alias("histogram"))
    sums = steps.groupBy("spec", "anchor").agg(F.count("*").alias("n_steps"), F.max("depth").alias("max_depth"), F.sum(F.size("writes")).alias("n_writes"), F.sum(F.size("calls")).alias("n_calls"), F.count_if(F.col("kind") == "opaque").alias("n_opaque"))
    names = steps.select("spec", "anchor", F.explode("defs").alias("v")).groupBy("spec", "anchor").agg(F.count_distinct("v").alias("n_variables"))
    return sums.join(hist, ["spec", "anchor"]).join(names, ["spec", "anchor"], "left").select("spec", "anchor", "n_steps", "max_depth", "histogram", F.coalesce("n_variables", F.lit(0)).alias("n_variables"), "n_writes", "n_calls", "n_opaque")


# ---- slices --------------------------------------------------------------------------------------------------------


def slice_forward(text: str | None, variables: set[str]) -> list[tuple[str, str]]:
    """(step path, role) of what a set of variables touches: matched, inherited (below a match, naming no variable) and
    context (above a kept step). Definitions from kept variables join the set until it stands; stores are not followed.
    """
    steps = S.parse_steps(text)
    st = [S.statement(s.text) for s in steps]
    have = set(variables)
    while True:
        more = {d for x in st for d in x["defs"] if have & set(x["uses"])} - have
        if not more:
            break
        have |= more
    role: dict[int, str] = {}
    for i, (s, x) in enumerate(zip(steps, st)):
        named = set(x["defs"]) | set(x["uses"])
        if named & have:
            role[i] = "matched"
        elif not named and s.parent >= 0 and role.get(s.parent) in ("matched", "inherited"):
            role[i] = "inherited"
    for i in list(role):
        p = steps[i].parent
        while p >= 0 and p not in role:
            role[p] = "context"
            p = steps[p].parent
    return [(steps[i].path, role[i]) for i in sorted(role)]


def slice_backward(text: str | None, target: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(step path, role) of what may decide a step, and the variables no step before defines. Roles: target, definition,
    context. Only definitions strictly before a use count."""
    steps = S.parse_steps(text)
    at = next((i for i, s in enumerate(steps) if s.path == target), -1)
    if at < 0:
        return [], []
    st = [S.statement(s.text) for s in steps]
    role, inputs, todo = {at: "target"}, set(), [at]
    while todo:
        i = todo.pop()
        wanted = set(st[i]["uses"])
        p = steps[i].parent
        while p >= 0:  # the conditions it stands under
            if p not in role:
                role[p] = "context"
                todo.append(p)
            p = steps[p].parent
        for v in wanted:
            found = [j for j in range(i) if v in st[j]["defs"]]
            if not found:
                inputs.add(v)
            for j in found:
                if role.get(j) != "definition" and j != at:
                    if j not in role:
                        todo.append(j)
                    role[j] = "definition"
    return [(steps[i].path, role[i]) for i in sorted(role)], sorted(inputs)


def first_definitions(steps: DataFrame) -> DataFrame:
    """The first variable each algorithm defines: spec, anchor, variable; a natural criterion to slice by."""
    return steps.filter("size(defs) > 0").groupBy("spec", "anchor").agg(F.min_by(F.col("defs")[0], "step_no").alias("variable"))


def slices(corpus: Corpus, criteria: DataFrame) -> DataFrame:
    """Forward slices: spec, anchor, variable, step_path, role, for each criterion (spec, anchor, variable)."""
    src = algorithms(corpus).join(criteria, ["spec", "anchor"])
    schema = pa.schema([("spec", pa.string()), ("anchor", pa.string()), ("variable", pa.string()), ("step_path", pa.string()), ("role", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(s, a, v, p, r) for s, a, t, v in zip(*(b.column(c).to_pylist() for c in ("spec", "anchor", "content_text", "variable"))) for p, r in slice_forward(t, {v})]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.record_batch([pa.array(list(c), pa.string()) for c in cols], schema=schema)

    return spread(src).mapInArrow(run, "spec string, anchor string, variable string, step_path string, role string")


def backward_slices(corpus: Corpus, targets: DataFrame) -> DataFrame:
    """Backward slices: spec, anchor, target, step_path, role, for each target step (spec, anchor, target path). A path that
    no step has gives no rows."""
    src = algorithms(corpus).join(targets, ["spec", "anchor"])
    schema = pa.schema([("spec", pa.string()), ("anchor", pa.string()), ("target", pa.string()), ("step_path", pa.string()), ("role", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(s, a, v, p, r) for s, a, t, v in zip(*(b.column(c).to_pylist() for c in ("spec", "anchor", "content_text", "target"))) for p, r in slice_backward(t, v)[0]]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.record_batch([pa.array(list(c), pa.string()) for c in cols], schema=schema)

    return spread(src).mapInArrow(run, "spec string, anchor string, target string, step_path string, role string")


def select_steps(steps: DataFrame, chosen: DataFrame, depth: int | None = None) -> DataFrame:
    """The steps at and below chosen paths (spec, anchor, path), down to ``depth`` levels below each: spec, anchor, path,
    step_path. Each step is joined by its own few ancestor paths, so no algorithm is crossed with itself."""
    parts = F.split(F.col("step_path"), r"\.")
    ups = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), ".").alias("path"), (F.size(parts) - i).alias("below")))).alias("u")
    out = steps.select("spec", "anchor", "step_path", ups).select("spec", "anchor", "step_path", "u.*").join(chosen.select("spec", "anchor", "path").distinct(), ["spec", "anchor", "path"])
    return (out if depth is None else out.filter(F.col("below") <= depth)).select("spec", "anchor", "path", "step_path")


def omitted_runs(steps: DataFrame, kept: DataFrame) -> DataFrame:
    """Runs of neighbouring steps that a slice leaves out: spec, anchor, parent_path, first_path, last_path, n_steps.

    Gaps and islands among siblings by document order; steps below a left-out step count with it. kept: spec, anchor,
    step_path.
    """
    s = steps.select("spec", "anchor", "step_no", "step_path", "parent_path").join(kept.select("spec", "anchor", "step_path", F.lit(1).alias("_k")), ["spec", "anchor", "step_path"], "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    root = F.split(F.col("step_path"), r"\.")
    # the number of steps at and below each step: one row per step and ancestor path
    sizes = s.select("spec", "anchor", F.explode(F.transform(F.sequence(F.lit(1), F.size(root)), lambda i: F.array_join(F.slice(root, 1, i), "."))).alias("step_path")).groupBy("spec", "anchor", "step_path").agg(F.count("*").alias("_size"))
    w = Window.partitionBy("spec", "anchor", "parent_path").orderBy("step_no")
    runs = s.withColumn("_g", F.sum("_k").over(w)).filter("_k = 0").join(sizes, ["spec", "anchor", "step_path"])
    # below a left-out parent nothing is told again
    parents = s.filter("_k = 1").select("spec", "anchor", F.col("step_path").alias("parent_path"))
    told = runs.filter("parent_path is null").unionByName(runs.filter("parent_path is not null").join(parents, ["spec", "anchor", "parent_path"], "left_semi").select(*runs.columns))
    return told.groupBy("spec", "anchor", "parent_path", "_g").agg(F.min_by("step_path", "step_no").alias("first_path"), F.max_by("step_path", "step_no").alias("last_path"), F.sum("_size").alias("n_steps")).select("spec", "anchor", "parent_path", "first_path", "last_path", "n_steps")


def _word_at(name: Column) -> Column:
    """The longest run of letters, digits and underscores in a name, empty where it has none."""
    return F.coalesce(F.array_max(F.transform(F.split(name, r"[^\p{L}\p{N}_]+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"], F.lit(""))


def possible_unlinked(statements: DataFrame, names: DataFrame, most: int = 10_000) -> DataFrame:
    """Opaque statements whose text holds the name of a field they do not link to: field, node, step_path.

    statements: steps (steps_of), of which all opaque ones are examined; or sites(), which know only statements that
    name a slot. names: field, name. A name counts where it stands in whole words. A statement links to a field by its
    slot, which holds the field or its bare name. Each text meets the names whose longest word it holds, so no text is
    searched for every name; up to ``most`` names travel by broadcast, more by a shuffle, with the same rows.
    """
    if "class" in statements.columns:
        opaque = statements.filter("class = 'opaque'").select("node", "step_path", "text").distinct()
        links = statements.groupBy("node", "step_path").agg(F.collect_set(fold_name(F.col("field"))).alias("_links"))
        opaque = opaque.join(links, ["node", "step_path"])
    else:
        opaque = statements.filter("kind = 'opaque'").select(node().alias("node"), "step_path", "text", F.transform(F.concat("writes", "reads"), fold_name).alias("_links"))
    names = names.select("field", fold_name(F.col("name")).alias("_name")).filter("field is not null and _name <> ''").distinct()
    keyed = names.withColumn("_w", _word_at(F.col("_name")))
    low = opaque.withColumn("_low", fold_name(F.col("text")))
    # the empty word leads to names without any letter or digit
    words = low.select("node", "step_path", "_low", "_links", F.explode(F.array_union(F.split("_low", r"[^\p{L}\p{N}_]+"), F.array(F.lit("")))).alias("_w"))
    small = names.limit(most + 1).count() <= most
    bare = r"[\p{L}\p{N}_]"
    literal = F.concat(F.lit(r"\Q"), F.replace(F.col("_name"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    whole = F.concat(F.when(F.col("_name").rlike(f"^{bare}"), f"(?<!{bare})").otherwise(""), literal, F.when(F.col("_name").rlike(f"{bare}$"), f"(?!{bare})").otherwise(""))
    hit = words.join(F.broadcast(keyed) if small else keyed, "_w").filter(F.contains("_low", "_name"))
    hit = hit.filter(F.regexp_like("_low", whole) & ~F.array_contains("_links", F.col("_name")) & ~F.array_contains("_links", fold_name(F.col("field"))))
    return hit.select("field", "node", "step_path").distinct()


def bindings(corpus: Corpus) -> DataFrame:
    """Arguments of calls bound to the parameters of the algorithms they call: ref_id, spec, anchor, to_spec, to_anchor,
    param, value, via, confidence, issues (comma-separated). A call of an algorithm without parameters gives one row with
    a null param; a callee outside the corpus gives none.

    Each callee's text travels to its calls only as its list of parameters.
    """
    from docweft.functions import signatures as G

    params_of = "array<struct<name:string,optional:boolean,default:string>>"

    @F.udf(params_of, useArrow=True)
    def params(text):
        return G.signature(text)

    callee = algorithms(corpus).select(F.col("spec").alias("to_spec"), F.col("anchor").alias("to_anchor"), params("content_text").alias("params"))
    calls = corpus.refs.filter("kind = 'step' and step_text is not null").select(F.col("id").alias("ref_id"), "spec", F.col("from_anchor").alias("anchor"), "to_spec", "to_anchor", "step_text")
    schema = pa.schema([("ref_id", pa.int64()), *[(c, pa.string()) for c in ("spec", "anchor", "to_spec", "to_anchor", "param", "value", "via", "confidence", "issues")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                found = G.arguments(r["step_text"], r["to_anchor"]) or ([], {})
                args, sure, issues = G.bind(r["params"] or [], *found)
                head = (r["ref_id"], r["spec"], r["anchor"], r["to_spec"], r["to_anchor"])
                out += [(*head, *a, sure, ",".join(issues)) for a in args or [(None, None, None)]]
            cols = list(zip(*out)) if out else [[]] * len(schema)
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    return calls.join(callee, ["to_spec", "to_anchor"]).mapInArrow(run, "ref_id bigint, spec string, anchor string, to_spec string, to_anchor string, param string, value string, via string, confidence string, issues string")
