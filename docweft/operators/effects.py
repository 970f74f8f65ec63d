"""May-effects: rules matched on operations, propagated along calls to a fixed point, summarised with witnesses."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.operators.corpus import Corpus, node
from docweft.operators.runtime import cut, union

#: How a callee runs, as numbers whose greatest is the composition of two. Fixed values.
INLINE, UNKNOWN, SEPARATE = 0, 1, 2
EXECUTION = ["inline", "unknown", "separate"]
#: Categories of effect kinds and the order in which they are listed. Fixed values.
CATEGORY = {"event.fire": "events", "event.dispatch": "events", "scheduling.enqueue": "async", "scheduling.parallel": "async", "scheduling.promise-continuation": "async", "script.invoke": "script", "script.opportunity": "script", "execution.context": "context"}
CATEGORY_ORDER = ["async", "script", "events"]
#: Words in a link, or among the five before it, that make it a call; also with -ing and -ed. Fixed values.
VERBS = ["abort", "append", "apply", "call", "clean", "continue", "dispatch", "enqueue", "evaluate", "execute", "fire", "invoke", "load", "navigate", "obtain", "parse", "perform", "prepare", "queue", "resume", "run", "schedule", "serialize", "wait"]
#: Forms of those that do not follow the rule. Fixed values.
FORMS = ["running", "ran", "applying", "applied"]
#: Words that make a link a call only as its first. Fixed values.
LINK_VERBS = ["attempt", "check", "commit", "consider", "create", "deactivate", "destroy", "disentangle", "finalize", "finish", "initialise", "initialize", "notify", "register", "report", "process", "reactivate", "reset", "respond", "scroll", "set", "stop", "unload", "update"]


@dataclass(frozen=True)
class Rule:
    """What a step's text does: a pattern, the effect it emits, and captures or constants for its parameters."""

    id: str
    kind: str
    pattern: str
    params: dict[str, str | None] = field(default_factory=dict)  # name -> constant, None, or "$group"
    subject: str | None = None  # only in this section (spec#anchor)
    exclude: str | None = None  # not where this matches


class CatalogError(ValueError):
    """A rule catalog that cannot be used."""


def load_catalog(text: str) -> list[Rule]:
    """Rules from JSON, or YAML where a reader for it is installed: ``{"schema": 1, "rules": [{"id", "kind", "pattern", "params"?, "subject"?, "exclude"?}]}``.

    Unknown keys, double ids, unknown kinds and patterns that do not compile are errors.
    """
    try:
        doc = json.loads(text)
    except ValueError:
        doc = _yaml(text)
    if not isinstance(doc, dict) or doc.get("schema") != 1 or set(doc) - {"schema", "package", "rules"}:
        raise CatalogError("a catalog has schema 1 and rules")
    rules, seen = [], set()
    for r in doc.get("rules", []):
        extra = set(r) - {"id", "kind", "pattern", "params", "subject", "exclude"}
        if extra or not {"id", "kind", "pattern"} <= set(r):
            raise CatalogError(f"rule {r.get('id')}: keys {sorted(extra) or 'missing'}")
        if r["id"] in seen:
            raise CatalogError(f"rule {r['id']} stands twice")
        if r["kind"] not in CATEGORY:
            raise CatalogError(f"rule {r['id']}: unknown kind {r['kind']}")
        groups = re.compile(r["pattern"]).groups
        for v in (r.get("params") or {}).values():
            if v is not None and v.startswith("$") and not 0 < int(v[1:]) <= groups:
                raise CatalogError(f"rule {r['id']}: no group {v}")
        seen.add(r["id"])
        rules.append(Rule(**r))
    return rules


def _yaml(text: str):
    try:
        import yaml
    except ImportError as e:
        raise CatalogError("the catalog is not JSON, and no YAML reader is installed") from e

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        keys = [loader.construct_object(k) for k, _ in node.value]
        if len(keys) != len(set(keys)):
            raise CatalogError("a key stands twice")
        return loader.construct_mapping(node, deep=True)

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    try:
        return yaml.load(text, Strict)  # noqa: S506
    except yaml.YAMLError as e:
        raise CatalogError(str(e)) from e


#: Rules for the wording of the numbered steps in this project's data.
DEFAULT_RULES = [
    Rule("queue-step", "scheduling.enqueue", r"(?i)\bqueue (?:a|an|the) (\w+ \w+)", {"queue": "$1"}),
    Rule("wait-step", "scheduling.promise-continuation", r"(?i)^wait until\b"),
    Rule("in-parallel", "scheduling.parallel", r"(?i)\bin parallel\b"),
    Rule("post-step", "event.dispatch", r"(?i)\bpost the (\w+ \w+)", {"name": "$1"}),
    Rule("reject-step", "script.invoke", r"(?i)^reject the (\w+ \w+)", {"mechanism": "reject"}),
    Rule("resolve-step", "script.invoke", r"(?i)^resolve\b", {"mechanism": "resolve"}),
    Rule("throw-step", "script.opportunity", r"(?i)\bthrow a\b"),
]


def canonical_params(params: dict[str, Column]) -> Column:
    """Parameters as JSON with sorted names; unknown ones are null and stay a value of their own."""
    if not params:
        return F.lit("{}")
    names = sorted(params)
    return F.to_json(F.struct(*[params[n].alias(n) for n in names]), {"ignoreNullFields": "false"})


def effect_id(kind: Column, params: Column) -> Column:
    """``ef_`` and the SHA-256 of kind and canonical parameters in hex."""
    return F.concat(F.lit("ef_"), F.sha2(F.concat_ws("\u0000", kind, params), 256))


def effect_handles(effects: DataFrame, digits: int = 16) -> DataFrame:
    """effect and its short handle: the first 16 hex digits, for effects that share them as many more as tell them apart.

    The first shared digits of sorted neighbours decide, so each effect looks at two others only; the sort runs within
    groups of equal first digits.
    """
    known = effects.select("effect").distinct().withColumn("_p", F.substring("effect", 1, 3 + digits))
    w = Window.partitionBy("_p").orderBy("effect")
    same = lambda other: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(digits), F.lit(64)), lambda n: F.substring("effect", F.lit(4), n) == F.substring(other, F.lit(4), n))), F.lit(0))
    near = known.withColumns({"_a": F.lag("effect").over(w), "_z": F.lead("effect").over(w)})
    return near.select("effect", F.substring("effect", F.lit(1), F.lit(3) + F.greatest(F.lit(digits), same(F.col("_a")) + 1, same(F.col("_z")) + 1)).alias("handle"))


def match_rules(steps: DataFrame, rules: list[Rule]) -> DataFrame:
    """Local occurrences: node, kind, params, rule_ids, step_path, step_no of all rules on all steps.

    steps: spec, anchor, step_no, step_path, text. All rules run in one pass over each text, inside the plan. A capture
    that fails gives null. Of occurrences of one step and kind, one whose known parameters another also has, among more,
    gives way to it and leaves it its rule.
    """
    found = []
    for r in rules:
        hit = F.col("text").rlike(r.pattern)
        if r.exclude:
            hit = hit & ~F.col("text").rlike(r.exclude)
        if r.subject:
            hit = hit & (F.col("node") == r.subject)
        value = lambda v, p=r.pattern: F.lit(None).cast("string") if v is None else F.nullif(F.regexp_extract("text", p, int(v[1:])), F.lit("")) if v.startswith("$") else F.lit(v)
        params = {n: value(v) for n, v in r.params.items()}
        found.append(F.when(hit, F.struct(F.lit(r.kind).alias("kind"), canonical_params(params).alias("params"), F.lit(r.id).alias("rule_id"), sum((c.isNotNull().cast("int") for c in params.values()), F.lit(0)).alias("known"))))
    each = steps.withColumn("node", node()).select("node", "step_no", "step_path", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("e")).select("node", "step_no", "step_path", "e.*")
    merged = each.groupBy("node", "step_no", "step_path", "kind", "params").agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.max("known").alias("known"))
    w = Window.partitionBy("node", "step_no", "kind")
    whole = merged.withColumn("_best", F.max("known").over(w)).withColumn("_all", F.array_sort(F.array_distinct(F.flatten(F.collect_list("rule_ids").over(w)))))
    # a general occurrence (nothing known) beside a specific one of the same step and kind is that one's
    kept = whole.filter(~((F.col("known") == 0) & (F.col("_best") > 0)))
    return kept.select("node", "kind", "params", F.when(F.col("_best") > 0, F.col("_all")).otherwise(F.col("rule_ids")).alias("rule_ids"), "step_path", "step_no")


def calls_in(text: Column, anchor: Column) -> Column:
    """Whether a step's words make its reference to an anchor a call: a verb in the link's text or among the five words
    before the link, or one of the link verbs at the link's head ("potentially" aside). Texts that do not hold the link
    itself are judged by all their words."""
    verb = r"(?i)\b(?:" + "|".join(v[:-1] + "(?:e|es|ed|ing)" if v[-1] == "e" else v + "(?:s|ed|ing)?" for v in VERBS) + "|" + "|".join(FORMS) + r")\b"
    head = r"(?i)^\s*(?:potentially\s+)?(?:" + "|".join(LINK_VERBS) + r")\b"
    end = F.concat(F.lit("#"), anchor, F.lit(")"))
    upto = F.call_function("substring_index", text, end, F.lit(1))
    link = F.regexp_extract(upto, r"\[([^\[\]]*)\]\([^()]*$", 1)
    near = F.regexp_extract(F.regexp_replace(upto, r"\[[^\[\]]*\]\([^()]*$", ""), r"((?:\S+\s+){0,5})$", 1)
    return F.when(F.contains(text, end), F.concat_ws(" ", near, link).rlike(verb) | link.rlike(head)).otherwise(text.rlike(verb))


def call_steps(corpus: Corpus) -> DataFrame:
    """Calls between algorithms, step by step: src, dst, relation, exec, step_path. A step reference whose words make it a
    call (``calls_in``) runs inline; any other to an algorithm is a candidate with unknown execution; to anything else a
    mention, which carries nothing."""
    kinds = corpus.sections.select(F.col("spec").alias("to_spec"), F.col("anchor").alias("to_anchor"), "section_type")
    r = corpus.refs.filter("from_anchor is not null and to_anchor is not null and kind = 'step'").join(kinds, ["to_spec", "to_anchor"], "left")
    called = F.coalesce(calls_in(F.col("step_text"), F.col("to_anchor")), F.lit(False))
    relation = F.when(F.coalesce(F.col("section_type") != "algorithm", F.lit(True)), "mention").when(called, "invoke").otherwise("candidate_invoke")
    each = r.select(node("spec", "from_anchor").alias("src"), node("to_spec", "to_anchor").alias("dst"), relation.alias("relation"), F.when(F.col("step_text").rlike(r"(?i)\bin parallel\b"), SEPARATE).when(relation == "invoke", INLINE).otherwise(UNKNOWN).alias("exec"), "step_path")
    return each.distinct()


def call_edges(corpus: Corpus) -> DataFrame:
    """Calls between algorithms: src, dst, relation, exec and the first step_path of each."""
    return call_steps(corpus).groupBy("src", "dst", "relation", "exec").agg(F.min("step_path").alias("step_path"))


def propagate(edges: DataFrame, local: DataFrame, blocked: DataFrame | None = None, max_states: int | None = None, own_blocked: DataFrame | None = None) -> DataFrame:
    """All states (node, effect, exec) with the least distance to their origin and the next node on such a way.

    edges: src, dst, exec (no mentions); local: node, effect. A caller has every effect of its callees; its execution is
    the greatest of the edge's and the callee's. ``blocked`` (src, dst, effect) holds what does not cross an edge, where
    the caller's own, more specific effect stands for it; ``own_blocked`` (src, dst, exec, effect) only what the callee has
    itself, while the same effect of the callee's callees crosses. With it, an effect that a node both has (distance 0) and
    inherits inline stands in two rows. Rounds of one join each, over new states only, until there
    are none; the number of states is at most nodes x effects x 3. Beyond ``max_states`` the result is partial, and says
    so in its column ``partial``.
    """
    e = cut(edges.select("src", "dst", "exec").distinct())
    seen = cut(local.select("node", "effect").distinct().select("node", "effect", F.lit(INLINE).alias("exec"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("next_node")))
    delta, rounds, partial, parts = seen, 0, False, [seen]
    while True:
        rounds += 1
        came = delta.select(F.col("node").alias("dst"), "effect", F.col("exec").alias("_x")).join(e, "dst").select("src", "dst", "effect", F.col("exec").alias("_e"), F.greatest("exec", "_x").alias("exec"))
        if blocked is not None:
            came = came.join(blocked.select("src", "dst", "effect"), ["src", "dst", "effect"], "left_anti")
        if own_blocked is not None and rounds == 1:
            came = came.join(own_blocked.select("src", "dst", F.col("exec").alias("_e"), "effect"), ["src", "dst", "_e", "effect"], "left_anti")
        met = seen if own_blocked is None else seen.filter("distance > 0")
        new = came.groupBy(F.col("src").alias("node"), "effect", "exec").agg(F.min("dst").alias("next_node")).join(met.select("node", "effect", "exec"), ["node", "effect", "exec"], "left_anti")
        delta = cut(new.select("node", "effect", "exec", F.lit(rounds).alias("distance"), "next_node"), bare=True)
        if delta.isEmpty():
            break
        parts.append(delta)
        seen = union(parts)
        if max_states is not None and seen.count() > max_states:
            partial = True
            break
    return seen.withColumn("partial", F.lit(partial))


def block_specialised(sites: DataFrame, local: DataFrame) -> DataFrame:
    """(src, dst, exec, effect) that do not cross because at every step that makes the call the caller has an effect of
    the same kind that shares a rule with the callee's own and whose parameters are equal to its or dominate them: the
    same names, all known values of the callee kept, others filled in.

    sites: src, dst, exec, step_path; local: node, step_path, kind, effect, params, rule_ids.
    """
    sites = sites.select("src", "dst", "exec", "step_path").distinct()
    own = local.groupBy("node", "kind", "effect", "params").agg(F.array_distinct(F.flatten(F.collect_list("rule_ids"))).alias("rules"))
    at = sites.join(local.select(F.col("node").alias("src"), "step_path", F.col("effect").alias("_own")).distinct(), ["src", "step_path"])
    at = at.join(own.select(F.col("node").alias("src"), "kind", F.col("effect").alias("_own"), F.col("params").alias("_params"), F.col("rules").alias("_rules")), ["src", "_own"])
    both = at.join(own.withColumnRenamed("node", "dst"), ["dst", "kind"]).filter(F.arrays_overlap("_rules", "rules"))
    more, less = (F.from_json(c, "map<string,string>") for c in ("_params", "params"))
    keeps = F.forall(F.map_keys(less), lambda n: F.map_contains_key(more, n) & (F.element_at(less, n).isNull() | F.element_at(less, n).eqNullSafe(F.element_at(more, n))))
    hit = both.filter((F.col("_own") == F.col("effect")) | ((F.size(more) == F.size(less)) & keeps)).select("src", "dst", "exec", "step_path", "effect").distinct()
    n = sites.groupBy("src", "dst", "exec").agg(F.count("*").alias("_n"))
    return hit.groupBy("src", "dst", "exec", "effect").agg(F.count("*").alias("_b")).join(n, ["src", "dst", "exec"]).filter("_b = _n").select("src", "dst", "exec", "effect")


def category_rank(kind: Column) -> Column:
    """async, script, events, then the others by name."""
    cat = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in CATEGORY.items() for x in p]), kind), F.lit("~"))
    rank = F.lit(len(CATEGORY_ORDER))
    for i, c in reversed(list(enumerate(CATEGORY_ORDER))):
        rank = F.when(cat == c, i).otherwise(rank)
    return rank


@dataclass
class Effects:
    """The effects of a corpus under a catalog."""

    corpus: Corpus
    steps: DataFrame
    rules: list[Rule] = field(default_factory=lambda: DEFAULT_RULES)

    def local(self) -> DataFrame:
        return match_rules(self.steps, self.rules).withColumn("effect", effect_id(F.col("kind"), F.col("params")))

    @cached_property
    def local_once(self) -> DataFrame:
        """The local occurrences, worked out once."""
        return cut(self.local())

    def calls(self) -> DataFrame:
        return call_edges(self.corpus).filter("relation <> 'mention'")

    def states(self, max_states: int | None = None) -> DataFrame:
        return self._states(self.local_once, max_states)

    def _states(self, local: DataFrame, max_states: int | None = None) -> DataFrame:
        calls = cut(call_steps(self.corpus).filter("relation <> 'mention'"))
        return propagate(calls, local, max_states=max_states, own_blocked=cut(block_specialised(calls, local)))

    def summaries(self) -> DataFrame:
        """Per section and effect: node, effect, kind, category_rank, params, executions, local_sites, distance."""
        local = self.local_once
        names = local.groupBy("effect").agg(F.min("kind").alias("kind"), F.min("params").alias("params"))
        sites = local.groupBy("node", "effect").agg(F.count("*").alias("local_sites"))
        states = self._states(local)
        per = states.groupBy("node", "effect").agg(F.array_join(F.transform(F.array_sort(F.collect_set("exec")), lambda x: F.element_at(F.array(*map(F.lit, EXECUTION)), x + 1)), ",").alias("executions"), F.min("distance").alias("distance"))
        return per.join(F.broadcast(names) if len(self.rules) < 64 and names.limit(100_001).count() <= 100_000 else names, "effect").join(sites, ["node", "effect"], "left").select("node", "effect", "kind", category_rank(F.col("kind")).alias("category_rank"), "params", "executions", F.coalesce("local_sites", F.lit(0)).alias("local_sites"), "distance")


def preview(summaries: DataFrame, limit: int = 12) -> DataFrame:
    """The first effects of each section in the order of category, kind and parameters, and how many are left out."""
    w = Window.partitionBy("node").orderBy("category_rank", "kind", "params")
    n = F.count("*").over(Window.partitionBy("node"))
    return summaries.withColumn("effect_no", F.row_number().over(w)).withColumn("omitted", F.greatest(n - limit, F.lit(0))).filter(F.col("effect_no") <= limit)


def witnesses(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """A shortest way from each wanted (node, effect) to a section that has the effect itself: node, effect, path.

    Ways follow the predecessors that propagation recorded. They grow by doubling: a round joins each open way with the
    way of as many links that goes on from its end, so a way of n links takes log n rounds, and none is too long.
    """
    # a state at some distance came from one of its next node a link nearer
    best = states.groupBy("node", "effect", "distance").agg(F.min("next_node").alias("next_node"))
    hop = cut(best.select("node", "effect", "distance", F.array("node").alias("path"), F.col("next_node").alias("at"), (F.col("distance") - 1).alias("left")))
    while not hop.filter("at is not null").isEmpty():
        on = hop.select(F.col("node").alias("at"), "effect", F.col("distance").alias("left"), F.col("path").alias("_path"), F.col("at").alias("_at"), F.col("left").alias("_left"))
        grown = hop.join(on, ["at", "effect", "left"], "left")
        more = F.col("_path").isNotNull()
        hop = cut(grown.select("node", "effect", "distance", F.when(more, F.concat("path", "_path")).otherwise(F.col("path")).alias("path"), F.when(more, F.col("_at")).alias("at"), F.when(more, F.col("_left")).otherwise(F.col("left")).alias("left")), bare=True)
    nearest = hop.groupBy("node", "effect").agg(F.min_by("path", "distance").alias("path"))
    return wanted.select("node", "effect").distinct().join(nearest, ["node", "effect"])


def with_status(summaries: DataFrame, issues: DataFrame, calls: DataFrame) -> DataFrame:
    """Summaries with ``status``: complete, unless the node or one that it calls has an issue; then partial, with the
    issue codes in ``issues``.

    issues: node, code; calls: src, dst. Issues spread to callers like effects do. Codes that only cut a display short
    (witness_budget, context_truncated) do not make a result partial.
    """
    spread_out = propagate(calls.select("src", "dst", F.lit(INLINE).alias("exec")), issues.select("node", F.col("code").alias("effect")).distinct())
    per = spread_out.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("effect")), ",").alias("issues"), F.max((~F.col("effect").isin("witness_budget", "context_truncated")).cast("int")).alias("_partial"))
    return summaries.join(per, "node", "left").withColumn("status", F.when(F.col("_partial") == 1, "partial").otherwise("complete")).withColumn("issues", F.coalesce("issues", F.lit(""))).drop("_partial")


def filter_effects(occurrences: DataFrame, kind: str | None = None, category: str | None = None, rule: str | None = None, effect: str | None = None, step: str | None = None) -> DataFrame:
    """Occurrences of a kind, category, rule, effect (or its handle) and step path, as far as they are given."""
    out = occurrences
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if category is not None:
        out = out.filter(F.col("kind").isin([k for k, c in CATEGORY.items() if c == category]))
    if rule is not None:
        out = out.filter(F.array_contains("rule_ids", rule))
    if effect is not None:
        out = out.filter(F.startswith("effect", F.lit(effect)))
    return out if step is None else out.filter(F.col("step_path") == step)


def unresolved_calls(corpus: Corpus) -> DataFrame:
    """Issues of step references: node, code. missing_spec where the target's spec is not in the corpus, missing_anchor
    where its spec is and the section is not, unresolved_invocation where an algorithm is only a candidate."""
    have = corpus.current.select(F.col("spec").alias("to_spec")).distinct().withColumn("_spec", F.lit(True))
    r = corpus.refs.filter("from_anchor is not null and to_anchor is not null and kind = 'step'").join(have, "to_spec", "left")
    at = corpus.sections.select(F.col("spec").alias("to_spec"), F.col("anchor").alias("to_anchor"), "section_type")
    r = r.join(at, ["to_spec", "to_anchor"], "left")
    called = F.coalesce(calls_in(F.col("step_text"), F.col("to_anchor")), F.lit(False))
    code = F.when(F.col("_spec").isNull(), "missing_spec").when(F.col("section_type").isNull(), "missing_anchor").when((F.col("section_type") == "algorithm") & ~called, "unresolved_invocation")
    return r.select(node("spec", "from_anchor").alias("node"), code.alias("code")).filter("code is not null").distinct()


def publication_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Which summaries to write anew: node, effect, action (upsert, delete). Both sides: node, effect and the rest."""
    rest = [c for c in new.columns if c not in ("node", "effect")]
    d = F.xxhash64(*rest)
    both = old.select("node", "effect", d.alias("_o")).join(new.select("node", "effect", d.alias("_n")), ["node", "effect"], "full")
    return both.select("node", "effect", F.when(F.col("_n").isNull(), "delete").when(~F.col("_o").eqNullSafe(F.col("_n")), "upsert").alias("action")).filter("action is not null")


def rebuild_seconds(largest_mb: Column, total_mb: Column, threads: int) -> Column:
    """The estimated seconds of a rebuild: one, plus 30 ms a MB on the slowest thread, plus 5 ms a MB in all."""
    return F.lit(1.0) + F.greatest(largest_mb, total_mb / threads) * 0.030 + total_mb * 0.005
