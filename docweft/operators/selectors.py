"""Selectors of state queries: what a text names, the type or section it means, and what is shown for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.operators.corpus import Corpus
from docweft.operators.state import fields, fold_name


def parse_selector(text: Column) -> Column:
    """struct(kind, spec, anchor, owner, member): kind is spec_glob (``SPEC#glob`` with a wildcard), anchor (``SPEC#anchor``),
    type_glob (``TYPE.glob``), field (``TYPE.FIELD``), type (``TYPE``) or invalid (empty, or several ``#``).

    Names are folded; a member loses the brackets of a slot and the parentheses of a call.
    """
    t = F.trim(text)
    hash_, dot = F.contains(t, F.lit("#")), F.contains(t, F.lit("."))
    spec, anchor = F.substring_index(t, "#", 1), F.substring_index(t, "#", -1)
    owner = F.regexp_extract(t, r"^(.*)\.[^.]*$", 1)
    member = F.regexp_replace(F.regexp_extract(t, r"\.([^.]*)$", 1), r"^\[\[|\]\]$|\(\)$", "")
    wild = lambda c: c.rlike(r"[*%]")
    kind = F.when(t.isNull() | (t == "") | (F.size(F.split(t, "#")) > 2) | hash_ & ((spec == "") | (anchor == "")), "invalid").when(hash_ & wild(anchor), "spec_glob").when(hash_, "anchor").when(dot & wild(member), "type_glob").when(dot & (owner != "") & (member != ""), "field").otherwise("type")
    is_ = lambda *ks: kind.isin(*ks)
    return F.struct(
        kind.alias("kind"),
        F.when(is_("spec_glob", "anchor"), F.lower(spec)).alias("spec"),
        F.when(is_("spec_glob", "anchor"), anchor).alias("anchor"),
        F.when(is_("type_glob", "field"), fold_name(owner)).when(is_("type"), fold_name(t)).alias("owner"),
        F.when(is_("type_glob", "field"), fold_name(member)).alias("member"),
    )


def resolve_selectors(corpus: Corpus, selectors: DataFrame) -> DataFrame:
    """What each selector (selector_no, selector) names: selector_no, kind, answer, n_matches, spec, anchor, candidates.

    A type is one by exact name, else by folded name; several definitions of one name in different specs are candidates,
    and answer is ambiguous. A field is looked up among its owner's members; a glob counts what matches. An anchor is
    dispatched to what stands there: field (a member's definition), type, algorithm, site (any other section), or it is
    not_found. One join a kind, for all selectors together.
    """
    ask = selectors.select("selector_no", "selector", parse_selector(F.col("selector")).alias("s")).select("selector_no", "selector", "s.*")
    d = corpus.idl_defs
    named = d.filter("owner is null and name is not null").select(fold_name(F.col("name")).alias("owner"), F.col("name").alias("_n"), F.col("spec").alias("_spec"), F.col("anchor").alias("_anchor"))
    hit = ask.filter("kind = 'type'").join(named, "owner").withColumn("_exact", (F.col("_n") == F.trim("selector")).cast("int"))
    best = hit.withColumn("_best", F.max("_exact").over(Window.partitionBy("selector_no"))).filter("_exact = _best").select("selector_no", "_spec", "_anchor").distinct()
    members = fields(corpus).select(F.col("owner_key").alias("owner"), F.col("field_key").alias("_m"), F.col("spec").alias("_spec"), F.col("anchor").alias("_anchor"))
    at = ask.filter("kind in ('field', 'type_glob')").join(members, "owner").filter(F.when(F.col("kind") == "field", F.col("_m") == F.col("member")).otherwise(F.regexp_like("_m", _glob_regex(F.col("member")))))
    sections = corpus.sections.select(F.lower("spec").alias("spec"), F.col("spec").alias("_spec"), F.col("anchor").alias("_anchor"), "section_type")
    here = ask.filter("kind in ('anchor', 'spec_glob')").join(sections, "spec").filter(F.when(F.col("kind") == "anchor", F.col("_anchor") == F.col("anchor")).otherwise(F.regexp_like(F.lower("_anchor"), _glob_regex(F.lower("anchor")))))
    defs = d.groupBy(F.col("spec").alias("_spec"), F.col("anchor").alias("_anchor")).agg(F.max(F.when(F.col("owner").isNotNull(), 2).otherwise(1)).alias("_d"))
    shown = here.join(defs, ["_spec", "_anchor"], "left").withColumn("_what", F.when(F.col("_d") == 2, "field").when(F.col("_d") == 1, "type").when(F.col("section_type") == "algorithm", "algorithm").otherwise("site"))
    none = F.lit(None).cast("string")
    every = best.withColumn("_what", none).unionByName(at.select("selector_no", "_spec", "_anchor").withColumn("_what", none)).unionByName(shown.select("selector_no", "_spec", "_anchor", "_what"))
    per = every.groupBy("selector_no").agg(F.count("*").alias("_k"), F.min(F.struct("_spec", "_anchor", "_what")).alias("_f"))
    out = ask.join(per, "selector_no", "left")
    answer = F.when(F.col("kind") == "invalid", "invalid").when(F.col("_k").isNull(), "not_found").when(F.col("kind").isin("type_glob", "spec_glob"), "list").when(F.col("_k") > 1, "ambiguous").when(F.col("kind") == "anchor", F.col("_f._what")).otherwise(F.col("kind"))
    one = answer.isin("type", "field", "algorithm", "site")
    return out.select("selector_no", "kind", answer.alias("answer"), F.coalesce("_k", F.lit(0)).alias("n_matches"), F.when(one, F.col("_f._spec")).alias("spec"), F.when(one, F.col("_f._anchor")).alias("anchor"))


def _glob_regex(glob: Column) -> Column:
    """A glob with ``*`` (and ``%``) as a whole-text pattern; everything else stands for itself."""
    quoted = F.regexp_replace(glob, r"([\\.+?^$|(){}\[\]])", r"\\\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"[*%]", ".*"), F.lit("$"))


_MEMBER = r"(?:readonly\s+)?(attribute)?\s*((?:[A-Za-z_]\w*(?:<[^;{}]*>)?\??\s+)+)([A-Za-z_]\w*)\s*(?:\(([^;]*)\))?\s*(?:=[^;]*)?;"


def idl_members(corpus: Corpus) -> DataFrame:
    """Members that interface texts declare: spec, owner_key, field_key, kind (attribute, method), type and n_args, one row
    a definition and member. Arguments are counted by their commas outside of angle brackets and default values."""
    text = F.coalesce("idl_text", F.lit(""))
    body = F.regexp_extract(text, r"\{([\s\S]*)\}", 1)
    owner = F.regexp_extract(text, r"(?:interface|dictionary)\s+(?:mixin\s+)?(\w+)", 1)
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^" + _MEMBER + "$"))
    each = corpus.idl_defs.filter("idl_text is not null").select("spec", "anchor", fold_name(owner).alias("owner_key"), F.explode(lines).alias("line")).filter("owner_key <> ''")
    part = lambda i: F.regexp_extract("line", "^" + _MEMBER + "$", i)
    args = F.regexp_replace(F.trim(part(4)), r"<[^<>]*>|\{[^{}]*\}", "")
    method = F.contains("line", F.lit("("))
    return each.select("spec", "anchor", "owner_key", fold_name(part(3)).alias("field_key"), F.when(method, "method").otherwise("attribute").alias("kind"), F.trim(part(2)).alias("type"), F.when(~method | (args == ""), 0).otherwise(F.size(F.split(args, ","))).alias("n_args"))
