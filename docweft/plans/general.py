"""Queries of the general data-processing operators, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators.hierarchy import descendants, hierarchies
from docweft.operators.references import hot_targets, orphan_references, orphan_report, target_profile
from docweft.operators.snapshots import attribute_history, snapshot_changes
from docweft.sources.tables import Tables


def p1_found(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    return snapshot_changes(t.sections, t.snapshots).select("spec_id", "from_snapshot_id", "to_snapshot_id", "anchor", "change")


def p4_found(spark: SparkSession, path: str) -> DataFrame:
    tree = hierarchies(Tables(spark, path).sections, with_path=False, only_loops=True)
    return tree.select("snapshot_id", "anchor", F.col("loop").alias("loop_anchor"))


def p4_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    tree = hierarchies(Tables(spark, path).sections, keep=("depth",))
    return tree.select("snapshot_id", "anchor", F.array_join("path", " / ").alias("full_path"), "level", F.col("depth").alias("stored_depth"), "root", (F.col("subtree_size") - 1).alias("n_descendants"), "range_start", "range_end")


def p4_descendants(spark: SparkSession, path: str) -> DataFrame:
    return descendants(hierarchies(Tables(spark, path).sections, with_path=False))


def p5_found(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    return hot_targets(t.refs, t.limit("hot_key_permille")).select("to_spec", "to_anchor")


def p5_targets(spark: SparkSession, path: str) -> DataFrame:
    return target_profile(Tables(spark, path).refs)


def p6_found(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    return attribute_history(t.sections, t.snapshots).select("spec_id", "anchor", "first_snapshot_id", "last_snapshot_id")


def p6_history(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    h = attribute_history(t.sections, t.snapshots)
    return h.select("spec_id", "anchor", "first_snapshot_id", "n_snapshots", F.unix_micros("valid_from").alias("valid_from_us"), F.unix_micros("valid_to").alias("valid_to_us"), F.col("is_current").cast("int").alias("is_current"))


def p7_found(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    return orphan_references(t.refs, t.sections, t.snapshots, t.specs, t.shared_anchors).select("ref_id", "reason")


def p7_report(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    return orphan_report(orphan_references(t.refs, t.sections, t.snapshots, t.specs, t.shared_anchors), t.snapshots, t.specs)


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_hierarchy, p4_descendants, p5_found, p5_targets, p6_found, p6_history, p7_found, p7_report)}

_FULL = r"""
WITH firsts AS (
  SELECT *, epoch_us(CAST(commit_date AS TIMESTAMPTZ)) AS inst,
         row_number() OVER (PARTITION BY spec_id, lower(sha) ORDER BY id) AS k
  FROM snapshots WHERE pr_number IS NULL),
full_snaps AS (
  SELECT id AS snapshot_id, spec_id, inst,
         row_number() OVER o AS seq, lag(id) OVER o AS prev_id, lead(id) OVER o AS next_id, lead(inst) OVER o AS next_inst
  FROM firsts WHERE k = 1 AND id IN (SELECT snapshot_id FROM sections)
  WINDOW o AS (PARTITION BY spec_id ORDER BY inst, id)),
picked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, anchor ORDER BY ord, id) AS k FROM sections) WHERE k = 1),
texts AS (
  SELECT p.id, p.snapshot_id, p.anchor, f.spec_id, f.seq, f.prev_id, f.next_id, f.inst, f.next_inst,
         regexp_replace(trim(regexp_replace(coalesce(content_text, ''), '[ \t\r\n]+', ' ', 'g')), '\]\([^)#]*#', '](#', 'g') AS txt
  FROM picked p JOIN full_snaps f USING (snapshot_id))
"""

_TARGET = r"""lower(trim(to_spec, E' \t\r\n')) AS to_spec, url_decode(replace(CASE WHEN to_anchor LIKE '#%' THEN substr(to_anchor, 2) ELSE to_anchor END, '+', '%2B')) AS to_anchor"""

_ORPHANS = (
    _FULL
    + f""",
presence AS (SELECT t.*, lower(s.name) AS spec FROM texts t JOIN specs s ON s.id = t.spec_id),
asked AS (
  SELECT r.id, r.snapshot_id, r.tspec, r.tanchor, lower(s.name) AS spec, epoch_us(CAST(n.commit_date AS TIMESTAMPTZ)) AS t, n.commit_date
  FROM (SELECT id, snapshot_id, to_spec AS tspec, to_anchor AS tanchor FROM (SELECT id, snapshot_id, {_TARGET} FROM refs)) r
  LEFT JOIN snapshots n ON n.id = r.snapshot_id LEFT JOIN specs s ON s.id = n.spec_id),
known AS (
  SELECT a.id, max(CASE WHEN p.inst <= a.t THEN 1 ELSE 0 END) AS before, count(p.id) AS ever,
         max(CASE WHEN p.inst <= a.t AND (p.next_inst IS NULL OR p.next_inst > a.t) THEN 1 ELSE 0 END) AS now
  FROM asked a LEFT JOIN presence p ON p.spec = a.tspec AND p.anchor = a.tanchor GROUP BY a.id),
orphans AS (
  SELECT a.id AS ref_id, a.spec AS own_spec, a.t, CASE WHEN k.before = 1 THEN 'deleted' WHEN k.ever > 0 THEN 'late' ELSE 'missing' END AS reason
  FROM asked a JOIN known k USING (id)
  WHERE NOT EXISTS (SELECT 1 FROM shared_anchors h WHERE lower(trim(h.spec)) = a.tspec AND h.anchor = a.tanchor)
    AND NOT CASE WHEN a.tspec = a.spec THEN EXISTS (SELECT 1 FROM sections x WHERE x.snapshot_id = a.snapshot_id AND x.anchor = a.tanchor) ELSE coalesce(k.now, 0) = 1 END)
"""
)

_TREE = r"""
WITH RECURSIVE picked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, anchor ORDER BY ord, id) AS k FROM sections) WHERE k = 1),
walk AS (
  SELECT p.snapshot_id, p.anchor, p.anchor AS cur, p.parent_anchor AS up, 0 AS level, [p.anchor] AS path FROM picked p
  UNION ALL
  SELECT w.snapshot_id, w.anchor, q.anchor, q.parent_anchor, w.level + 1, list_prepend(q.anchor, w.path)
  FROM walk w JOIN picked q ON q.snapshot_id = w.snapshot_id AND q.anchor = w.up
  WHERE NOT list_contains(w.path, q.anchor))
"""

SQL = {
    "p1_found": _FULL
    + r"""
SELECT a.spec_id, a.snapshot_id AS from_snapshot_id, a.next_id AS to_snapshot_id, a.anchor, CASE WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM texts a LEFT JOIN texts b ON b.snapshot_id = a.next_id AND b.anchor = a.anchor
WHERE a.next_id IS NOT NULL AND (b.id IS NULL OR b.txt <> a.txt)
UNION ALL
SELECT b.spec_id, b.prev_id, b.snapshot_id, b.anchor, 'added'
FROM texts b LEFT JOIN texts a ON a.snapshot_id = b.prev_id AND a.anchor = b.anchor
WHERE b.prev_id IS NOT NULL AND a.id IS NULL""",
    "p4_found": _TREE
    + r""",
ends AS (SELECT snapshot_id, anchor, max_by(cur, level) AS last_at, max_by(coalesce(up, ''), level) AS last_up, max_by(path, level) AS path FROM walk GROUP BY ALL),
looping AS (SELECT e.* FROM ends e WHERE EXISTS (SELECT 1 FROM picked q WHERE q.snapshot_id = e.snapshot_id AND q.anchor = e.last_up))
SELECT snapshot_id, anchor, list_min(path[1:list_position(path, last_up)]) AS loop_anchor FROM looping""",
    "p4_hierarchy": _TREE
    + r""",
ends AS (SELECT snapshot_id, anchor, max_by(cur, level) AS root, max_by(coalesce(up, ''), level) AS last_up, max(level) AS level, max_by(path, level) AS path FROM walk GROUP BY ALL),
fine AS (SELECT e.*, EXISTS (SELECT 1 FROM picked q WHERE q.snapshot_id = e.snapshot_id AND q.anchor = e.last_up) AS bad FROM ends e),
below AS (SELECT snapshot_id, a AS anchor, count(*) - 1 AS n FROM (SELECT snapshot_id, unnest(path) AS a FROM fine WHERE NOT bad) GROUP BY ALL),
steps AS (SELECT f.snapshot_id, f.anchor, f.level, unnest(path) AS a, generate_subscripts(path, 1) AS i FROM fine f WHERE NOT bad),
ways AS (SELECT s.snapshot_id, s.anchor, list((q.ord, q.id) ORDER BY i) AS way FROM steps s JOIN picked q ON q.snapshot_id = s.snapshot_id AND q.anchor = s.a GROUP BY ALL),
preorder AS (SELECT snapshot_id, anchor, row_number() OVER (PARTITION BY snapshot_id ORDER BY way) - 1 AS range_start FROM ways)
SELECT f.snapshot_id, f.anchor, CASE WHEN NOT bad THEN array_to_string(path, ' / ') END AS full_path, CASE WHEN NOT bad THEN level END AS level, p.depth AS stored_depth,
       CASE WHEN NOT bad THEN root END AS root, CASE WHEN NOT bad THEN b.n END AS n_descendants, o.range_start, o.range_start + b.n AS range_end
FROM fine f JOIN picked p USING (snapshot_id, anchor) LEFT JOIN below b USING (snapshot_id, anchor) LEFT JOIN preorder o USING (snapshot_id, anchor)""",
    "p4_descendants": _TREE
    + r""",
ends AS (SELECT snapshot_id, anchor, max_by(coalesce(up, ''), level) AS last_up FROM walk GROUP BY ALL)
SELECT w.snapshot_id, w.cur AS ancestor, w.anchor AS descendant, w.level AS distance FROM walk w JOIN ends e USING (snapshot_id, anchor)
WHERE w.level > 0 AND NOT EXISTS (SELECT 1 FROM picked q WHERE q.snapshot_id = e.snapshot_id AND q.anchor = e.last_up)""",
    "p5_found": f"""
SELECT to_spec, to_anchor FROM (SELECT {_TARGET} FROM refs) GROUP BY ALL
HAVING count(*) * 1000 > (SELECT count(*) FROM refs) * (SELECT amount FROM run_limits WHERE name = 'hot_key_permille')""",
    "p5_targets": f"""
SELECT to_spec, to_anchor, count(*) AS n_refs, count(*) FILTER (kind = 'step') AS n_step, count(*) FILTER (kind = 'note') AS n_note, count(*) FILTER (kind = 'idl') AS n_idl,
       count(*) FILTER (kind = 'prose') AS n_prose, count(*) FILTER (kind IS NULL OR kind NOT IN ('step', 'note', 'idl', 'prose')) AS n_other,
       count(DISTINCT (snapshot_id, from_anchor)) AS n_sections, count(DISTINCT snapshot_id) AS n_snapshots
FROM (SELECT {_TARGET}, lower(kind) AS kind, snapshot_id, from_anchor FROM refs) GROUP BY to_spec, to_anchor""",
    "p6_found": _FULL
    + r""",
marks AS (SELECT *, CASE WHEN lag(txt) OVER w = txt AND lag(seq) OVER w = seq - 1 THEN 0 ELSE 1 END AS new FROM texts WINDOW w AS (PARTITION BY spec_id, anchor ORDER BY seq)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY spec_id, anchor ORDER BY seq) AS g FROM marks)
SELECT spec_id, anchor, arg_min(snapshot_id, seq) AS first_snapshot_id, arg_max(snapshot_id, seq) AS last_snapshot_id FROM islands GROUP BY spec_id, anchor, g""",
    "p6_history": _FULL
    + r""",
marks AS (SELECT *, CASE WHEN lag(txt) OVER w = txt AND lag(seq) OVER w = seq - 1 THEN 0 ELSE 1 END AS new FROM texts WINDOW w AS (PARTITION BY spec_id, anchor ORDER BY seq)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY spec_id, anchor ORDER BY seq) AS g FROM marks)
SELECT i.spec_id, i.anchor, arg_min(i.snapshot_id, i.seq) AS first_snapshot_id, count(*) AS n_snapshots, min(i.inst) AS valid_from_us,
       min(f.next_inst) AS valid_to_us, CAST(min(f.next_inst) IS NULL AS int) AS is_current
FROM (SELECT *, max(seq) OVER (PARTITION BY spec_id, anchor, g) AS last_seq FROM islands) i JOIN full_snaps f ON f.spec_id = i.spec_id AND f.seq = i.last_seq
GROUP BY i.spec_id, i.anchor, i.g""",
    "p7_found": _ORPHANS + "SELECT ref_id, reason FROM orphans",
    "p7_report": _ORPHANS + "SELECT (SELECT any_value(name) FROM specs WHERE lower(name) = own_spec) AS spec, strftime(make_timestamp(t), '%Y-%m') AS month, reason, count(*) AS n_refs FROM orphans GROUP BY ALL",
}
