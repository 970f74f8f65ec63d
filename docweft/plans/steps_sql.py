"""SQL that reads the numbered steps of algorithms anew, line by line, and the queries on steps that must agree with it.

It holds for the regular layout of this project's data (four blanks a level, no list in a list item but numbered ones) and
states every rule by itself: nothing here is taken from the code it checks.
"""

from __future__ import annotations

_LEVELS = 6
_VARS = r"list_transform(regexp_extract_all({t}, '\*[A-Za-z][A-Za-z0-9_-]*\*'), lambda v: trim(v, '*'))"
_SLOTS = r"regexp_extract_all({t}, '\*[A-Za-z][A-Za-z0-9_-]*\*(?:''s\s+|’s\s+|\.)\[\[(\w+)\]\]', 1)"


def _numbers() -> str:
    """The running number of each item at its level, and the first number of its list."""
    groups = ", ".join(f"count(*) FILTER (lv < {k}) OVER o AS g{k}" for k in range(_LEVELS))
    counts = ", ".join(f"count(*) FILTER (lv = {k}) OVER (PARTITION BY spec, anchor, g{k} ORDER BY i) AS n{k}, arg_min(num, i) FILTER (lv = {k}) OVER (PARTITION BY spec, anchor, g{k}) AS f{k}" for k in range(_LEVELS))
    path = "concat_ws('.', " + ", ".join(f"CASE WHEN lv >= {k} THEN f{k} + n{k} - 1 END" for k in range(_LEVELS)) + ")"
    up = "concat_ws('.', " + ", ".join(f"CASE WHEN lv > {k} THEN f{k} + n{k} - 1 END" for k in range(_LEVELS)) + ")"
    return f"""
grouped AS (SELECT *, {groups} FROM items WINDOW o AS (PARTITION BY spec, anchor ORDER BY i)),
counted AS (SELECT *, {counts} FROM grouped),
placed AS (SELECT spec, anchor, item_no, lv, {path} AS step_path, nullif({up}, '') AS parent_path FROM counted)"""


#: After the CTEs of the corpus: steps (spec, anchor, node, step_no, step_path, parent_path, depth, md, text).
STEPS = (
    r""",
alg AS (SELECT spec, anchor, string_split(replace(replace(content_text, E'\r\n', E'\n'), E'\r', E'\n'), E'\n') AS ls FROM sec WHERE section_type = 'algorithm' AND content_text IS NOT NULL),
raw_lines AS (SELECT spec, anchor, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM alg),
fenced AS (SELECT *, regexp_matches(line, '^[ \t]*(```|~~~)') AS fence, count(*) FILTER (regexp_matches(line, '^[ \t]*(```|~~~)')) OVER (PARTITION BY spec, anchor ORDER BY i) AS nf FROM raw_lines),
told AS (SELECT spec, anchor, i, line, length(line) - length(ltrim(line)) AS ind, regexp_matches(line, '^\s*$') AS blank, regexp_matches(line, '^[ \t]*\d{1,9}[.)]([ \t]|$)') AS item FROM fenced WHERE NOT fence AND nf % 2 = 0),
based AS (SELECT *, lag(blank) OVER (PARTITION BY spec, anchor ORDER BY i) AS after_blank, min(i) FILTER (item) OVER (PARTITION BY spec, anchor) AS i0, arg_min(ind, i) FILTER (item) OVER (PARTITION BY spec, anchor) AS base FROM told),
ended AS (SELECT *, min(i) FILTER (i > i0 AND NOT blank AND (item AND ind < base OR NOT item AND ind <= base AND (after_blank OR ltrim(line)[1] IN ('#', '|')))) OVER (PARTITION BY spec, anchor) AS stop FROM based),
listed AS (SELECT *, count(*) FILTER (item) OVER (PARTITION BY spec, anchor ORDER BY i) AS item_no FROM ended WHERE i >= i0 AND (stop IS NULL OR i < stop) AND NOT blank),
items AS (SELECT spec, anchor, i, item_no, (ind - base) // 4 AS lv, CAST(regexp_extract(line, '^[ \t]*(\d+)', 1) AS int) AS num FROM listed WHERE item),"""
    + _numbers()
    + r""",
written AS (SELECT spec, anchor, item_no, string_agg(trim(CASE WHEN item THEN regexp_replace(line, '^[ \t]*\d+[.)][ \t]*', '') ELSE line END, E' \t'), ' ' ORDER BY i) AS md
  FROM listed WHERE item OR NOT regexp_matches(line, '^[ \t]*([-*+][ \t]|>)') GROUP BY ALL),
bare AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '\[((?:[^\[\]]|\[\[[^\[\]]*\]\])*)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*\)', '\1', 'g'), '`+([^`]*)`+', '\1', 'g'), '\*([A-Za-z][A-Za-z0-9_-]*)\*', '\1', 'g'), '\s+', ' ', 'g')) AS text FROM written),
steps AS (SELECT p.spec, p.anchor, p.spec || '#' || p.anchor AS node, p.item_no - 1 AS step_no, step_path, parent_path, lv + 1 AS depth, trim(regexp_replace(md, '\s+', ' ', 'g')) AS md, text FROM placed p JOIN bare USING (spec, anchor, item_no))"""
)

_KIND = r"""CASE WHEN regexp_matches({t}, '^if\b', 'i') THEN 'if' WHEN regexp_matches({t}, '^(otherwise|else)\b', 'i') THEN 'otherwise' WHEN regexp_matches({t}, '^for\s+each\b', 'i') THEN 'for_each'
 WHEN regexp_matches({t}, '^(while\b|repeat\b|loop:)', 'i') THEN 'while' WHEN regexp_matches({t}, '^return\b', 'i') THEN 'return' WHEN regexp_matches({t}, '^(throw|reject)\b', 'i') THEN 'throw'
 WHEN regexp_matches({t}, '^(abort|terminate)\b', 'i') THEN 'abort' WHEN regexp_matches({t}, '^jump\b', 'i') THEN 'jump' WHEN regexp_matches({t}, '^continue\b', 'i') THEN 'continue' WHEN regexp_matches({t}, '^break\b', 'i') THEN 'break'
 WHEN regexp_matches({t}, '^wait\b', 'i') THEN 'wait' WHEN regexp_matches({t}, '^in\s+parallel\b', 'i') THEN 'parallel' WHEN regexp_matches({t}, '^run\s+(the\s+following|these)\s+steps\b', 'i') THEN 'steps'
 WHEN regexp_matches({t}, '^assert\b', 'i') THEN 'assert' WHEN regexp_matches({t}, '^(set|unset)\b', 'i') THEN 'set' WHEN regexp_matches({t}, '^let\b', 'i') THEN 'let'
 WHEN regexp_matches({t}, '^(increment|increase)\b', 'i') THEN 'increment' WHEN regexp_matches({t}, '^(decrement|decrease)\b', 'i') THEN 'decrement'
 WHEN regexp_matches({t}, '^(append|prepend|add|insert|push|enqueue|extend)\b', 'i') THEN 'append' WHEN regexp_matches({t}, '^(remove|empty|clear|delete|dequeue|pop)\b', 'i') THEN 'remove'
 WHEN regexp_matches({t}, '^(run|perform|invoke|call|fire|queue|fetch|validate|resolve|dispatch)\b', 'i') THEN 'call' ELSE 'opaque' END"""

#: Statements: what each step is, defines, uses, writes and reads.
STATEMENTS = (
    STEPS
    + f""",
kinds AS (SELECT *, {_KIND.format(t="md")} AS kind, """
    + r"""regexp_replace(md, '^((if|otherwise,? if|else,? if)\b.*?,\s*(then\s+)?((?:set|unset|let|append|prepend|remove|return|throw|run|increment|decrement)\b))', '\4', 'i') AS led, regexp_replace(md, '^(otherwise|else),\s*(\w)', '\2', 'i') AS led2 FROM steps),
inner_ AS (SELECT *, CASE WHEN kind NOT IN ('if', 'otherwise') THEN md WHEN led <> md THEN led ELSE led2 END AS inn FROM kinds),
acted AS (SELECT *, CASE WHEN inn = md THEN kind ELSE """
    + _KIND.format(t="inn")
    + r""" END AS action,
 nullif(coalesce(nullif(regexp_extract(inn, '(?i)^let\s+\*([A-Za-z][A-Za-z0-9_-]*)\*\s+be\b', 1), ''), nullif(regexp_extract(inn, '(?i)^set\s+\*([A-Za-z][A-Za-z0-9_-]*)\*\s+to\b', 1), ''), regexp_extract(inn, '(?i)^for\s+each\s+(?:\w+\s+)?\*([A-Za-z][A-Za-z0-9_-]*)\*', 1)), '') AS def,
 nullif(coalesce(nullif(regexp_extract(inn, '(?i)^(?:set|unset)\s+\*[A-Za-z][A-Za-z0-9_-]*\*(?:''s\s+|’s\s+|\.)\[\[(\w+)\]\]', 1), ''), regexp_extract(inn, '(?i)^(?:append|prepend|add|insert|push|enqueue|extend|remove|empty|clear|delete|dequeue|pop)\b.*?\*[A-Za-z][A-Za-z0-9_-]*\*(?:''s\s+|’s\s+|\.)\[\[(\w+)\]\]', 1)), '') AS wrote, """
    + f"{_VARS.format(t='md')} AS vars, {_SLOTS.format(t='md')} AS slots"
    + r""" FROM inner_),
st AS (SELECT spec, anchor, node, step_no, step_path, parent_path, depth, text, md, kind, action, CASE WHEN kind = 'opaque' THEN CASE
   WHEN regexp_matches(text, '(?:^|[^\w-])(set|unset|append|prepend|remove|insert|extend|replace|empty|clear|increment|decrement|update|change|reset|enqueue|dequeue|add|store|mark|toggle)(?:[^\w-]|$)', 'i') THEN 'unparsed_mutation'
   WHEN regexp_matches(md, '\[[^\[\]]*\]\([^()\s]*\)') THEN 'unparsed_link' ELSE 'unknown_form' END END AS reason, def, wrote,
 list_sort(list_distinct(list_filter(vars, lambda v: def IS NULL OR v <> def OR len(list_filter(vars, lambda x: x = def)) > 1))) AS uses,
 list_sort(list_distinct(list_filter(slots, lambda v: wrote IS NULL OR v <> wrote OR len(list_filter(slots, lambda x: x = wrote)) > 1))) AS reads,
 list_sort(list_distinct(list_filter(regexp_extract_all(md, '\[(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)*)\)', 1), lambda u: contains(u, '#')))) AS calls FROM acted)"""
)

_SHAPE = r"""CASE WHEN regexp_matches(t, '^(jump|return)\s+to\s+step\s+\d', 'i') THEN 'jump' WHEN regexp_matches(t, '^abort\s+(these\s+steps|this\s+algorithm)\b', 'i') THEN 'abort' WHEN regexp_matches(t, '^return\b', 'i') THEN 'return'
 WHEN regexp_matches(t, '^otherwise\b', 'i') THEN 'otherwise' WHEN regexp_matches(t, '^(for\s+each|while)\b', 'i') THEN 'loop' WHEN regexp_matches(t, '\bin\s+parallel\b', 'i') THEN 'parallel'
 WHEN n_kids > 0 AND regexp_matches(t, '^if\b', 'i') THEN 'if_block' WHEN regexp_matches(t, '^if\b.*,\s*then\b', 'i') THEN 'if_inline' WHEN regexp_matches(t, '^(continue|break|switch\s+on)\b', 'i') THEN 'unrecognised' ELSE 'plain' END"""

#: Control flow: built steps, where each goes on, and the rows of nodes, edges and issues.
FLOW = (
    STEPS.replace("alg AS", "alg AS", 1)
    + r""",
kid_count AS (SELECT spec, anchor, parent_path AS step_path, count(*) AS n_kids, arg_min(step_path, step_no) AS first_kid FROM steps WHERE parent_path IS NOT NULL GROUP BY ALL),
cut_text AS (SELECT s.*, coalesce(n_kids, 0) AS n_kids, first_kid, CASE WHEN length(text) > 120 THEN text[1:120] || '…' ELSE text END AS t FROM steps s LEFT JOIN kid_count USING (spec, anchor, step_path)),
shaped AS (SELECT *, """
    + _SHAPE
    + r""" AS shape, lead(step_path) OVER w AS nxt, lag(step_path) OVER w AS prv FROM cut_text WINDOW w AS (PARTITION BY spec, anchor, parent_path ORDER BY step_no)),
go_on AS (
  SELECT *, nxt AS to_path, CASE WHEN nxt IS NOT NULL THEN 'next' END AS to_kind FROM shaped WHERE parent_path IS NULL
  UNION ALL
  SELECT s.*, CASE WHEN s.nxt IS NOT NULL THEN s.nxt WHEN p.shape = 'loop' THEN p.step_path WHEN p.shape <> 'parallel' THEN p.to_path END,
         CASE WHEN s.nxt IS NOT NULL THEN 'next' WHEN p.shape = 'loop' THEN 'loop' WHEN p.shape <> 'parallel' THEN p.to_kind END
  FROM shaped s JOIN go_on p ON p.spec = s.spec AND p.anchor = s.anchor AND p.step_path = s.parent_path WHERE p.shape IN ('if_block', 'otherwise', 'loop', 'parallel')),
called AS (SELECT DISTINCT c.spec, from_anchor AS anchor, step_path, t_spec || '#' || t_anchor AS dst FROM cref c JOIN sec s ON s.spec = t_spec AND s.anchor = t_anchor AND s.section_type = 'algorithm' WHERE c.kind = 'step' AND step_path IS NOT NULL),
links AS (SELECT DISTINCT g.spec, g.anchor, g.step_path, c.dst FROM go_on g JOIN called c USING (spec, anchor, step_path))
SELECT spec, anchor, 'node' AS item, step_path AS id, NULL AS target, CASE shape WHEN 'abort' THEN 'terminal' WHEN 'return' THEN 'terminal' WHEN 'otherwise' THEN 'branch' WHEN 'if_block' THEN 'branch' WHEN 'if_inline' THEN 'branch' WHEN 'loop' THEN 'loop' WHEN 'parallel' THEN 'parallel' ELSE 'step' END AS kind, t AS text FROM go_on
UNION ALL SELECT DISTINCT spec, anchor, 'node', dst, NULL, 'external', dst FROM links
UNION ALL SELECT spec, anchor, 'edge', step_path, dst, 'call', NULL FROM links
UNION ALL SELECT g.spec, g.anchor, 'edge', p.step_path, g.step_path, 'else', NULL FROM go_on g JOIN go_on p ON p.spec = g.spec AND p.anchor = g.anchor AND p.step_path = g.prv WHERE g.shape = 'otherwise' AND p.shape IN ('if_block', 'if_inline', 'otherwise')
UNION ALL SELECT spec, anchor, 'edge', step_path, first_kid, 'then', NULL FROM go_on WHERE shape IN ('if_block', 'otherwise', 'loop') AND n_kids > 0
UNION ALL SELECT k.spec, k.anchor, 'edge', k.parent_path, k.step_path, 'then', NULL FROM go_on k JOIN go_on p ON p.spec = k.spec AND p.anchor = k.anchor AND p.step_path = k.parent_path WHERE p.shape = 'parallel'
UNION ALL SELECT spec, anchor, 'edge', step_path, to_path, 'then', NULL FROM go_on WHERE shape = 'if_inline' AND to_path IS NOT NULL
UNION ALL SELECT spec, anchor, 'edge', step_path, to_path, 'unknown', NULL FROM go_on WHERE shape = 'unrecognised' AND to_path IS NOT NULL
UNION ALL SELECT g.spec, g.anchor, 'edge', g.step_path, s.step_path, 'jump', NULL FROM go_on g JOIN steps s ON s.spec = g.spec AND s.anchor = g.anchor AND s.step_path = regexp_extract(g.t, '(?i)to\s+step\s+(\d+(?:\.\d+)*)', 1) WHERE g.shape = 'jump'
UNION ALL SELECT spec, anchor, 'edge', step_path, to_path, to_kind, NULL FROM go_on WHERE to_path IS NOT NULL AND (shape IN ('plain', 'loop', 'parallel') OR shape = 'otherwise' AND n_kids = 0)
UNION ALL SELECT g.spec, g.anchor, 'issue', g.step_path, NULL, 'otherwise_without_if', NULL FROM go_on g WHERE g.shape = 'otherwise' AND NOT EXISTS (SELECT 1 FROM go_on p WHERE p.spec = g.spec AND p.anchor = g.anchor AND p.step_path = g.prv AND p.shape IN ('if_block', 'if_inline', 'otherwise'))
UNION ALL SELECT spec, anchor, 'issue', step_path, NULL, 'unrecognised_control', NULL FROM go_on WHERE shape = 'unrecognised'
UNION ALL SELECT g.spec, g.anchor, 'issue', g.step_path, NULL, 'unresolved_jump', NULL FROM go_on g WHERE g.shape = 'jump' AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.spec = g.spec AND s.anchor = g.anchor AND s.step_path = regexp_extract(g.t, '(?i)to\s+step\s+(\d+(?:\.\d+)*)', 1))"""
)

#: Forward slices by the first variable that each algorithm defines.
SLICES = (
    STATEMENTS
    + r""",
wanted AS (SELECT spec, anchor, arg_min(def, step_no) AS variable FROM st WHERE def IS NOT NULL GROUP BY ALL),
have AS (SELECT spec, anchor, variable AS v FROM wanted UNION SELECT s.spec, s.anchor, s.def FROM st s JOIN have h ON h.spec = s.spec AND h.anchor = s.anchor WHERE s.def IS NOT NULL AND list_contains(s.uses, h.v)),
all_have AS (SELECT spec, anchor, list(v) AS vs FROM have GROUP BY ALL),
named AS (SELECT s.spec, s.anchor, step_no, step_path, parent_path, CASE WHEN def IS NULL THEN uses ELSE list_append(uses, def) END AS ns, vs FROM st s JOIN all_have USING (spec, anchor)),
met AS (SELECT *, list_has_any(ns, vs) AS m FROM named),
kept AS (SELECT spec, anchor, step_path, 'matched' AS role FROM met WHERE m
  UNION ALL SELECT x.spec, x.anchor, x.step_path, 'inherited' FROM met x JOIN kept k ON k.spec = x.spec AND k.anchor = x.anchor AND k.step_path = x.parent_path WHERE len(x.ns) = 0),
above AS (SELECT spec, anchor, step_path AS spot FROM kept UNION SELECT s.spec, s.anchor, s.parent_path FROM st s JOIN above a ON a.spec = s.spec AND a.anchor = s.anchor AND a.spot = s.step_path WHERE s.parent_path IS NOT NULL),
sliced AS (SELECT spec, anchor, step_path, role FROM kept UNION ALL SELECT spec, anchor, spot, 'context' FROM above a WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.spec = a.spec AND k.anchor = a.anchor AND k.step_path = a.spot))"""
)

SQL_PARTS = {
    "statements": STATEMENTS + " SELECT spec, anchor, step_no, step_path, parent_path, depth, text, kind, action, reason, coalesce(def, '') AS defs, array_to_string(uses, ' ') AS uses, coalesce(wrote, '') AS writes, array_to_string(reads, ' ') AS reads, array_to_string(calls, ' ') AS calls FROM st",
    "flow_all": FLOW,
    "algorithm_views": STATEMENTS
    + """, h AS (SELECT spec, anchor, string_agg(kind || '=' || n, ' ' ORDER BY kind) AS histogram FROM (SELECT spec, anchor, kind, count(*) AS n FROM st GROUP BY ALL) GROUP BY ALL)
SELECT s.spec, s.anchor, count(*) AS n_steps, max(depth) AS max_depth, any_value(histogram) AS histogram, count(DISTINCT def) AS n_variables, count(wrote) AS n_writes, CAST(sum(len(calls)) AS BIGINT) AS n_calls, count(*) FILTER (kind = 'opaque') AS n_opaque FROM st s JOIN h USING (spec, anchor) GROUP BY ALL""",
    "state_fields": STATEMENTS
    + """, site AS (SELECT node, step_path, wrote AS field, 'write' AS class FROM st WHERE wrote IS NOT NULL UNION ALL SELECT node, step_path, unnest(reads), CASE WHEN kind = 'opaque' THEN 'opaque' ELSE 'read' END FROM st),
w AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY node, step_path) AS k FROM site WHERE class = 'write')
SELECT field, count(*) FILTER (class = 'write') AS n_writes, count(*) FILTER (class = 'read') AS n_reads, count(*) FILTER (class = 'opaque') AS n_opaque, count(DISTINCT node) FILTER (class = 'write') AS n_writers, CASE WHEN count(*) FILTER (class = 'opaque') = 0 THEN 'complete' ELSE 'partial' END AS status,
 (SELECT string_agg(node || ':' || step_path, ' ' ORDER BY k) FROM w WHERE w.field = site.field AND k <= 50) AS writing_sites FROM site GROUP BY field""",
    "state_members": STATEMENTS + " SELECT wrote AS field, count(*) FILTER (action <> 'remove' AND lower(text[1:6]) <> 'unset ') AS n_adds, count(*) FILTER (action = 'remove' OR lower(text[1:6]) = 'unset ') AS n_removes FROM st WHERE wrote IS NOT NULL GROUP BY wrote",
    "state_counts": STATEMENTS + ", site AS (SELECT wrote AS field, 'write' AS class FROM st WHERE wrote IS NOT NULL UNION ALL SELECT unnest(reads), CASE WHEN kind = 'opaque' THEN 'opaque' ELSE 'read' END FROM st) SELECT field, class, count(*) AS n FROM site GROUP BY ALL",
    "slices_forward": SLICES + " SELECT s.spec, s.anchor, w.variable, step_path, role FROM sliced s JOIN wanted w USING (spec, anchor)",
    "slices_backward": STATEMENTS
    + r""",
goal AS (SELECT spec, anchor, arg_max(step_path, step_no) AS target, max(step_no) AS spot FROM st GROUP BY ALL),
deps AS (SELECT s.spec, s.anchor, s.step_no AS a, d.step_no AS b, 'definition' AS role FROM st s JOIN st d ON d.spec = s.spec AND d.anchor = s.anchor AND d.step_no < s.step_no AND d.def IS NOT NULL AND list_contains(s.uses, d.def)
  UNION ALL SELECT s.spec, s.anchor, s.step_no, p.step_no, 'context' FROM st s JOIN st p ON p.spec = s.spec AND p.anchor = s.anchor AND p.step_path = s.parent_path),
need AS (SELECT spec, anchor, spot AS k, 'target' AS role FROM goal UNION SELECT d.spec, d.anchor, d.b, d.role FROM need n JOIN deps d ON d.spec = n.spec AND d.anchor = n.anchor AND d.a = n.k)
SELECT s.spec, s.anchor, g.target, s.step_path, CASE WHEN bool_or(role = 'target') THEN 'target' WHEN bool_or(role = 'definition') THEN 'definition' ELSE 'context' END AS role
FROM need n JOIN st s ON s.spec = n.spec AND s.anchor = n.anchor AND s.step_no = n.k JOIN goal g ON g.spec = s.spec AND g.anchor = s.anchor GROUP BY ALL""",
    "omitted_runs": SLICES
    + r""",
flags AS (SELECT s.spec, s.anchor, s.step_no, s.step_path, s.parent_path, k.role IS NOT NULL AS kept_here FROM st s LEFT JOIN sliced k USING (spec, anchor, step_path)),
weight AS (SELECT a.spec, a.anchor, a.step_path, count(*) AS size FROM flags a JOIN flags b ON b.spec = a.spec AND b.anchor = a.anchor AND (b.step_path = a.step_path OR starts_with(b.step_path, a.step_path || '.')) GROUP BY ALL),
island AS (SELECT *, count(*) FILTER (kept_here) OVER (PARTITION BY spec, anchor, parent_path ORDER BY step_no) AS g FROM flags),
out_ AS (SELECT i.*, size FROM island i JOIN weight USING (spec, anchor, step_path) WHERE NOT kept_here AND (parent_path IS NULL OR EXISTS (SELECT 1 FROM flags p WHERE p.spec = i.spec AND p.anchor = i.anchor AND p.step_path = i.parent_path AND p.kept_here)))
SELECT spec, anchor, parent_path, arg_min(step_path, step_no) AS first_path, arg_max(step_path, step_no) AS last_path, CAST(sum(size) AS BIGINT) AS n_steps FROM out_ GROUP BY spec, anchor, parent_path, g""",
}
