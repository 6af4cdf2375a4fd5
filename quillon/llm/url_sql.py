"""The URL filter's meaning as DuckDB SQL, for any rules and settings."""

from __future__ import annotations

from quillon.llm.common import UPPER
from quillon.llm.url_filter import Rule, TreeSettings


def merge_step(source: str, depth: int, s: TreeSettings) -> str:
    """Common table expressions that merge similar siblings at one position."""
    d = depth + 1  # lists count from 1
    at = lambda sign: f"list_transform(template, lambda g, i: CASE WHEN i = {d} THEN '{sign}' ELSE g END)"
    return f"""
nodes{depth} AS (SELECT host, template, sum(bad) AS b, sum(labelled) AS k, {at("*")} AS family FROM {source} WHERE len(template) > {depth} GROUP BY host, template),
sums{depth} AS (SELECT host, family, sum(b) AS fb, sum(k) AS fk, count(*) FILTER (WHERE k >= {s.min_labelled}) AS seen, count(*) FILTER (WHERE k = 0) AS blank FROM nodes{depth} GROUP BY ALL),
told{depth} AS (
  SELECT n.host, n.template, n.k, n.family, blank, seen, fk - k AS rest_k, b / greatest(k, 1) - (fb - b) / greatest(fk - k, 1) AS gap,
    fb / greatest(fk, 1) * (1 - fb / greatest(fk, 1)) * (1 / greatest(k, 1) + 1 / greatest(fk - k, 1)) AS noise
  FROM nodes{depth} n JOIN sums{depth} s ON n.host = s.host AND n.family = s.family),
becomes{depth} AS (
  SELECT host, template, CASE WHEN k >= {s.min_labelled} AND rest_k >= {s.min_labelled} AND seen > 1 AND gap * gap <= {s.similar} * noise THEN family
    WHEN k = 0 AND blank > 1 THEN {at("*?")} ELSE template END AS becomes FROM told{depth}),
tree{depth} AS (SELECT t.host, shape, plain, coalesce(becomes, t.template) AS template, bad, labelled FROM {source} t LEFT JOIN becomes{depth} m ON t.host = m.host AND t.template = m.template),"""


def sql_of(rules: list[Rule], s: TreeSettings = TreeSettings()) -> str:
    ordered = sorted(rules, key=lambda r: -len(r.text))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    pick = lambda f: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{f(r)}'" for r in ordered) + " END"
    merges, source, w = "", "tree", f"CAST({s.prior_weight} AS DOUBLE)"
    for depth in range(s.merge_depth, 0, -1):
        merges += merge_step(source, depth, s)
        source = f"tree{depth}"
    return f"""
WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
raws AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
parsed AS (SELECT page_id, translate(raw, '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM raws),
ruled AS (SELECT *, {pick(lambda r: r.text)} AS rule, {pick(lambda r: r.action)} AS action, regexp_replace(path, '[0-9]+', '{{n}}', 'g') AS shape FROM parsed),
shapes AS (SELECT host, shape, count(*) AS n, count(*) FILTER (WHERE action = 'block') AS bad, count(action) AS labelled FROM ruled GROUP BY host, shape),
parts AS (SELECT *, string_split(shape, '/') AS segs FROM shapes),
steps AS (SELECT host, n, unnest(segs) AS seg, generate_subscripts(segs, 1) AS depth FROM parts),
names AS (SELECT host, depth, seg, sum(n) AS n FROM steps GROUP BY ALL),
vary AS (SELECT host, list(depth) AS depths FROM (SELECT host, depth, count(*) AS names, sum(n) AS n FROM names GROUP BY ALL) WHERE names >= {s.variable_values} AND names >= {s.variable_share} * n GROUP BY host),
tree AS (SELECT *, template AS plain FROM (SELECT p.host, shape, list_transform(segs, lambda g, i: CASE WHEN coalesce(list_contains(depths, i), false) THEN '*' ELSE g END) AS template, bad, labelled FROM parts p LEFT JOIN vary v ON p.host = v.host)),{merges}
own AS (SELECT host, template, template[1 : len(template) - 1] AS parent, CAST(sum(bad) AS DOUBLE) AS b, CAST(sum(labelled) AS DOUBLE) AS k FROM {source} GROUP BY host, template),
branches AS (SELECT host, parent, sum(b) AS pb, sum(k) AS pk FROM own GROUP BY host, parent),
alike AS (SELECT plain, CAST(sum(b) AS DOUBLE) AS gb, CAST(sum(k) AS DOUBLE) AS gk, count(*) FILTER (WHERE k > 0) AS told
  FROM (SELECT host, plain, sum(bad) AS b, sum(labelled) AS k FROM {source} GROUP BY host, plain) GROUP BY plain),
final AS (
  SELECT t.host, t.shape, t.template, (greatest(k, pk) >= {s.min_labelled} OR gk >= {s.min_labelled} AND told >= {s.min_hosts})
    AND (b + {w} * (pb + {w} * (gb + {w} * {s.prior_bad}) / (gk + {w})) / (pk + {w})) / (k + {w}) >= {s.reject_at} AS rejected
  FROM {source} t JOIN own o ON t.host = o.host AND t.template = o.template JOIN branches r ON o.host = r.host AND o.parent = r.parent JOIN alike a ON t.plain = a.plain)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.action, CASE WHEN f.rejected THEN 'block' ELSE 'allow' END) AS verdict, array_to_string(f.template, '/') AS template
FROM ruled r JOIN final f ON r.host = f.host AND r.shape = f.shape
"""
