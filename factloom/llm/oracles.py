"""DuckDB SQL that states the results of operators whose result does not depend on their hashes."""

from __future__ import annotations

from .url_filters import HOST_RULES, PATTERNS, pattern_rule

#: Operator 5: exact shingle sets, joined on shingles; components by reachability.
OP5 = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), classes AS MATERIALIZED (
  SELECT list_sort(s) AS s, min(doc_id) AS rep, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), posts AS MATERIALIZED (
  SELECT rep, n, unnest(s) AS h FROM classes
), links AS MATERIALIZED (
  SELECT x.rep AS a, y.rep AS b FROM posts x JOIN posts y ON x.h = y.h AND x.rep < y.rep AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 75
  GROUP BY x.rep, y.rep, x.n, y.n HAVING count(*) * 100 >= (x.n + y.n - count(*)) * 75
), both_ways AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rep AS node, rep AS root FROM classes
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.root < e.b
), roots AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes c ON len(d.s) > 0 AND c.s = list_sort(d.s) LEFT JOIN roots r ON r.node = c.rep
"""

#: Operator 8: all pairs of one label.
OP8 = r"""
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings
), good AS MATERIALIZED (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda v: v * v))) AS norm FROM vectors
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
), links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE x.norm > 0 AND y.norm > 0 AND list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b
), roots AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, r.root AS component_id, r.root = v.vec_id AS kept
FROM embeddings v JOIN roots r ON r.node = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id
"""

#: Operator 13: every document through every order of the five filters.
OP13 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT d.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic, [
    len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS f
  FROM docs d LEFT JOIN marks m ON m.doc_id = d.doc_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [ascii(a.l) - 64, ascii(b.l) - 64, ascii(c.l) - 64, ascii(d.l) - 64, ascii(e.l) - 64] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT part, good, toxic, filter_order, unnest([1, 2, 3, 4, 5]) AS step, o, f, coalesce(list_position(list_transform(o, lambda i: f[i]), true), 0) AS place FROM flags, orders
), firsts AS (
  SELECT *, CASE WHEN place > 0 THEN place ELSE 6 END AS first FROM steps
), counted AS (
  SELECT part, filter_order, step::INT AS step, sum((first > step)::INT)::BIGINT AS kept, sum((first = step)::INT)::BIGINT AS removed,
    sum((f[o[step]] AND first < step)::INT)::BIGINT AS redundant, sum((f[o[step]] AND len(list_filter(f, lambda x: x)) = 1)::INT)::BIGINT AS unique_fails,
    sum((first = step AND good = 1)::INT)::BIGINT AS good_lost, sum((first = step AND toxic = 1)::INT)::BIGINT AS toxic_lost, substr(filter_order, step::INT, 1) AS filter
  FROM firsts GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley, filter FROM counted
"""


def _listed(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


#: Operator 12: every URL against every rule.
OP12 = rf"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, regexp_extract(rest, '^[^?#]*', 0) AS whole,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts
), sited AS (
  SELECT page_id, low, host, substr(whole, length(host) + 1) AS path FROM split
), host_rules(h, p, verdict) AS (VALUES {_listed(HOST_RULES)}),
patterns(rule, verdict, regex) AS (VALUES {_listed([(r["rule"], r["verdict"], r["regex"].replace("(?>", "(?:")) for r in (pattern_rule(*p) for p in PATTERNS)])}),
hosts AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM sited, host_rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
), matched AS (
  SELECT page_id, arg_max((rule, verdict), (length(rule), verdict = 'block', rule)) AS best FROM sited, patterns WHERE regexp_matches(low, regex) GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, r.rule, coalesce(r.verdict, m.best[2], 'allow') AS verdict, m.best[1] AS pattern
FROM sited s LEFT JOIN hosts r ON r.page_id = s.page_id LEFT JOIN matched m ON m.page_id = s.page_id
"""
