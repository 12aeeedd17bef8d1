"""DuckDB SQL for what SQL can say of the corpus operators: near-duplicate classes whole, of others the parts that are fixed."""

from __future__ import annotations

from .urlrules import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_lower("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, met) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.met),
  c AS (SELECT doc_id, min(met) AS component_id FROM r GROUP BY 1)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_DIGITS = "regexp_replace(f, '[^0-9]', '', 'g')"
PERSONAL_BASE = rf"""WITH k(place, kind, pattern) AS (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), (3, 'card', '[0-9]([\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
  m AS (SELECT doc_id, place, kind, regexp_extract_all(text, pattern) AS fs, string_split_regex(text, pattern) AS gaps FROM documents, k WHERE text IS NOT NULL),
  x AS (SELECT doc_id, place, kind, fs[i] AS f, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(fs[1:i - 1], lambda g: length(g))), 0) AS s FROM (SELECT *, unnest(range(1, len(fs) + 1)) AS i FROM m)),
  d AS (SELECT *, {_DIGITS} AS digits FROM x),
  ok AS (SELECT * FROM d WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(f, '.'), lambda p: coalesce(try_cast(p AS HUGEINT) <= 255, false)))
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j: CASE WHEN j % 2 = 1 THEN reverse(digits)[j]::INT WHEN reverse(digits)[j]::INT > 4 THEN 2 * reverse(digits)[j]::INT - 9 ELSE 2 * reverse(digits)[j]::INT END)) % 10 = 0
    ELSE length(digits) BETWEEN 9 AND 15 END),
  g AS (SELECT doc_id, count(*) FILTER (WHERE place = 1) AS n_email, count(*) FILTER (WHERE place = 2) AS n_ip, count(*) FILTER (WHERE place = 3) AS n_card, count(*) FILTER (WHERE place = 4) AS n_phone,
    string_agg(kind || ':' || s::BIGINT || ':' || (s + length(f))::BIGINT, ',' ORDER BY place, s) AS spans FROM ok GROUP BY 1)
  SELECT documents.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256 FROM documents LEFT JOIN g ON g.doc_id = documents.doc_id"""

_RULE_ROWS = ", ".join(f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for rule, _ in RULES)
URL_PARTS = rf"""WITH k(rule, h, p) AS (VALUES {_RULE_ROWS}),
  r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  u AS (SELECT page_id, {_lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM r)
  SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM k WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)) AS rule FROM u"""

EDITED_TEXTS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM d)
  SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 4) || left(after, length(t) // 4)) AS edited_sha256 FROM n"""

# crc32 of the digits of doc_id, bit by bit; runs are islands of equal words at each distance, found by a self-join on words.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda r, c: list_reduce(list_prepend(xor(r, c), list_transform(range(8), lambda k: k)), lambda b, k: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END))"
PERIODIC_RUNS = rf"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, xor({_CRC}, 4294967295) AS h FROM documents),
  g AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, h % 10 = 0 AND len(ws) > 0 AS hit, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a, 3 + (h // 10) % 8 AS m FROM t),
  w AS (SELECT doc_id, n, i, ws[1 + CASE WHEN hit AND i >= a THEN a + (i - a) % (1 + (n - a) // m) ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM g)),
  e AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
  s AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e),
  r AS (SELECT doc_id, start, length, min(p) AS period FROM (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM s GROUP BY doc_id, p, island) WHERE length >= greatest(24, 3 * p) GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS k FROM r),
  d AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
  c AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS collapsed FROM w LEFT JOIN d ON d.doc_id = w.doc_id AND d.i = w.i WHERE d.i IS NULL GROUP BY 1),
  q AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM r GROUP BY 1)
  SELECT documents.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(q.text, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
  FROM documents LEFT JOIN q ON q.doc_id = documents.doc_id LEFT JOIN b ON b.doc_id = documents.doc_id AND k = 1 LEFT JOIN c ON c.doc_id = documents.doc_id"""

CONTENT_DIGESTS = """SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, sha256(coalesce(text, '')) AS digest FROM documents"""

SOURCE_DIVERGENCE = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  t AS (SELECT r, lang, source, unnest(regexp_extract_all({_lower("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
  v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
  n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
  p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (coalesce(n, 0) + 5 * v) AS p FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
    LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)) // (any_value(n.n) + 5 * any_value(v)) AS q FROM c JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY 1) n USING (lang) JOIN v USING (lang) GROUP BY 1, 2),
  s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE c > 0 AND p.p > q.q)
  SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o) WHERE part = 'pair' OR rank <= 50"""
