"""DuckDB SQL for the queries of this subpackage that SQL can express."""

import math

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH t AS (SELECT doc_id, {LOWERED} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

#: Spans by running lengths of what lies between and in the matches; entropy by counting every window anew.
OP2 = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
pat(kind, p) AS (VALUES
  (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')),
m AS (
  SELECT rid, 0 AS kind, regexp_extract_all(x, (SELECT p FROM pat WHERE kind = 0), 0) AS h, string_split_regex(x, (SELECT p FROM pat WHERE kind = 0)) AS g FROM t
  UNION ALL SELECT rid, 1, regexp_extract_all(x, 'AKIA[A-Z0-9]+', 0), string_split_regex(x, 'AKIA[A-Z0-9]+') FROM t
  UNION ALL SELECT rid, 2, regexp_extract_all(x, '[0-9a-f]{32,}', 0), string_split_regex(x, '[0-9a-f]{32,}') FROM t),
e AS (SELECT rid, kind, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap, unnest(range(1, len(h) + 1)) AS n FROM m),
s AS (SELECT rid, kind, hit, n, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY n) AS stop FROM e),
base AS (SELECT rid, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s
  WHERE (kind = 0 AND length(regexp_extract(hit, (SELECT p FROM pat WHERE kind = 0), 2)) >= 8) OR (kind = 1 AND length(hit) >= 16) OR kind = 2),
cuts AS (SELECT rid, list(start || ':' || stop ORDER BY start, stop) AS cut FROM base GROUP BY rid),
masked AS (SELECT rid, CASE WHEN cut IS NULL THEN x ELSE list_reduce(list_prepend(x, cut), lambda acc, s: substr(acc, 1, CAST(split_part(s, ':', 1) AS BIGINT))
  || repeat(' ', CAST(split_part(s, ':', 2) AS BIGINT) - CAST(split_part(s, ':', 1) AS BIGINT)) || substr(acc, CAST(split_part(s, ':', 2) AS BIGINT) + 1)) END AS y FROM t LEFT JOIN cuts USING (rid)),
q AS (SELECT rid, regexp_extract_all(y, '[A-Za-z0-9+/_=-]{20,}', 0) AS h, string_split_regex(y, '[A-Za-z0-9+/_=-]{20,}') AS g FROM masked),
qe AS (SELECT rid, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap, unnest(range(1, len(h) + 1)) AS n FROM q),
qs AS (SELECT rid, hit, n, sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY n) - length(hit) AS start FROM qe),
qp AS (SELECT rid, n, start, unnest(cells) AS hit, unnest(range(1, len(cells) + 1)) AS k FROM (SELECT *, CASE WHEN regexp_matches(hit, '//|/[a-z]+/|^/') THEN string_split(hit, '/') ELSE [hit] END AS cells FROM qs)),
qa AS (SELECT rid, hit, start + sum(length(hit) + 1) OVER (PARTITION BY rid, n ORDER BY k) - length(hit) - 1 AS start FROM qp),
runs AS (SELECT rid, hit, CAST(start AS BIGINT) AS start, CAST(start + length(hit) AS BIGINT) AS stop FROM qa WHERE length(hit) >= 20
  AND NOT regexp_matches(hit, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
  AND NOT regexp_matches(hit, '(?i)example|sample|placeholder|changeme|your[_-]|xxxx')
  AND NOT regexp_matches(hit, '(?i)0123456789|abcdefghij|qwertyuiop') AND NOT regexp_matches(hit, '^[0-9+/_=-]+$')),
w AS (SELECT rid, start, stop, hit, unnest(range(1, length(hit) - 18)) AS i FROM runs),
c AS (SELECT rid, start, stop, hit, i, unnest(string_split(substr(hit, CAST(i AS BIGINT), 20), '')) AS ch FROM w),
k AS (SELECT rid, start, stop, hit, i, ch, count(*) AS n FROM c GROUP BY ALL),
f AS (SELECT rid, start, stop, hit, i, sum(CAST(round(n * log2(n) * 1048576) AS BIGINT)) AS z FROM k GROUP BY ALL),
rnd AS (SELECT rid, start, stop FROM f GROUP BY rid, start, stop, hit
  HAVING min(z) <= CASE WHEN regexp_matches(hit, '^[0-9a-fA-F]+$') THEN {hex} WHEN regexp_matches(hit, '^[A-Za-z+/_=-]+$') THEN {letters} ELSE {mixed} END),
spans AS (SELECT * FROM base UNION ALL
  SELECT rid, 3, start, stop FROM rnd),
named AS (SELECT rid, kind, start, (['assign', 'access', 'hex', 'entropy'])[kind + 1] || ':' || start || ':' || stop AS z FROM spans),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(z, ',' ORDER BY start, kind) FILTER (kind < 3) AS b, string_agg(z, ',' ORDER BY start, kind) AS spans FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (rid)
"""

#: Windows of every length counted as texts, the longer ones where those of five repeat; covered positions one by one.
OP4 = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT rid, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
b AS (SELECT rid, doc_id, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) AS n_lines, len(list_distinct(lines)) AS n_distinct, list_sum(list_transform(lines, lambda v: length(v))) AS line_chars,
  list_sum(list_transform(list_distinct(lines), lambda v: length(v))) AS distinct_chars FROM w),
f AS (SELECT rid, 5 AS n, i, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, n_words - 3)) AS i FROM b)),
again AS (SELECT DISTINCT rid FROM (SELECT rid FROM f GROUP BY rid, gram HAVING count(*) > 1)),
g AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT rid, w, CAST(n AS BIGINT) AS n, unnest(range(1, n_words - n + 2)) AS i FROM b SEMI JOIN again USING (rid), range(5, 11) r(n))),
k AS (SELECT rid, n, gram FROM g GROUP BY rid, n, gram HAVING count(*) > 1),
d AS (SELECT rid, n, i FROM g SEMI JOIN k USING (rid, n, gram)),
p AS (SELECT DISTINCT rid, n, unnest(range(i, i + n)) AS pos FROM d),
s AS (SELECT p.rid, p.n, count(*) AS words, sum(length(b.w[p.pos])) AS chars FROM p JOIN b USING (rid) GROUP BY p.rid, p.n),
v AS (SELECT rid, max(words) FILTER (n = 5) AS n_repeat, max(CAST(chars AS DOUBLE) / word_chars / CAST(([0.15, 0.14, 0.13, 0.12, 0.11, 0.10])[n - 4] AS DOUBLE)) AS worst FROM s JOIN b USING (rid) GROUP BY rid),
r AS (SELECT doc_id, n_words, word_chars, n_symbols, n_lines - n_distinct AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(n_repeat, 0) > 20 * n_words AS base_failed, greatest(coalesce(worst, 0), CASE WHEN n_lines > n_distinct THEN
    greatest((n_lines - n_distinct)::DOUBLE / n_lines / 0.3::DOUBLE, (line_chars - distinct_chars)::DOUBLE / line_chars / 0.2::DOUBLE) ELSE 0 END) AS worst FROM b LEFT JOIN v USING (rid))
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND worst <= 1.0 AS kept FROM r
"""


def _op2() -> str:
    bound = lambda bits: str(round((math.log2(20) - bits) * 20 * 1048576))
    return OP2.replace("{hex}", bound(3.0)).replace("{letters}", bound(3.9)).replace("{mixed}", bound(3.7))


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": _op2(), "op4_repetition_rules": OP4, "op9_exact_dedup": OP9}
