"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
test AS (
  SELECT item_id, least(len(w), 10) AS k, list_slice(w, p, p + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)
),
spans AS (
  SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p
  FROM d, (SELECT DISTINCT k FROM test) WHERE len(w) >= k
),
found AS (
  SELECT doc_id, p, s.k, item_id
  FROM (SELECT doc_id, p, k, list_slice(w, p, p + k - 1) AS g FROM spans) s JOIN test USING (k, g)
),
hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id
),
lists AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN lists USING (doc_id)
"""

_LONG = "('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz', 'co.za', 'com.cn')"


def _strength(units: str) -> str:
    return f"""(SELECT 1 / least(greatest(coalesce(CASE WHEN sum(bad) > 0 AND sum(bad) < sum(n) THEN
        (sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) - sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) * (count(*) - 1))
        / (sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1))) END, 0), 0.001), 0.5) - 1
      FROM {units} WHERE n > 0)"""


OP4 = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
l AS (SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS is_bad FROM labels GROUP BY 1),
hosts AS (
  SELECT host, CAST(count(is_bad) AS DOUBLE) AS n, CAST(coalesce(sum(is_bad::INT), 0) AS DOUBLE) AS bad,
    string_split(host, '.') AS s, array_to_string(s[-2:], '.') AS two,
    CASE WHEN two IN {_LONG} THEN array_to_string(s[-3:], '.') ELSE two END AS domain,
    CASE WHEN two IN {_LONG} THEN two ELSE s[-1] END AS suffix
  FROM p LEFT JOIN l ON doc_id = TRY_CAST(nullif(regexp_extract(path, '([0-9]{{1,18}})(\.html)?/?$', 1), '') AS BIGINT)
  GROUP BY host
),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
m AS (SELECT {_strength('suffixes')} AS s, {_strength('domains')} AS d, {_strength('hosts')} AS h,
        (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM suffixes) AS o),
sm AS (SELECT suffix, (bad + m.s * m.o) / (n + m.s) AS mean FROM suffixes, m),
dm AS (SELECT domain, (bad + m.d * sm.mean) / (n + m.d) AS mean FROM domains JOIN sm USING (suffix), m),
hm AS (SELECT host, hosts.n, hosts.bad, (hosts.bad + m.h * dm.mean) / (hosts.n + m.h) AS mean, hosts.n + m.h AS w
       FROM hosts JOIN dm USING (domain), m),
rules(rule, h, pre, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
fit AS (
  SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS v
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, fit.rule,
  coalesce(v, CASE WHEN p.host <> '' AND mean - 1.645 * sqrt(mean * (1 - mean) / (w + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(hm.n AS BIGINT) AS host_n, CAST(hm.bad AS BIGINT) AS host_bad
FROM p JOIN hm USING (host) LEFT JOIN fit USING (page_id)
"""


_PLAIN = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _linked(shingle: int, p: int, q: int, extra: str = "") -> str:
    """Documents whose sets of ``shingle``-word shingles have a Jaccard
    similarity of p / q: equal sets are one vertex, linked by common shingles."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN.format(_FOLD)} AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= {shingle} THEN list_transform(range(1, len(w) - {shingle} + 2),
           lambda i: array_to_string(w[i:i + {shingle - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d
),
t AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS k, g FROM s),
v AS (SELECT k, any_value(n) AS n, any_value(g) AS g, min(doc_id) AS first FROM t WHERE n > 0 GROUP BY k),
e AS (SELECT k, n, unnest(g) AS e FROM v),
linked AS (
  SELECT a.k AS x, b.k AS y FROM e a JOIN e b ON a.e = b.e AND a.k < b.k AND least(a.n, b.n) * {q} >= greatest(a.n, b.n) * {p}
  GROUP BY a.k, b.k, a.n, b.n HAVING {q} * count(*) >= {p} * (a.n + b.n - count(*))
),
both_ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (SELECT k AS x, k AS y FROM v UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
c AS (SELECT r.x AS k, min(v.first) AS component FROM reach r JOIN v ON r.y = v.k GROUP BY r.x)
SELECT doc_id, t.n AS n_shingles, coalesce(component, doc_id) AS component_id{extra}
FROM t LEFT JOIN c ON t.k = c.k AND t.n > 0
"""


OP2 = _linked(3, 9, 10)
OP13 = _linked(2, 4, 5, ", doc_id = coalesce(component, doc_id) AS kept")


def _crc32(number: str) -> str:
    """crc32 of a number's decimal text: every byte is followed by eight shifts."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
      string_split({number}::VARCHAR, ''), lambda b: [ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""


OP11 = rf"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'said': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
h AS (SELECT conv_id, t, {_crc32('conv_id')} % 9 AS h FROM own),
built AS (
  SELECT h.conv_id, list_concat(coalesce(b.t[:h.h], []), h.t[h.h + 1:]) AS t
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5
),
cut AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM built),
member AS (SELECT conv_id, depth, t[:depth] AS path, depth = len(t) AS ends FROM cut),
node AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(octet_length(encode(path[-1].said)), 0) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY path, depth
),
childless AS (SELECT path, depth FROM node EXCEPT SELECT path[:depth - 1], depth - 1 FROM node WHERE depth > 0),
above AS (
  SELECT path[:up] AS path, n_convs, bytes, path IN (SELECT path FROM childless) AS leaf, up = depth - 1 AS child
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM node)
),
summed AS (
  SELECT path, count(*) FILTER (child) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM above GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves,
  saved::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN summed s ON s.path = n.path LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]
"""

OP12 = rf"""
WITH d AS (SELECT doc_id, {_PLAIN.format("coalesce(text, '')")} AS w, {_crc32('doc_id')} AS h FROM documents),
p AS (
  SELECT doc_id, w, h % 10 = 0 AND len(w) > 0 AS moved, (h // 10) % greatest(len(w), 1) AS a,
    1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p
  FROM d
),
x AS (
  SELECT doc_id, CASE WHEN moved THEN list_transform(range(0, len(w)),
           lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w
  FROM p
),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM x),
same AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q
  FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY doc_id, q, k),
run AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY ALL
),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs
  FROM run GROUP BY doc_id
),
best AS (
  SELECT doc_id, start, length, period FROM run
  -- an exact comparison: no two fractions of numbers below a million differ by less than 1e-12
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (length * 1000000000000000::HUGEINT) // period DESC, start, period) = 1
),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (
  SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS words
  FROM u ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i GROUP BY u.doc_id
)
SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period,
  1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM x LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": OP2,
        "op4_host_reputation": OP4,
        "op5_decontaminate": OP5,
        "op11_prefix_trie": OP11,
        "op12_periodic_runs": OP12,
        "op13_set_sketch": OP13,
    }
