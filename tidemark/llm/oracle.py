"""DuckDB SQL for those queries of this subpackage that SQL can express."""

OP4 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n,
         sha256(coalesce(html, '')) AS d
  FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

OP6 = r"""
WITH RECURSIVE c AS (
  SELECT DISTINCT conv_id, turn, lower(coalesce(role, '')) AS role, coalesce(text, '') AS text,
         lower(coalesce(role, '')) = 'assistant' AND (conv_id * 31 + turn * 7) % 10 >= 3 AS asks, (conv_id * 31 + turn * 7) % 10 AS r
  FROM conversations),
a AS (
  SELECT conv_id, turn, r, CASE r WHEN 3 THEN 'c' || (turn - 2) ELSE 'c' || turn END AS id,
         CASE r WHEN 4 THEN 'nope' ELSE 'lookup' END AS name,
         CASE r WHEN 5 THEN json_object('n', 'x')
                WHEN 6 THEN json_object('n', turn, 'q', substr(md5(text), 1, 8), 'z', 1)
                WHEN 7 THEN json_object('n', turn)
                ELSE json_object('n', turn, 'q', substr(md5(text), 1, 8)) END AS args,
         CASE r WHEN 4 THEN 'unknown tool' WHEN 5 THEN 'not integer: n; missing: q' WHEN 6 THEN 'unknown: z' WHEN 7 THEN 'missing: q' ELSE '' END AS errors,
         CASE WHEN r BETWEEN 4 AND 8 THEN 'c' || (turn - 2) WHEN r = 9 THEN 'c' || turn END AS dep
  FROM c WHERE asks),
calls AS (
  SELECT conv_id, turn, id, name, args, errors, dep FROM a
  UNION ALL SELECT conv_id, turn, 'turn:' || turn, 'reply', json_object('prompt', text), '', NULL FROM c WHERE role = 'user'),
results AS (
  SELECT conv_id, turn, CASE r WHEN 6 THEN 'zz' ELSE id END AS id, 'found ' || turn AS content FROM a WHERE r NOT IN (4, 7)
  UNION ALL SELECT conv_id, turn, 'turn:' || (turn - 1), text FROM c WHERE role = 'assistant' AND NOT asks),
nodes AS (SELECT conv_id, id, min(turn) AS first FROM calls GROUP BY ALL),
edges AS (SELECT DISTINCT k.conv_id, k.id, k.dep FROM calls k JOIN nodes n ON n.conv_id = k.conv_id AND n.id = k.dep),
lv AS (
  SELECT conv_id, id, 0 AS level FROM nodes ANTI JOIN edges USING (conv_id, id)
  UNION ALL SELECT e.conv_id, e.id, lv.level + 1 FROM edges e JOIN lv ON lv.conv_id = e.conv_id AND lv.id = e.dep),
answers AS (SELECT DISTINCT conv_id, id FROM results)
SELECT k.conv_id, k.turn, 0 AS part, 'call' AS kind, k.id AS call_id,
       CASE WHEN k.turn <> n.first THEN 'duplicate' WHEN w.id IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
       lv.level, k.errors, json_object('arguments', k.args, 'id', k.id, 'kind', 'call', 'name', k.name)::VARCHAR AS json
FROM calls k JOIN nodes n USING (conv_id, id) LEFT JOIN lv USING (conv_id, id) LEFT JOIN answers w USING (conv_id, id)
UNION ALL
SELECT r.conv_id, r.turn, 0, 'result', r.id, CASE WHEN n.id IS NULL THEN 'orphan' WHEN r.turn < n.first THEN 'early' ELSE 'linked' END,
       lv.level + 1, '', json_object('content', r.content, 'id', r.id, 'kind', 'result')::VARCHAR
FROM results r LEFT JOIN nodes n USING (conv_id, id) LEFT JOIN lv USING (conv_id, id)
UNION ALL
SELECT conv_id, turn, 0, 'message', NULL, NULL, NULL, '', json_object('content', text, 'kind', 'message', 'role', role)::VARCHAR
FROM c WHERE role NOT IN ('user', 'assistant', 'tool') OR (asks AND regexp_matches(text, '\S'))
"""

OP8 = r"""
WITH p AS (
  SELECT page_id, url, make_timestamp((1704067200 + (page_id * 7919 % 525600) * 60) * 1000000) AS fetched_at,
         nullif(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host AS pattern FROM p WHERE host IS NOT NULL),
cut AS (SELECT host, string_split(host, '.') AS s FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
parents AS (
  SELECT host, unnest(list_transform(range(1, greatest(len(s) - 1, 1) + 1), lambda k: array_to_string(list_slice(s, k, len(s)), '.'))) AS pattern
  FROM cut),
named AS (
  SELECT pattern, ('0x' || substr(md5(pattern), 1, 4))::INT % 300 AS a, ('0x' || substr(md5(pattern), 5, 4))::INT % 60 + 1 AS b,
         ('0x' || substr(md5(pattern), 9, 4))::INT % 60 + 1 AS c, ('0x' || substr(md5(pattern), 13, 4))::INT AS e, own
  FROM (SELECT pattern, true AS own FROM hosts UNION ALL
        SELECT DISTINCT pattern, false FROM parents WHERE pattern <> host)),
entries AS (
  SELECT pattern, 'block' AS action, (DATE '2024-01-01' + a)::TIMESTAMP AS listed_at FROM named WHERE own AND e % 2 = 0 UNION ALL
  SELECT pattern, 'allow', (DATE '2024-01-01' + a + b)::TIMESTAMP FROM named WHERE own AND e % 2 = 0 UNION ALL
  SELECT pattern, 'remove', (DATE '2024-01-01' + a + b + c)::TIMESTAMP FROM named WHERE own AND e % 2 = 0 UNION ALL
  SELECT pattern, 'block', (DATE '2024-01-01' + a)::TIMESTAMP FROM named WHERE NOT own AND e % 4 = 0),
dated AS (SELECT pattern, listed_at, max(action) AS action FROM entries GROUP BY ALL),
valid AS (SELECT *, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS until FROM dated),
hit AS (
  SELECT q.host, q.fetched_at, arg_max(v, length(v.pattern)) AS v
  FROM (SELECT DISTINCT host, fetched_at FROM p) q JOIN parents r ON r.host = q.host
  JOIN valid v ON v.pattern = r.pattern AND v.listed_at <= q.fetched_at AND (v.until IS NULL OR q.fetched_at < v.until)
  WHERE v.action <> 'remove' GROUP BY ALL)
SELECT page_id, url, p.fetched_at, p.host, coalesce(v.action, 'none') AS verdict, v.pattern AS pattern, v.listed_at AS listed_at
FROM p LEFT JOIN hit ON hit.host = p.host AND hit.fetched_at = p.fetched_at
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT k, lang, source, term, count(*) AS n FROM t GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING count(*) >= 10),
s AS (SELECT lang, source, term, sum(c.n)::BIGINT AS n FROM c JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY 1),
g AS (SELECT lang, source, coalesce(sum(s.n), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source) GROUP BY ALL),
cell AS (
  SELECT g.lang, g.source, kept.term, coalesce(s.n, 0) AS n, 1 + (1000000000 * (coalesce(s.n, 0) + 2)) // (g.n + 2 * v.v) AS p,
         1 + (1000000000 * (kept.n + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = kept.term),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM cell WHERE n > 0 AND p > q),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs))
WHERE part = 'pair' OR rank <= 10
"""

# SQL has no crc32: a table of 256 numbers, made by rule, and one step a byte
OP13 = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
r AS (SELECT k, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run
      FROM (SELECT row_number() OVER () AS k, * FROM documents)),
c AS (SELECT k, coalesce(doc_id::VARCHAR, '') AS doc, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192::BIGINT + unicode(x) // 64, 128::BIGINT + unicode(x) % 64] END))),
    lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1]))) AS h
  FROM c, crc),
w AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
wild AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM p),
gone AS (SELECT DISTINCT word, n, a || b AS rest FROM wild),
near AS (
  SELECT x.word, y.word AS other, y.n FROM wild x JOIN wild y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT gone.word, w.word, w.n FROM gone JOIN w ON gone.rest = w.word
  UNION ALL SELECT w.word, gone.word, gone.n FROM gone JOIN w ON gone.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'word': other}}) AS b FROM near GROUP BY 1),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 5 * w.n THEN b.word END AS form, CASE WHEN -b.less >= 5 * w.n THEN -b.less END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word),
on_way AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT o.word, f.form, steps + 1 FROM on_way o JOIN f ON o.root = f.word WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, steps) AS root FROM on_way GROUP BY 1)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN last ON f.word = last.word
"""

SQL: dict[str, str] = {
    "op4_warc": OP4, "op6_chat_format": OP6, "op8_url_filters": OP8, "op12_source_divergence": OP12, "op13_spelling_variants": OP13,
}
