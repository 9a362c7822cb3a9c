"""DuckDB twins of the queries that SQL can express on whole tables."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = "regexp_extract_all(translate(coalesce({t}, ''), '" + _UP + "', '" + _LOW + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_PLAIN_TEXT = "regexp_replace(replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;?', '&', 'g')"

ORACLE_SQL = {
    # the given pages mark their article plainly, with headings and paragraphs only
    "op1_html_extraction": rf"""
WITH a AS (SELECT page_id, url, string_split(regexp_replace(replace(replace(replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<br>', ' '), '<b>', ''), '</b>', ''), '</?(?:h1|p)>', chr(1), 'g'), chr(1)) AS bs FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(bs, lambda b: trim(regexp_replace({_PLAIN_TEXT}, '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)) AS text FROM a)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM t""",
    "op2_benchmark_decontamination": f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_FOLDED.format(t='text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_FOLDED.format(t='text')} AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op5_near_duplicates": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_FOLDED.format(t='text')} AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
sig AS (SELECT doc_id, count(*) AS n, md5(string_agg(CAST(s AS VARCHAR), ',' ORDER BY s)) AS sig FROM g GROUP BY doc_id),
rep AS MATERIALIZED (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY sig) AS rep FROM sig),
r AS MATERIALIZED (SELECT g.doc_id, g.s FROM g JOIN rep ON g.doc_id = rep.doc_id AND rep.rep = rep.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM r a JOIN r b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN rep x ON a = x.doc_id JOIN rep y ON b = y.doc_id WHERE i / (x.n + y.n - i) >= 0.8),
both_ AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ UNION SELECT node, b FROM reach JOIN both_ ON other = a),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
deg AS (SELECT a AS node, count(*) AS n_links FROM both_ GROUP BY a)
SELECT d.doc_id, coalesce(root.root, rep.rep, d.doc_id) AS class_id, coalesce(deg.n_links, 0) AS n_links
FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN root ON rep.rep = root.node LEFT JOIN deg ON rep.rep = deg.node""",
    "op6_substring_dedup": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_PLAIN} AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
f AS (SELECT doc_id, i, word, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS later FROM p),
c AS (SELECT doc_id, i, word, max(CAST(later AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op8_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + 1
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op9_line_dedup": f"""
WITH d AS MATERIALIZED (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS MATERIALIZED (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}') AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
bad AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN bad ON l.k = bad.k GROUP BY doc_id""",
    "op10_exact_top_k": """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_filter_audit": f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_PLAIN} AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS q, max(CAST(toxic = 1 AS INTEGER)) AS t FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(q, 0) AS q, coalesce(t, 0) AS t, CAST(len(w) < 200 AS INTEGER) AS a, CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER) AS b,
  CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS INTEGER) AS c, CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) AS d,
  CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS INTEGER) AS e FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (SELECT part, q, t, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS m, a + b + c + d + e AS n_fails FROM f),
r AS (SELECT part, q, t, n_fails, o, list_transform(o, lambda y: m[y]) AS z FROM g, o),
s AS (SELECT part, q, t, n_fails, array_to_string(o, '') AS filter_order, z, coalesce(list_position(z, 1), 6) AS first, unnest([1, 2, 3, 4, 5]) AS step FROM r),
k AS (SELECT part, filter_order, step, count(*) FILTER (WHERE first > step) AS kept, count(*) FILTER (WHERE first = step) AS removed,
  count(*) FILTER (WHERE z[step] = 1 AND first < step) AS redundant, count(*) FILTER (WHERE z[step] = 1 AND n_fails = 1) AS unique_fails,
  count(*) FILTER (WHERE first = step AND q = 1) AS good_lost, count(*) FILTER (WHERE first = step AND t = 1) AS toxic_lost FROM s GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM k""",
    # the check sum bit by bit; a run is an island of words equal to those q further, found by phrases of six words
    "op12_periodic_runs": f"""
WITH c AS (SELECT doc_id, {_PLAIN} AS w, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(unicode(d) AS BIGINT))),
    lambda x, y: list_reduce(list_concat([xor(x, y)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u >> 1, 3988292384::BIGINT * (u & 1)))) AS x FROM documents),
e AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, xor(x, 4294967295::BIGINT) AS h FROM c),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
g AS MATERIALIZED (SELECT doc_id, i - 1 AS i, hash(array_to_string(w[i:i + 5], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, n - 4)) AS i FROM d WHERE n > 6)),
eq AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq),
st AS (SELECT doc_id, q, min(i) AS s, max(i) + 6 + q AS e FROM isl GROUP BY doc_id, q, k HAVING max(i) + 6 - min(i) >= greatest(12 - q, q)),
r AS MATERIALIZED (SELECT doc_id, s, e - s AS l, q FROM st WHERE NOT EXISTS (SELECT 1 FROM st t WHERE t.doc_id = st.doc_id AND t.q < st.q AND st.q % t.q = 0 AND t.s <= st.s AND t.e >= st.e)),
t AS (SELECT doc_id, count(*) AS n_runs, arg_max({{'start': s, 'length': l, 'period': q}}, [l, -s, -q]) AS b, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM d),
k AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.i) AS kept FROM pos ANTI JOIN gone ON pos.doc_id = gone.doc_id AND pos.i = gone.i GROUP BY pos.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op13_hyperminhash_near_dedup": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_transform({_PLAIN}, lambda x: translate(x, '{_UP}', '{_LOW}')) AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(3, len(w)) - 1], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
sig AS (SELECT doc_id, count(*) AS n, md5(string_agg(CAST(s AS VARCHAR), ',' ORDER BY s)) AS sig FROM g GROUP BY doc_id),
rep AS MATERIALIZED (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY sig) AS rep FROM sig),
r AS MATERIALIZED (SELECT g.doc_id, g.s FROM g JOIN rep ON g.doc_id = rep.doc_id AND rep.rep = rep.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM r a JOIN r b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN rep x ON a = x.doc_id JOIN rep y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
both_ AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ UNION SELECT node, b FROM reach JOIN both_ ON other = a),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
c AS (SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root.root, rep.rep, d.doc_id) AS component_id FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN root ON rep.rep = root.node)
SELECT *, doc_id = component_id AS kept FROM c""",
}
