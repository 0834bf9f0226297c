"""SQL for the queries that SQL can express; plain definitions over the raw tables, no shared steps with the operators."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The limits of each (lang, source) are quantiles of values rounded up to an eighth of a doubling.
OP3 = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT doc_id, i, word, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
rep AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM tri WHERE w3 IS NOT NULL) WHERE n >= 2) GROUP BY doc_id),
ln AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS MATERIALIZED (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
r AS (
  SELECT *, CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbol_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio,
    CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_ratio,
    CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS word_length FROM m),
v AS (
  SELECT lang, source, metric, CASE WHEN value > 0 THEN pow(2.0, ceil(round(log2(value) * 8, 9)) / 8) ELSE 0 END AS value
  FROM (SELECT lang, source, unnest(['symbol_ratio', 'dup_line_ratio', 'repeat_ratio', 'word_length']) AS metric,
    unnest([symbol_ratio, dup_line_ratio, repeat_ratio, word_length]) AS value FROM r)),
q AS (
  SELECT GROUPING(lang) AS gl, GROUPING(source) AS gs, lang, source, metric, count(*) AS n, list_sort(list(value)) AS vs
  FROM v GROUP BY GROUPING SETS ((lang, source, metric), (lang, metric), (metric))),
lim AS (
  SELECT gl, gs, lang, source, metric, n, vs[ceil(n * 0.05::DOUBLE)::INT] AS low, vs[ceil(n * 0.9::DOUBLE)::INT] AS high FROM q),
pick AS (
  SELECT o.lang, o.source, o.metric,
    CASE WHEN o.n >= 200 THEN o.low WHEN l.n >= 200 THEN l.low ELSE g.low END AS low, CASE WHEN o.n >= 200 THEN o.high WHEN l.n >= 200 THEN l.high ELSE g.high END AS high
  FROM (SELECT * FROM lim WHERE gl = 0 AND gs = 0) o
  JOIN (SELECT * FROM lim WHERE gl = 0 AND gs = 1) l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric
  JOIN (SELECT * FROM lim WHERE gl = 1 AND gs = 1) g ON o.metric = g.metric),
t AS (
  SELECT lang, source, max(CASE WHEN metric = 'symbol_ratio' THEN high END) AS s, max(CASE WHEN metric = 'dup_line_ratio' THEN high END) AS d,
    max(CASE WHEN metric = 'repeat_ratio' THEN high END) AS p, max(CASE WHEN metric = 'word_length' THEN low END) AS lo, max(CASE WHEN metric = 'word_length' THEN high END) AS hi
  FROM pick GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_length BETWEEN lo / 2 AND hi * 2 AND symbol_ratio <= greatest(s * 2, 0.02)
    AND dup_line_ratio <= greatest(d * 2, 0.02) AND repeat_ratio <= greatest(p * 2, 0.02) AS kept
FROM r JOIN t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source"""

_CONTROL = r"\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>"
_ESCAPE = rf"'([<\[])(\\*)({_CONTROL})', '\1\\\2\3', 'g'"

OP5 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
    regexp_replace(text, {_ESCAPE}) AS body, regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), {_ESCAPE}) AS tag FROM c),
k AS (SELECT *, 4 + ceil((strlen(tag) + strlen(body)) / 4.0)::BIGINT AS tokens, length(tag) + length(body) + 17 AS chars, place = 0 AND role = 'system' AS sys FROM e),
s AS (SELECT *, coalesce(max(CASE WHEN sys THEN tokens END) OVER (PARTITION BY conv_id), 0) AS st, max(CASE WHEN sys THEN chars END) OVER (PARTITION BY conv_id) AS sc FROM k),
b AS MATERIALIZED (
  SELECT *, greatest(1024 - 256 - st, 1) AS room, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) - tokens AS before FROM s WHERE NOT sys),
spans AS (
  SELECT conv_id, before // room AS a, (before + tokens - 1) // room AS z, min(before) AS start, sum(chars) AS chars, any_value(sc) AS sc FROM b GROUP BY ALL),
past AS (SELECT s.conv_id, sum(b.chars) AS chars FROM spans s JOIN b ON s.conv_id = b.conv_id AND b.before + b.tokens <= s.start AND b.before >= s.start - 256 GROUP BY s.conv_id),
whole AS (SELECT conv_id, sum(chars) + sum(coalesce(sc, 0)) AS chars FROM spans GROUP BY conv_id),
alone AS (SELECT conv_id, chars FROM s WHERE sys AND conv_id NOT IN (SELECT conv_id FROM b))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (coalesce(any_value(whole.chars), 0) + coalesce(any_value(past.chars), 0) + coalesce(any_value(alone.chars), 0))::BIGINT AS formatted_chars
FROM e LEFT JOIN whole USING (conv_id) LEFT JOIN past USING (conv_id) LEFT JOIN alone USING (conv_id) GROUP BY conv_id"""

OP6 = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(r.low, w.doc_id)) AS component_id, w.doc_id <= coalesce(r.low, w.doc_id) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON w.doc_id = r.a"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS w
  FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM i WHERE len(ws) > 0)),
dw AS (
  SELECT r, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d JOIN (SELECT DISTINCT n FROM iw) ON len(ws) >= n)),
h AS MATERIALIZED (SELECT r, item_id, p, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.w = iw.w),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS k FROM h) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

OP13 = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS MATERIALIZED (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(ws) < 200 AS A, 100 * len(list_distinct(ws)) < 50 * len(ws) AS B,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D, coalesce(first < w.doc_id, false) AS E
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS MATERIALIZED (
  SELECT part, concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END, CASE WHEN D THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
o (f) AS (SELECT '' UNION ALL SELECT f || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v (x) WHERE NOT contains(f, x)),
s AS (SELECT f AS filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(f) = 5),
p AS (
  SELECT part, filter_order, step, filter_order[step] AS x, translate(fails, filter_order[1:step - 1], '') <> fails AS gone, contains(fails, filter_order[step]) AS hit, fails, n, good, toxic
  FROM s, c),
k AS (
  SELECT part, filter_order, step, any_value(x) AS x, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost FROM p GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM k"""
