"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

# Words: runs of other characters than space and U+0009 to U+000D.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, list_element([1, 2, 3], CAST(place % 3 + 1 AS INTEGER)) AS w, source_size * 3 AS cap FROM sources),
shared AS (
  SELECT *, sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap / w, place ROWS UNBOUNDED PRECEDING) - cap) AS remains,
         sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM weighed),
opened AS (SELECT *, remains * w <= cap * share AS is_open FROM shared),
level AS (SELECT remains AS r, share AS s FROM opened WHERE is_open ORDER BY cap / w, place LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN is_open THEN CAST(r * w AS DOUBLE) / s ELSE CAST(cap AS DOUBLE) END AS target FROM opened, level),
laid AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS words,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(least(size, words - pos), 0) + greatest(least(size, words - pos - source_size), 0)
            + greatest(least(size, words - pos - 2 * source_size), 0) AS BIGINT) AS taken
FROM laid"""

OP5 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN named USING (doc_id)"""

_TOKENS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = rf"""
WITH docs AS (SELECT doc_id, {_TOKENS.format(_LOWER.format("text"))} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TOKENS.format(_LOWER.format("text"))} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS x
  FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT item, w, least(10, len(w)) AS size FROM items WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS x
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, p.size, i, item FROM places p JOIN windows v ON p.size = v.size AND p.x = v.x),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP8 = rf"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(i, i + 20)) AS pos FROM again)),
marked AS (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY 1),
kept AS (
  SELECT d.doc_id, string_agg(d.x, ' ' ORDER BY d.pos) AS t
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM words) d ANTI JOIN gone g ON d.doc_id = g.doc_id AND d.pos = g.pos
  GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ats), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN marked USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_CRC_TABLE = (
    "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: "
    "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
)

# Groups larger than an even share get a shard of their own; the rest is cut in md5 order at the least feasible capacity.
OP9 = rf"""
WITH RECURSIVE keys AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, md5(coalesce(text, '')) AS key, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(h) // 2 AS BIGINT)),
           lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, list_element(t, CAST(xor(c & 255, b) AS BIGINT) + 1))), 4294967295) AS text_crc32
  FROM keys, (SELECT {_CRC_TABLE} AS t)),
groups AS (SELECT key, CAST(sum(size) AS BIGINT) AS n FROM keys GROUP BY 1),
ranked AS (SELECT key, n, row_number() OVER (ORDER BY n DESC, key) AS k, sum(n) OVER (ORDER BY n DESC, key ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM groups),
large AS (
  SELECT key, k - 1 AS shard FROM ranked r
  WHERE k < 16 AND NOT EXISTS (SELECT 1 FROM ranked q WHERE q.k <= r.k AND q.n * (17 - q.k) <= q.total - (q.upto - q.n))),
m AS (SELECT 16 - count(*) AS shards FROM large),
rest AS (SELECT key, n, row_number() OVER (ORDER BY key) AS i, CAST(sum(n) OVER (ORDER BY key) AS BIGINT) AS p FROM groups ANTI JOIN large USING (key)),
sizes AS (SELECT list({{'load': n, 'shard': CAST(1 AS BIGINT)}} ORDER BY i) AS l, max(n) AS most, CAST(sum(n) AS BIGINT) AS total FROM rest),
search AS (
  SELECT most AS lo, total AS hi FROM sizes
  UNION ALL
  SELECT CASE WHEN fits THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN fits THEN (lo + hi) // 2 ELSE hi END
  FROM (SELECT lo, hi, list_reduce(l, lambda a, b: CASE WHEN a.load + b.load <= (lo + hi) // 2 THEN {{'load': a.load + b.load, 'shard': a.shard}}
               ELSE {{'load': b.load, 'shard': a.shard + 1}} END).shard <= shards AS fits FROM search, sizes, m WHERE lo < hi)),
capacity AS (SELECT lo AS c FROM search WHERE lo = hi LIMIT 1),
starts AS (
  SELECT CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS base
  UNION ALL
  SELECT any_value(shard) + 1, max(p) FROM starts, rest, capacity, sizes WHERE base < total AND p <= base + c GROUP BY shard),
places AS (
  SELECT key, CAST((SELECT max(shard) FROM starts WHERE base <= p - n) + 16 - shards AS INTEGER) AS shard FROM rest, m
  UNION ALL SELECT key, CAST(shard AS INTEGER) FROM large)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM keys JOIN places USING (key) JOIN crc USING (doc_id)"""

OP11 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({_LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY 1),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scores AS (
  SELECT c.lang, c.phrase, c.size, c.w, a, k, p.f AS l, q.f AS r, 1000000::HUGEINT * a * a // (p.f::HUGEINT * q.f) AS score
  FROM cuts c JOIN grams p ON c.lang = p.lang AND p.size = k AND p.phrase = array_to_string(c.w[1:k], ' ')
  JOIN grams q ON c.lang = q.lang AND q.size = c.size - k AND q.phrase = array_to_string(c.w[k + 1:c.size], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a
  FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM candidates WHERE size = 3
        UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM candidates WHERE size = 3) GROUP BY 1, 2),
free AS (SELECT b.* FROM best b LEFT JOIN longer o ON b.lang = o.lang AND b.phrase = o.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

OP12 = rf"""
WITH lines AS (
  SELECT doc_id, pos, line, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
shared AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY 1"""

SQL = {"op2_mixing": OP2, "op5_exact_dedup": OP5, "op6_near_dedup": OP6, "op7_decontamination": OP7, "op8_substring_dedup": OP8, "op9_sharding": OP9,
       "op11_collocations": OP11, "op12_line_dedup": OP12}
