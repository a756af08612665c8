"""DuckDB statements that give the rows of the registered queries, where SQL can express them."""

_SPACE = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{_SPACE}'))::BIGINT AS size,
         md5('0:' || doc_id::VARCHAR) AS random, md5(coalesce(text, '')) AS tiebreak
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::BIGINT AS weight FROM sizes),
rests AS (
  SELECT *,
    sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest_weights
  FROM weighted
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, rest * weight > 3 * source_size * rest_weights AS stops FROM rests),
level AS (SELECT rest AS r, rest_weights AS w FROM marked WHERE NOT stops ORDER BY rest_weights DESC LIMIT 1),
targets AS (
  SELECT source, source_size,
    CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE (r * weight)::DOUBLE / w::DOUBLE END AS target
  FROM marked, level),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY random, tiebreak, doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized),
cut AS (
  SELECT s.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
    CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM summed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(greatest(budget - epochs * source_size - before, 0), size))::BIGINT AS taken
FROM cut
"""

OP8 = """
WITH table_rows AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    list_prepend(n::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
sized AS (
  SELECT doc_id, coalesce(text, '') AS text, (strlen(coalesce(text, '')) + 16)::BIGINT AS size FROM documents),
digested AS (
  SELECT doc_id, size, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'),
      lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM sized, table_rows),
summed AS (
  SELECT *, coalesce(sum(size) OVER before, 0) AS b, sum(size) OVER () AS total,
         row_number() OVER (ORDER BY doc_id, text_crc32, size) AS n
  FROM digested
  WINDOW before AS (ORDER BY doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
placed AS (SELECT *, least(39, ((2 * b + size) * 40) // (2 * total))::INTEGER AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""

OP9 = r"""
WITH parts AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
sized AS (SELECT *, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i + 1 : i + k], ' ') AS g
  FROM (SELECT item, w, k, unnest(range(len(w) - k + 1)) AS i FROM sized)),
lengths AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT n, k, i, array_to_string(w[i + 1 : i + k], ' ') AS g
  FROM (SELECT n, w, k, unnest(range(len(w) - k + 1)) AS i FROM docs, lengths WHERE len(w) >= k)),
hits AS (SELECT n, i, p.k, item FROM places p JOIN windows v ON p.g = v.g AND p.k = v.k),
covered AS (SELECT n, count(DISTINCT pos) AS n_hit FROM (SELECT n, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY n),
found AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT n, item FROM hits) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (n) LEFT JOIN found USING (n)
"""

OP3 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACE}') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS start, doc_id AS node FROM documents
  UNION SELECT start, b FROM reach JOIN links ON a = node),
least_of AS (SELECT start, min(node) AS component_id FROM reach GROUP BY start)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN least_of ON start = doc_id
"""

OP5 = """
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(hex, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - i % 4 * 5)::INTEGER) & 31) + 1)::BIGINT, 1)), '')
    AS payload_digest
  FROM digests),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""

OP6 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_SPACE}')) AS lines
  FROM documents),
places AS (
  SELECT r, i, array_to_string(w[i + 1 : i + 5], ' ') AS g
  FROM (SELECT r, w, unnest(range(len(w) - 4)) AS i FROM docs WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM places) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
metrics AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(body, '[A-Z]')) AS n_upper,
    len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…) *$'))) AS n_cut_lines,
    len(list_filter(lines, lambda l: regexp_matches(l, '^ *[•*–·-]'))) AS n_bullets,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_lettered, len(list_distinct(w)) AS n_distinct
  FROM docs LEFT JOIN covered USING (r)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM metrics)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines OR 2 * n_upper > word_chars
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words
       OR (10 * n_cut_lines > 5 * n_lines AND n_lines >= 4) OR (10 * n_bullets > 9 * n_lines AND n_lines >= 4)
       OR 2 * n_lettered < n_words OR 50 * n_distinct < n_words) AS kept
FROM failed
"""

OP10 = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
starts AS (SELECT r, doc_id, h, unnest(range(n - 49)) AS i FROM docs WHERE n >= 50),
strings AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM starts),
lowest AS (SELECT w, min(doc_id) AS first FROM strings GROUP BY w HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT r, i FROM strings JOIN lowest USING (w) WHERE first < doc_id),
marked AS (SELECT r, i, i > lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) + 50 AS opens FROM hits),
numbered AS (SELECT r, i, count(*) FILTER (opens) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM marked),
spans AS (SELECT r, k, min(i) AS lo, max(i) + 50 AS hi FROM numbered GROUP BY r, k),
gaps AS (SELECT r, k, lo, hi, lead(lo) OVER (PARTITION BY r ORDER BY lo) AS next_lo FROM spans),
kept AS (
  SELECT r, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, min(lo) AS head,
         string_agg(substr(h, 2 * hi + 1, 2 * (coalesce(next_lo, n) - hi)), '' ORDER BY lo) AS rest
  FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN head IS NULL THEN h ELSE substr(h, 1, 2 * head) || rest END)) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

#: Main text as the given pages are laid out: one article element, of a heading and paragraphs.
OP11 = r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda b:
    regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g')) AS raw
  FROM articles),
decoded AS (
  SELECT page_id, url, list_transform(raw, lambda b: trim(regexp_replace(
    regexp_replace(regexp_replace(replace(replace(b, '&copy;', '©'), '&middot;', '·'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
    '[\s\x1c-\x1f\x85\p{Z}]+', ' ', 'g'))) AS texts
  FROM blocks),
joined AS (
  SELECT page_id, url, array_to_string(list_filter(texts, lambda t: t <> ''), chr(10) || chr(10)) AS text FROM decoded)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM joined
"""

OP12 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w
  FROM documents),
whole AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs),
sized AS (SELECT r, doc_id, w, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM docs, whole WHERE len(w) > 0),
postings AS (SELECT r, doc_id, m, term, count(*) AS tf FROM (SELECT r, doc_id, m, unnest(w) AS term FROM sized) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM postings, whole GROUP BY term, n_docs),
items AS (SELECT row_number() OVER () AS i, item_id, {_LOWER.format("coalesce(text, '')")} AS body FROM benchmark),
wanted AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(body, '{_WORD}')) AS term FROM items),
scored AS (
  SELECT i, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term) GROUP BY i, item_id, r, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

OP13 = f"""
WITH RECURSIVE table_rows AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    list_prepend(n::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
keyed AS (
  SELECT *, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'),
      lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295)::BIGINT AS key_crc
  FROM documents, table_rows),
leaves AS (
  SELECT doc_id, lang, {_LEAF.format("text")} AS leaf,
    CASE WHEN key_crc % 3 = 0 THEN {_LEAF.format(_LOWER.format("text"))} END AS changed
  FROM keyed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, changed NULLS FIRST) - 1 AS k,
         count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, k, n, leaf AS digest FROM ranked
  UNION ALL
  SELECT lang, level + 1, k // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY k))
  FROM nodes WHERE n > 1 GROUP BY lang, level, n, k // 8),
subroots AS (
  SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p,
         count(*) OVER () AS parts
  FROM nodes WHERE n = 1),
top_nodes AS (
  SELECT 0 AS level, p AS k, parts AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, k // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY k))
  FROM top_nodes WHERE n > 1 GROUP BY level, n, k // 8),
steps AS (
  SELECT r.lang, r.k AS leaf_k, l.level,
    coalesce(string_agg(s.digest, '' ORDER BY s.k) FILTER (s.k < l.k), '') AS before,
    coalesce(string_agg(s.digest, '' ORDER BY s.k) FILTER (s.k > l.k), '') AS after
  FROM ranked r
  JOIN nodes l ON l.lang IS NOT DISTINCT FROM r.lang AND l.n > 1 AND l.k = r.k // (8 ** l.level)::BIGINT
  JOIN nodes s ON s.lang IS NOT DISTINCT FROM r.lang AND s.level = l.level AND s.k // 8 = l.k // 8
  GROUP BY ALL),
top_steps AS (
  SELECT r.lang, l.level,
    coalesce(string_agg(s.digest, '' ORDER BY s.k) FILTER (s.k < l.k), '') AS before,
    coalesce(string_agg(s.digest, '' ORDER BY s.k) FILTER (s.k > l.k), '') AS after
  FROM subroots r
  JOIN top_nodes l ON l.n > 1 AND l.k = r.p // (8 ** l.level)::BIGINT
  JOIN top_nodes s ON s.level = l.level AND s.k // 8 = l.k // 8
  GROUP BY ALL),
lists AS (
  SELECT lang, leaf_k, list({{'a': before, 'h': '', 'b': after}} ORDER BY level) AS way FROM steps GROUP BY ALL),
top_lists AS (
  SELECT lang, list({{'a': before, 'h': '', 'b': after}} ORDER BY level) AS top_way FROM top_steps GROUP BY ALL),
joined AS (
  SELECT r.doc_id, r.leaf, r.changed, s.subroot, (SELECT digest FROM top_nodes WHERE n = 1) AS root,
         list_concat(coalesce(way, []), coalesce(top_way, [])) AS way
  FROM ranked r JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang
  LEFT JOIN lists l ON l.lang IS NOT DISTINCT FROM r.lang AND l.leaf_k = r.k
  LEFT JOIN top_lists t ON t.lang IS NOT DISTINCT FROM r.lang),
folds AS (
  SELECT *, sha256(array_to_string(list_transform(way, lambda w: w.a || w.b), '')) AS proof_sha256,
    (list_reduce(list_prepend({{'a': '', 'h': coalesce(changed, leaf), 'b': ''}}, way),
      lambda x, w: {{'a': '', 'h': sha256(w.a || x.h || w.b), 'b': ''}})).h AS folded_root
  FROM joined)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""

ORACLE_SQL = {
    "op1_decontamination": OP1,
    "op3_near_duplicates": OP3,
    "op4_source_mixing": OP4,
    "op5_warc_normaliser": OP5,
    "op6_quality_cascade": OP6,
    "op8_byte_shards": OP8,
    "op9_url_filter": OP9,
    "op10_substring_dedup": OP10,
    "op11_html_extract": OP11,
    "op12_ranked_search": OP12,
    "op13_merkle_manifest": OP13,
}
