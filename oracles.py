"""DuckDB statements that give the same rows as the registered queries."""

_WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
_NOT_WS = r"[^\t-\r\x1c-\x20\x85\p{Z}]"


def _tags(x):
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def _entities(x):
    """The entities that occur in the given pages, some cut off before the semicolon; the ampersand comes last."""
    for name, char in (("&middot", "·"), ("&copy", "©"), ("&quot", '"'), ("&amp", "&")):
        x = f"regexp_replace({x}, '{name};?', '{char}', 'g')"
    return x


def _urls(x):
    return f"regexp_replace({x}, 'https?://{_NOT_WS}+|www\\.{_NOT_WS}+', ' ', 'g')"


def _spaces(x):
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'), ' ')"


def _clean(x):
    return _spaces(_urls(_entities(_tags(f"lower({x})"))))


def _words(x):
    return f"list_filter(regexp_split_to_array(lower({x}), '{_WS}+'), lambda w: w <> '')"


def _keywords(x, shortest=3):
    keep = f"length(w) >= {shortest} AND regexp_matches(w, '^\\p{{L}}+$')"
    return f"list_distinct(list_filter({_words(x)}, lambda w: {keep}))"


def _joined(xs):
    return f"array_to_string(list_sort({xs}), ' ')"


def _overlap(a, b):
    shared = f"len(list_intersect({a}, {b}))"
    total = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {shared}::DOUBLE / {total} END"


def _preview(x):
    head = f"regexp_replace(substr({x}, 1, 197), ' [^ ]*$', '')"
    return f"CASE WHEN length({x}) <= 200 THEN {x} ELSE {head} || '...' END"


_DOCS = f"""docs AS (
    SELECT doc_id, content, sha256(content) AS content_hash, sha256(text) AS raw_hash, length(content) AS doc_length,
           source AS filename, lang
    FROM (SELECT *, {_clean('text')} AS content FROM documents) WHERE content <> '')"""


def _weights(name, source, key, text, dim=384):
    """Signed feature hashing as rows (key, bucket, weight)."""
    return f"""{name} AS (
    SELECT {key}, bucket, (total / sqrt(sum(total * total) OVER (PARTITION BY {key})))::FLOAT AS weight
    FROM (SELECT {key}, ('0x' || substr(md5(word), 1, 8))::BIGINT % {dim} AS bucket,
                 sum(1 - 2 * (('0x' || substr(md5(word), 9, 1))::BIGINT % 2))::DOUBLE AS total
          FROM (SELECT {key}, unnest({_words(text)}) AS word FROM {source}) GROUP BY ALL)
    WHERE total <> 0)"""


_LEXICON = f"""vocabulary AS (
    SELECT DISTINCT word, substr(word, 1, 4) AS stem FROM (SELECT unnest({_keywords('text', 4)}) AS word FROM benchmark)),
lemmas AS (
    SELECT stem, 1 AS synset_rank, row_number() OVER (PARTITION BY stem ORDER BY word) AS lemma_rank, word AS lemma
    FROM vocabulary
    UNION ALL
    SELECT stem, 2, row_number() OVER (PARTITION BY stem ORDER BY word DESC), stem || ' ' || word FROM vocabulary),
synonyms AS (
    SELECT word, list(lemma ORDER BY synset_rank, lemma_rank) AS names
    FROM vocabulary JOIN lemmas USING (stem) WHERE lemma_rank <= 3 GROUP BY word)"""

_EXPANDED = f"""{_LEXICON},
asked AS (SELECT item_id AS query_id, text AS query, {_words('text')} AS words FROM benchmark),
fold AS (
    SELECT query_id, words, 0 AS i, words AS acc FROM asked
    UNION ALL
    SELECT query_id, words, i + 1,
           list_concat(acc, list_distinct_ordered(acc, names, words[i + 1]))
    FROM fold LEFT JOIN synonyms ON synonyms.word = fold.words[i + 1] AND length(fold.words[i + 1]) >= 4
    WHERE i < len(words)),
expanded AS (SELECT query_id, array_to_string(acc, ' ') AS query FROM fold WHERE i = len(words))"""

# New names in lexicon order, each once, two at most.
_FRESH = (
    "coalesce(list_filter(names, lambda n, p: n <> words[i + 1] AND NOT list_contains(acc, n)"
    " AND list_position(names, n) = p)[1:2], [])"
)
_EXPANDED = _EXPANDED.replace("list_distinct_ordered(acc, names, words[i + 1])", _FRESH)


def _search(query_source, k=5):
    """Explained hits of every benchmark text; the text that is encoded comes from ``query_source``."""
    return f"""{_DOCS},
{_weights('dw', 'docs', 'doc_id', 'content')},
{_weights('qw', query_source, 'query_id', 'query')},
dots AS (
    SELECT query_id, doc_id, sum(qw.weight::DOUBLE * dw.weight::DOUBLE) AS raw
    FROM qw JOIN dw USING (bucket) GROUP BY ALL),
pairs AS (
    SELECT item_id AS query_id, text AS query, docs.*, coalesce(raw, 0.0) AS raw
    FROM benchmark CROSS JOIN docs LEFT JOIN dots ON dots.query_id = item_id AND dots.doc_id = docs.doc_id),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(raw * 1e7 + 0.5) DESC, doc_id) AS rank FROM pairs),
hits AS (
    SELECT *, {_keywords('query')} AS qk, {_keywords('content')} AS dk,
           raw * (1.0 / (1.0 + ln(1 + doc_length / 1000.0::DOUBLE))) AS norm
    FROM ranked WHERE rank <= {k})"""


_ASKED = "plain AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


_SPARSE = f"""WITH {_ASKED}, {_DOCS},
{_weights('dw', 'docs', 'doc_id', 'content', 1 << 18)},
{_weights('qw', 'plain', 'query_id', 'query', 1 << 18)},
dots AS (
    SELECT query_id, doc_id, sum(qw.weight::DOUBLE * dw.weight::DOUBLE) AS raw
    FROM qw JOIN dw USING (bucket) GROUP BY ALL),
ranked AS (
    SELECT plain.query_id, docs.doc_id, coalesce(raw, 0.0) AS raw, row_number() OVER (PARTITION BY plain.query_id
               ORDER BY floor(coalesce(raw, 0.0) * 1e7 + 0.5) DESC, docs.doc_id) AS rank
    FROM plain CROSS JOIN docs LEFT JOIN dots ON dots.query_id = plain.query_id AND dots.doc_id = docs.doc_id)
SELECT query_id, rank, doc_id, round(raw, 4) AS score FROM ranked WHERE rank <= 5"""


def _explained(score, rank="rank"):
    return f"""SELECT query_id, {rank} AS rank, doc_id, round({score}, 4) AS score,
       array_to_string(list_sort(list_intersect(qk, dk)), ' ') AS keywords,
       round({_overlap('qk', 'dk')}, 4) AS overlap_ratio, doc_length, round(raw, 4) AS raw_score"""


_UNIT = """unit AS (
    SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE / n)::FLOAT)::DOUBLE[] AS e
    FROM (SELECT vec_id, embedding,
                 sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings))"""


def _topk(k):
    return f"""{_UNIT},
ranked AS (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id
               ORDER BY floor(score * 1e7 + 0.5) DESC, vec_id) AS rank
    FROM (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) AS score FROM unit a CROSS JOIN unit b)),
best AS (SELECT query_id, rank, vec_id, round(score, 4) AS score FROM ranked WHERE rank <= {k})"""


_TOPK_SQL = f"WITH {_topk(5)} SELECT query_id, rank, vec_id, score FROM best"

_COSINE = f"""WITH {_UNIT}
SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) AS score
FROM unit a CROSS JOIN unit b WHERE a.vec_id % 100 = 0"""

# The store of an earlier run, the rows of a later one, and sizes of vectors.
_STORE = f"""{_DOCS},
{_weights('dw', 'docs', 'doc_id', 'content')},
sizes AS (
    SELECT doc_id, count(dw.bucket) AS nonzero,
           coalesce(sum((bucket + 1) * round(round(weight::DOUBLE, 4) * 10000)::BIGINT), 0)::BIGINT AS vector_sum
    FROM docs LEFT JOIN dw USING (doc_id) GROUP BY doc_id),
prior AS (
    SELECT doc_id, CASE WHEN quality = 1 THEN content_hash ELSE raw_hash END AS content_hash, content_hash AS fresh_hash,
           '2024-01-01' AS updated, nonzero, vector_sum, filename, 1 AS facts, lang, toxic
    FROM docs JOIN labels USING (doc_id) JOIN sizes USING (doc_id)),
upserted AS (
    SELECT doc_id, content_hash, '2024-02-01' AS updated, nonzero, vector_sum, '' AS filename, -1 AS facts
    FROM docs JOIN sizes USING (doc_id) WHERE lang = 'en'
    UNION ALL
    SELECT doc_id, content_hash, updated, nonzero, vector_sum, filename, facts FROM prior WHERE lang <> 'en'),
flagged AS (
    SELECT docs.*, prior.doc_id IS NOT NULL AS hit
    FROM docs LEFT JOIN prior ON prior.doc_id = docs.doc_id AND prior.content_hash = docs.content_hash)"""


_STORED = "doc_id, content_hash, updated, nonzero, vector_sum, filename, facts::BIGINT AS facts"


def _stored(source, where="true"):
    return f"WITH {_STORE} SELECT {_STORED} FROM {source} WHERE {where}"


_CURRENT = f"""WITH {_STORE}
SELECT doc_id, content_hash, CASE WHEN hit THEN '2024-01-01' ELSE '2024-02-01' END AS updated, nonzero, vector_sum,
       filename, CASE WHEN hit THEN 1 ELSE 2 END::BIGINT AS facts
FROM flagged JOIN sizes USING (doc_id)"""

_NOT_TOXIC = "doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"

_INTEGRITY = f"""WITH {_STORE}
        SELECT count(*) FILTER (docs.lang <> 'de') AS documents,
               coalesce(sum(1 + prior.toxic) FILTER (prior.doc_id IS NOT NULL), 0)::BIGINT AS vectors,
               count(*) FILTER (docs.lang <> 'de' AND prior.doc_id IS NULL) AS documents_without_vector,
               count(*) FILTER (docs.lang = 'de' AND prior.doc_id IS NOT NULL) AS vectors_without_document,
               count(*) FILTER (prior.toxic = 1) AS repeated_keys
        FROM docs LEFT JOIN prior USING (doc_id)"""

ORACLE_SQL = {
    "strip_html": f"SELECT page_id, {_entities(_tags('html'))} AS text FROM pages",
    "strip_html_native": f"SELECT page_id, {_entities(_tags('html'))} AS text FROM pages",
    "strip_urls": f"SELECT page_id, {_urls('concat_ws(chr(32), url, html, url)')} AS text FROM pages",
    "normalize_whitespace": f"SELECT doc_id, {_spaces('text')} AS text FROM documents",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS content FROM documents",
    "clean_pages": f"SELECT page_id, {_clean('html')} AS content FROM pages",
    "doc_schema": f"WITH {_DOCS} SELECT doc_id, filename, doc_length, content_hash FROM docs",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "drop_empty": f"""SELECT doc_id, line, content FROM (
        SELECT doc_id, line, {_clean('text')} AS content FROM (
            SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS text
            FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))) WHERE content <> ''""",
    "keywords_extract": f"""WITH {_DOCS}
        SELECT doc_id, len(k) AS n, {_joined('k')} AS keywords
        FROM (SELECT doc_id, {_keywords('content')} AS k FROM docs)""",
    "keyword_overlap": f"""WITH k AS (SELECT conv_id, turn, role, {_keywords('text')} AS k FROM conversations)
        SELECT a.conv_id, a.turn, {_joined('list_intersect(a.k, b.k)')} AS shared,
               round({_overlap('a.k', 'b.k')}, 4) AS overlap
        FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 WHERE a.role = 'user'""",
    "preview_truncate": f"WITH {_DOCS} SELECT doc_id, {_preview('content')} AS preview FROM docs",
    "list_documents": f"""WITH {_DOCS}
        SELECT doc_id, filename, doc_length AS length,
               CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS preview,
               (SELECT count(*) FROM docs) AS total FROM docs""",
    "src_text_corpus": f"""WITH {_DOCS}
        SELECT content_hash, doc_length, count(*) AS files, count(*) AS stems, true AS named FROM docs GROUP BY ALL""",
    "l2_normalize": """WITH sq AS (
            SELECT vec_id, list_transform(embedding, lambda x: (x * x)::FLOAT) AS v FROM embeddings),
        unit AS (
            SELECT vec_id, list_transform(v, lambda x: (x::DOUBLE / n)::FLOAT) AS v FROM (
                SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM sq))
        SELECT vec_id, i, round(x::DOUBLE, 4) AS x
        FROM (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM unit)""",
    "cosine_scores": f"SELECT query_id, vec_id, round(score, 4) AS score FROM ({_COSINE})",
    "normalize_score": f"""SELECT query_id, vec_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (score + 0.25) / 0.5::DOUBLE)), 4)
        AS score FROM ({_COSINE})""",
    "embed_documents": f"""WITH {_DOCS}, {_weights('dw', 'docs', 'doc_id', 'content')}
        SELECT doc_id, bucket, round(weight::DOUBLE, 4) AS weight FROM dw""",
    "embed_queries": f"""WITH asked AS (
            SELECT 'b' || item_id AS query_id, text AS query FROM benchmark
            UNION ALL
            SELECT conv_id || '-' || turn, text FROM conversations WHERE role = 'user'),
        {_weights('qw', 'asked', 'query_id', 'query')}
        SELECT query_id, bucket, round(weight::DOUBLE, 4) AS weight FROM qw""",
    "topk_batch": _TOPK_SQL,
    "topk_grid": _TOPK_SQL,
    "topk_pruned": _TOPK_SQL,
    "topk_sparse": _SPARSE,
    "score_distribution": f"""WITH {_topk(10)}
        SELECT query_id, rank, substr(vec_id::VARCHAR, 1, 25) AS label,
               printf('%.1f%%', score * 100) AS share, printf('%.4f', score) AS score FROM best""",
    "score_histogram": f"""WITH scored AS ({_COSINE}),
        placed AS (
            SELECT query_id, floor(score * 1e7 + 0.5) AS r, count(*) OVER (PARTITION BY query_id) AS total,
                   row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e7 + 0.5)) AS place,
                   least(greatest(floor((score + 1) / 0.125::DOUBLE), 0), 15) AS bin FROM scored),
        shares AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS share)
        SELECT query_id, 'bin' AS kind, bin::DOUBLE AS at, count(*)::DOUBLE AS value FROM placed GROUP BY ALL
        UNION ALL
        SELECT query_id, 'quantile', share, round(r / 1e7, 6) FROM placed, shares
        WHERE place = greatest(ceil(share * total), 1)""",
    "keyword_matches": f"""WITH {_DOCS},
        d AS (SELECT doc_id, {_keywords('content')} AS a FROM docs),
        b AS (SELECT item_id AS query_id, {_keywords('text')} AS b FROM benchmark)
        SELECT doc_id, query_id, len(list_intersect(a, b))::BIGINT AS shared, round({_overlap('a', 'b')}, 4) AS overlap
        FROM d CROSS JOIN b WHERE {_overlap('a', 'b')} >= 0.1::DOUBLE""",
    "validate_queries": """SELECT conv_id || '-' || turn AS query_id, length(text) BETWEEN 1 AND 1000 AS valid,
        CASE WHEN length(text) < 1 THEN 'too short' WHEN length(text) > 1000 THEN 'too long' ELSE '' END AS reason
        FROM conversations""",
    "expand_queries": f"WITH RECURSIVE {_EXPANDED} SELECT query_id, query AS expanded FROM expanded",
    "search_basic": f"""WITH {_ASKED}, {_search('plain')}
        SELECT query_id, rank, doc_id, round(raw, 4) AS score, {_preview('content')} AS preview,
               (SELECT count(*) FROM docs) AS total_docs FROM hits""",
    "search_explained": f"WITH {_ASKED}, {_search('plain')} {_explained('raw')} FROM hits",
    "search_length_normalized": f"""WITH {_ASKED}, {_search('plain')}
        {_explained('norm')}, round(norm, 4) AS length_normalized_score FROM hits""",
    "search_reranked": f"""WITH {_ASKED}, {_search('plain')}
        {_explained('norm', 'row_number() OVER (PARTITION BY query_id ORDER BY floor(norm * 1e7 + 0.5) DESC, doc_id)')},
        round(norm, 4) AS length_normalized_score FROM hits""",
    "search_expanded": f"WITH RECURSIVE {_EXPANDED}, {_search('expanded')} {_explained('raw')} FROM hits",
    "sql_search": f"""WITH {_ASKED}, {_search('plain')}
        SELECT query_id, rank, doc_id, round(raw, 4) AS score, {_preview('content')} AS preview,
               array_to_string(list_sort(list_intersect(qk, dk)), ' ') AS keywords, round({_overlap('qk', 'dk')}, 4) AS overlap_ratio
        FROM hits""",
    "search_to_json": f"""WITH {_ASKED}, {_search('plain')}
        SELECT query_id, rank, doc_id, round(raw, 4) AS score, {_preview('content')} AS preview, filename,
               len(list_intersect(qk, dk)) AS n_keywords, round({_overlap('qk', 'dk')}, 4) AS overlap_ratio, doc_length,
               round(raw, 4) AS raw_score FROM hits""",
    "vector_rejects": "SELECT vec_id, label % 5 = 4 AS usable FROM embeddings",
    "rendered_numbers": """SELECT doc_id, printf('%.1f%%', length(text) / 16 * 100) AS share,
        printf('%.4f', length(text) / 16) AS digits FROM documents""",
    "search_counts": "SELECT item_id AS query_id, least(5, (SELECT count(*) FROM documents)) AS found FROM benchmark",
    "store_scan": _stored("prior"),
    "store_get": _stored("prior", "toxic = 1"),
    "store_get_pruned": _stored("prior", "toxic = 1"),
    "store_by_hash": f"""WITH {_STORE}
        SELECT doc_id, content_hash, updated, nonzero, vector_sum, filename, facts::BIGINT AS facts FROM (
            SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS n FROM prior
            WHERE content_hash IN (SELECT content_hash FROM docs)) WHERE n = 1""",
    "cache_by_hash": f"""WITH {_STORE}
        SELECT docs.doc_id, min(prior.doc_id) AS cached_id
        FROM docs JOIN prior ON docs.content_hash = prior.content_hash GROUP BY docs.doc_id""",
    "cache_hits": f"WITH {_STORE} SELECT doc_id, content_hash FROM flagged WHERE hit",
    "cache_misses": f"WITH {_STORE} SELECT doc_id, content_hash FROM flagged WHERE NOT hit",
    "cache_hits_bucketed": f"WITH {_STORE} SELECT doc_id, content_hash FROM flagged WHERE hit",
    "cache_misses_bucketed": f"WITH {_STORE} SELECT doc_id, content_hash FROM flagged WHERE NOT hit",
    "cache_hit_ratio": f"""WITH {_STORE}
        SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) AS documents FROM flagged""",
    "store_upsert": _stored("upserted"),
    "store_delete": _stored("upserted", _NOT_TOXIC),
    "store_compact": _stored("upserted", _NOT_TOXIC),
    "store_vacuum": _stored("prior", "lang = 'en'"),
    "store_clear": f"WITH {_STORE} SELECT count(*) AS removed, 0::BIGINT AS remaining FROM prior",
    "store_stats": f"""WITH {_STORE}
        SELECT count(*) AS total_entries, max(updated) AS latest_update, true AS on_disk FROM upserted""",
    "incremental_embed": _CURRENT,
    "incremental_embed_force": f"""WITH {_STORE}
        SELECT doc_id, content_hash, '2024-02-01' AS updated, nonzero, vector_sum, filename, 2::BIGINT AS facts
        FROM docs JOIN sizes USING (doc_id)""",
    "incremental_embed_content": _CURRENT,
    "index_append": f"""WITH {_UNIT}
        SELECT vec_id, 2::BIGINT AS copies,
               round(2 * sqrt(list_sum(list_transform(e, lambda x: x * x))), 4) AS norms FROM unit""",
    "index_integrity": _INTEGRITY,
    "index_integrity_ranges": _INTEGRITY,
    "index_differences": f"""WITH {_STORE}
        SELECT doc_id, CASE WHEN docs.lang <> 'de' THEN 1 ELSE 0 END::BIGINT AS documents,
               CASE WHEN prior.doc_id IS NULL THEN 0 ELSE 1 + prior.toxic END::BIGINT AS vectors
        FROM docs LEFT JOIN prior USING (doc_id)
        WHERE CASE WHEN docs.lang <> 'de' THEN 1 ELSE 0 END <> CASE WHEN prior.doc_id IS NULL THEN 0 ELSE 1 + prior.toxic END""",
    "index_roundtrip": f"WITH {_STORE} SELECT doc_id, doc_length, nonzero, vector_sum FROM docs JOIN sizes USING (doc_id)",
    "index_statistics": f"WITH {_DOCS} SELECT 1::BIGINT AS version, count(*) AS vectors, true AS on_disk FROM docs",
    "clear_index_and_store": f"""WITH {_STORE}
        SELECT (SELECT count(*) FROM docs) AS index_removed, count(*) AS store_removed, 0::BIGINT AS remaining FROM prior""",
    "index_job": f"""WITH {_STORE}
        SELECT count(*) AS indexed_documents, count(*) FILTER (hit) AS cache_hits,
               count(*) FILTER (NOT hit) AS cache_misses, count(*) AS cached_embeddings FROM flagged""",
    "index_job_partial": f"""WITH {_STORE}
        SELECT doc_id, content_hash, filename, doc_length, nonzero, vector_sum FROM docs JOIN sizes USING (doc_id)""",
    "engine_stats": f"""WITH {_STORE}
        SELECT (SELECT count(*) FROM embeddings) AS indexed_documents, (SELECT count(*) FROM prior) AS cached_embeddings,
               'exact' AS index_type, (SELECT count(*) > 0 FROM embeddings) AS index_loaded""",
    "stream_index": _CURRENT,
    "stream_upsert": f"""WITH {_STORE}
        SELECT doc_id, content_hash, '2024-02-01' AS updated, nonzero, vector_sum, filename, 2::BIGINT AS facts
        FROM docs JOIN sizes USING (doc_id) WHERE {_NOT_TOXIC}""",
}
