"""Search of a query table: vectors, top-k, documents, explanations."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.functions.scores import length_normalized, rank_score, rounded
from textharbor.functions.text import document_keywords, keywords, overlap_ratio, preview, shared_keywords
from textharbor.operators.encode import encode
from textharbor.operators.expand import expand_queries
from textharbor.operators.lookup import salted_lookup
from textharbor.operators.topk import exact_topk
from textharbor.schema import SHOWN_COLUMNS
from textharbor.session import BROADCAST_BYTES, write_and_read

# Bounds of a single request. A batch search takes any number of hits.
MIN_QUERY, MAX_QUERY = 1, 1000
MIN_TOP_K, MAX_TOP_K = 1, 100


def check_top_k(top_k):
    """Refuse a request for more hits than one request may ask for."""
    if not MIN_TOP_K <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be {MIN_TOP_K} to {MAX_TOP_K}")
    return top_k


def validate_queries(queries, text="query"):
    """Every query with ``valid`` and, for rejects, ``reason``."""
    length = F.coalesce(F.length(text), F.lit(0))
    reason = F.when(length < MIN_QUERY, "too short").when(length > MAX_QUERY, "too long")
    return queries.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def _describe(docs, opening=None):
    content = F.col("content")
    return docs.withColumns({"preview": preview(content), "keywords": document_keywords(content, opening)})


def describe_documents(docs, keep=(), opening=None):
    """What search shows of a document: a narrow table derived once from the whole texts.

    Keywords come from the whole text, or from its first ``opening`` characters.
    """
    return _describe(docs, opening).select("doc_id", *SHOWN_COLUMNS, *keep)


def _explanation(length_normalize, max_keywords):
    fields = [
        shared_keywords(F.col("query_keywords"), F.col("keywords"), max_keywords).alias("keywords"),
        rounded(overlap_ratio(F.col("query_keywords"), F.col("keywords"))).alias("overlap_ratio"),
        F.col("doc_length"),
        rounded(F.col("raw_score")).alias("raw_score"),
    ]
    normalized = rounded(F.col("final_score")) if length_normalize else F.lit(None).cast("double")
    return F.struct(*fields, normalized.alias("length_normalized_score"))


def _shown(documents):
    shown = documents if "keywords" in documents.columns else describe_documents(documents)
    return shown.select("doc_id", *SHOWN_COLUMNS)


def _hit_bytes(vectors, query_bytes, n, top_k):
    """Upper bound of the size of all hits; keys of fixed width need no look at the data."""
    key_bytes = 16
    if isinstance(vectors.schema["doc_id"].dataType, T.StringType):
        return None  # measured on the hits themselves: the keys of all vectors are not looked at
    return top_k * (query_bytes + n * (32 + key_bytes))


def _with_documents(hits, documents, hit_bytes, limit):
    """Hits joined to what is shown of their documents; hits without a document disappear.

    Only documents that were hit are described, and their texts are not shuffled.
    """
    written = hit_bytes is None
    if written:
        hits = write_and_read(hits, "hits")
        size = F.octet_length("doc_id") + F.octet_length(F.col("query_id").cast("string")) + F.lit(48)
        hit_bytes = hits.agg(F.sum(size)).first()[0] or 0
    if hit_bytes <= limit:
        hit_docs = documents.join(F.broadcast(hits), "doc_id")
        described = hit_docs if "keywords" in documents.columns else _describe(hit_docs)
        return described.select(*hits.columns, *SHOWN_COLUMNS)
    # Too many hits to broadcast: keep only winning documents, then join with hot documents salted.
    hits = hits if written else write_and_read(hits, "hits")
    winners = documents.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    return salted_lookup(hits, _shown(winners), ["doc_id"], "query_id", limit + 1, how="inner", limit=limit)


def search(
    queries,
    vectors,
    documents,
    encoder=None,
    top_k=5,
    explain=True,
    length_normalize=False,
    rerank=False,
    lexicon=None,
    max_synonyms=2,
    max_keywords=None,
    total_docs=False,
    broadcast_bytes=BROADCAST_BYTES,
    **topk_options,
):
    """The best ``top_k`` documents of every query.

    ``queries``: (query_id, query) and, if no encoder is given, (q ARRAY<FLOAT>, a unit vector).
    ``vectors``: (doc_id, embedding) unit vectors. ``documents``: documents, or the narrow table
    of ``describe_documents``.

    The rank is that of the raw score, also where scores are then normalised by length;
    ``rerank`` orders by the normalised score instead. A lexicon changes the text that is
    encoded; keywords are always those of the query as given. An explanation lists all shared
    keywords, or the first ``max_keywords`` of them.
    """
    texts = queries.select("query_id", "query")
    n, id_bytes, text_bytes = texts.agg(
        F.count(F.lit(1)),
        F.sum(F.octet_length(F.col("query_id").cast("string"))),
        F.sum(F.octet_length("query") + 64),
    ).first()
    if encoder is None:
        encoded = queries.select("query_id", "q")
    else:
        expanded = expand_queries(texts, lexicon, max_synonyms, out="_text")
        if lexicon is not None:
            expanded = write_and_read(expanded.select("query_id", "_text"), "expanded")
        encoded = encode(expanded, "_text", encoder, out="q").select("query_id", "q")
        topk_options.setdefault("dim", encoder.dim)
    hits = exact_topk(encoded, vectors, top_k, max_query_bytes=broadcast_bytes, **topk_options)
    hits = hits.withColumnRenamed("score", "raw_score")

    hit_bytes = _hit_bytes(vectors, id_bytes or 0, n, top_k)
    joined = _with_documents(hits, documents, hit_bytes, broadcast_bytes)

    asked = texts.withColumn("query_keywords", keywords(F.col("query")))
    asked = F.broadcast(asked) if (text_bytes or 0) * 2 <= broadcast_bytes else asked
    joined = joined.join(asked, "query_id")

    score = F.col("raw_score")
    if length_normalize:
        score = length_normalized(score, F.col("doc_length"))
    joined = joined.withColumn("final_score", score)
    if rerank:
        order = Window.partitionBy("query_id").orderBy(rank_score(F.col("final_score")).desc(), "doc_id")
        joined = joined.withColumn("rank", F.row_number().over(order))
    out = [
        F.col("query_id"),
        F.col("query"),
        F.col("rank"),
        F.col("doc_id"),
        rounded(F.col("final_score")).alias("score"),
        F.col("preview"),
        F.col("filename"),
    ]
    if explain:
        out.append(_explanation(length_normalize, max_keywords).alias("explanation"))
    if total_docs:
        out.append(vectors.agg(F.count(F.lit(1))).scalar().alias("total_docs"))
    return joined.select(*out)
