"""Exact text similarity search and incremental embedding tables on Spark.

Everything takes and returns DataFrames; see README.md for a tour.
"""

import sys

from pyspark import cloudpickle

# Python tasks get this package's helpers by value, so executors need nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from textharbor.functions import cleaning, scores, text, vectors  # noqa: E402
from textharbor.operators.distribution import score_histogram, score_quantiles  # noqa: E402
from textharbor.operators.encode import HashingEncoder, encode, nonzero_weights  # noqa: E402
from textharbor.operators.expand import expand_queries  # noqa: E402
from textharbor.operators.lookup import label_hits, lookup_by_hash  # noqa: E402
from textharbor.operators.matches import keyword_matches  # noqa: E402
from textharbor.operators.pruned import cluster_vectors, pruned_topk  # noqa: E402
from textharbor.operators.search import describe_documents, search, validate_queries  # noqa: E402
from textharbor.operators.sparse import (  # noqa: E402
    SparseHashingEncoder,
    build_sparse_index,
    encode_sparse,
    sparse_topk,
)
from textharbor.operators.topk import exact_topk, score_pairs  # noqa: E402
from textharbor.plans.indexing import incremental_embed, index_job  # noqa: E402
from textharbor.plans.partial import changed_parts, read_partial_index, update_partial_index  # noqa: E402
from textharbor.plans.ranges import check_by_ranges  # noqa: E402
from textharbor.plans.reports import engine_stats, index_integrity, list_documents  # noqa: E402
from textharbor.session import get_session, run_dir  # noqa: E402
from textharbor.sources.bucketed import bucket_keys  # noqa: E402
from textharbor.sources.corpus import (  # noqa: E402
    as_documents,
    iterate_documents,
    read_text_corpus,
    text_corpus_stream,
    write_text_files,
)
from textharbor.sources.index import (  # noqa: E402
    append_vectors,
    build_vectors,
    clear_index,
    index_stats,
    load_index,
    publish_index,
)
from textharbor.sources.keyed import lookup as keyed_lookup  # noqa: E402
from textharbor.sources.keyed import write_keyed  # noqa: E402
from textharbor.sources.results import search_records  # noqa: E402
from textharbor.sources.store import EmbeddingStore  # noqa: E402
from textharbor.sql import register_sql  # noqa: E402
from textharbor.streaming.indexer import stream_index  # noqa: E402
from textharbor.streaming.upserts import stream_upsert, upsert_events  # noqa: E402

__all__ = [
    "EmbeddingStore",
    "HashingEncoder",
    "SparseHashingEncoder",
    "append_vectors",
    "as_documents",
    "bucket_keys",
    "build_sparse_index",
    "build_vectors",
    "cleaning",
    "changed_parts",
    "check_by_ranges",
    "clear_index",
    "cluster_vectors",
    "describe_documents",
    "encode",
    "encode_sparse",
    "engine_stats",
    "exact_topk",
    "expand_queries",
    "get_session",
    "incremental_embed",
    "index_integrity",
    "index_job",
    "index_stats",
    "iterate_documents",
    "keyed_lookup",
    "keyword_matches",
    "label_hits",
    "list_documents",
    "load_index",
    "lookup_by_hash",
    "nonzero_weights",
    "pruned_topk",
    "publish_index",
    "read_partial_index",
    "read_text_corpus",
    "register_sql",
    "run_dir",
    "score_histogram",
    "score_pairs",
    "score_quantiles",
    "scores",
    "search",
    "search_records",
    "sparse_topk",
    "stream_index",
    "stream_upsert",
    "text",
    "text_corpus_stream",
    "update_partial_index",
    "upsert_events",
    "validate_queries",
    "vectors",
    "write_keyed",
    "write_text_files",
]
