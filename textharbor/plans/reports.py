"""Listings, counts and checks."""

from pyspark.sql import functions as F

from textharbor.functions.text import listing_preview
from textharbor.session import write_and_read

INDEX_TYPE = "exact"


def list_documents(docs):
    """One row per document with a short preview and the number of documents.

    Texts are read and cleaned once: the listing is written to the shared folder and counted there.
    """
    listing = docs.select(
        "doc_id", "filename", F.col("doc_length").alias("length"), listing_preview(F.col("content")).alias("preview")
    )
    listing = write_and_read(listing, "listing")
    return listing.select("*", listing.agg(F.count(F.lit(1))).scalar().alias("total"))


def engine_stats(vectors, store):
    """One row: vectors in the index, stored vectors, their bytes, index type, is anything loaded."""
    stored = store.stats()
    return vectors.agg(F.count(F.lit(1)).alias("indexed_documents")).select(
        "indexed_documents",
        stored.select("total_entries").scalar().alias("cached_embeddings"),
        stored.select("size_bytes").scalar().alias("cache_size_bytes"),
        F.lit(INDEX_TYPE).alias("index_type"),
        (F.col("indexed_documents") > 0).alias("index_loaded"),
    )


def index_integrity(docs, vectors):
    """One row: documents without a vector and vectors without a document; both 0 when sound."""
    known = docs.select("doc_id").withColumn("d", F.lit(1)).withColumn("v", F.lit(0))
    held = vectors.select("doc_id").withColumn("d", F.lit(0)).withColumn("v", F.lit(1))
    per_key = known.unionByName(held).groupBy("doc_id").agg(F.sum("d").alias("d"), F.sum("v").alias("v"))
    return per_key.agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("vectors"),
        F.count_if((F.col("d") > 0) & (F.col("v") == 0)).alias("documents_without_vector"),
        F.count_if((F.col("d") == 0) & (F.col("v") > 0)).alias("vectors_without_document"),
        F.count_if((F.col("d") > 1) | (F.col("v") > 1)).alias("repeated_keys"),
    )
