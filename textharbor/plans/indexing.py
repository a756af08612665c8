"""Keeping vectors and the search index up to date with a corpus."""

from collections import namedtuple

from pyspark.sql import functions as F

from textharbor.operators.encode import encode
from textharbor.operators.lookup import label_hits, latest_rows, salted_lookup, uncached
from textharbor.operators.search import describe_documents
from textharbor.session import BROADCAST_BYTES, write_and_read
from textharbor.sources.index import build_vectors, new_snapshot, newest_snapshot, publish_snapshot

#: Vectors of all documents (doc_id, content_hash, embedding) and the number of store misses.
Embedded = namedtuple("Embedded", "vectors misses")


def _uncached_keys(keys, store, store_bytes, limit):
    """Written table of keys without a current vector, and its size."""
    missing = uncached(keys, store.keys(), store_bytes if store_bytes <= limit else None)
    missing = write_and_read(missing.select("doc_id").distinct(), "misses")
    size = F.octet_length(F.col("doc_id").cast("string")) + F.lit(32)
    return missing, missing.agg(F.sum(size)).first()[0] or 0


def _pending(docs, keys, store, limit):
    """Documents whose vector is absent or stale, or None if there are none, and the keys of all documents.

    Where the store's keys can be broadcast, texts are read and cleaned once: one pass writes the keys of all
    documents and the texts of those only that need a vector. Texts are shuffled only if neither the store's keys nor
    the missing keys can be broadcast.
    """
    store_bytes = store.key_bytes()
    if keys is None and store_bytes <= limit:
        marked = label_hits(docs, store.keys(), store_bytes)
        texts = [F.when(~F.col("hit"), F.col(c)).alias(c) for c in docs.columns if c not in ("doc_id", "content_hash")]
        marked = write_and_read(marked.select("doc_id", "content_hash", *texts, "hit"), "marked")
        pending = marked.filter("not hit").drop("hit")
        return (None if pending.isEmpty() else pending), marked.select("doc_id", "content_hash")
    # Decide on keys and fingerprints alone, then go back for the texts that are needed.
    keys = docs.select("doc_id", "content_hash") if keys is None else keys
    missing, size = _uncached_keys(keys, store, store_bytes, limit)
    if not size:
        return None, keys
    return docs.join(F.broadcast(missing) if size <= limit else missing, "doc_id", "left_semi"), keys


def _store_rows(docs, also=()):
    facts = F.create_map(
        F.lit("filename"), F.col("filename"), F.lit("doc_length"), F.col("doc_length").cast("string")
    )
    return docs.select("doc_id", "embedding", "content_hash", facts.alias("metadata"), *also)


def _reuse_texts(pending, store, encoder, limit):
    """Rows for pending documents: vectors of equal stored texts where there are any, else encoded.

    Texts themselves are not joined: copies are found by fingerprint on narrow rows.
    """
    narrow = pending.select("doc_id", "content_hash", "filename", "doc_length")
    known = store.by_hash(narrow).select("content_hash", "embedding")
    store_bytes = store.key_bytes()
    # A fingerprint and its vector against the logged size of a key and its fingerprint.
    known_bytes = store_bytes * (1 + 4 * encoder.dim // 32)
    copies = salted_lookup(narrow, known, ["content_hash"], "doc_id", known_bytes, how="inner", limit=limit)
    hashes = known.select("content_hash")
    rest = salted_lookup(pending, hashes, ["content_hash"], "doc_id", store_bytes, how="left_anti", limit=limit)
    return _store_rows(copies).unionByName(_store_rows(encode(rest, "content", encoder)))


def incremental_embed(
    docs,
    store,
    encoder,
    force=False,
    reuse="key",
    keys=None,
    order_by=None,
    updated_at=None,
    stream_id=None,
    batch_id=None,
    broadcast_bytes=BROADCAST_BYTES,
):
    """Encode only documents whose (key, fingerprint) is not stored, store them, return all vectors.

    ``force`` encodes everything. ``reuse="content"`` also takes vectors of equal texts stored
    under other keys. ``keys`` is an already written (doc_id, content_hash) table of the same
    documents, if there is one. ``order_by`` names the column whose highest value wins where a
    key repeats; without it a batch with repeated keys to encode is refused.
    """
    if reuse not in ("key", "content"):
        raise ValueError(f"unknown reuse {reuse!r}")
    if store.model_id != encoder.model_id:
        raise ValueError(f"store holds {store.model_id}, encoder makes {encoder.model_id}")
    if order_by is not None:
        docs = latest_rows(docs, "doc_id", order_by)
    everything = force or not store.key_bytes()
    pending, wanted = (docs, None) if everything else _pending(docs, keys, store, broadcast_bytes)
    misses = 0
    if pending is not None:
        if reuse == "content" and not everything:
            rows = _reuse_texts(pending, store, encoder, broadcast_bytes)
        else:
            rows = _store_rows(encode(pending, "content", encoder))
        written = store.upsert(rows, updated_at, stream_id=stream_id, batch_id=batch_id)
        misses = written.rows
    if everything:
        vectors = store.batch(written.seq)
    else:
        # What was missing is stored now, so every document is a hit and nothing is encoded twice.
        vectors = store.scan().join(wanted, ["doc_id", "content_hash"], "left_semi")
    return Embedded(vectors.select("doc_id", "content_hash", "embedding"), misses)


def _index_everything(docs, store, encoder, updated_at):
    """Cold run: texts are read, cleaned and encoded in one pass.

    The one folder written is the store's new batch, the index's vectors and its documents.
    """
    also = ["filename", "doc_length", "preview", "keywords"]
    described = encode(describe_documents(docs, keep=["content"]), "content", encoder)
    written = store.upsert(_store_rows(described, also), updated_at, also=also)
    return written.path, written.path, written.rows, False


def _all_vectors(shown, keys, store, embedded):
    """Vectors of all documents; without a join where the store holds just these documents.

    After the run every document is in the store, so as many keys there as here are the same keys.
    """
    if store.keys().count() == keys.select("doc_id").distinct().count() == shown.count():
        return store.scan()
    return embedded.vectors


_FACTS = ["doc_id", "content_hash", "filename"]


def _unchanged(spark, root, facts, store):
    """The current snapshot if it is that of just these documents, else None.

    It is if nothing was written to the store since and the documents have the same keys,
    fingerprints and file names; then a run without changes writes neither vectors nor documents.
    """
    newest = newest_snapshot(spark, root)
    if not newest or not newest.vectors or newest.source != store.state():
        return None
    before = spark.read.parquet(newest.documents).select(*_FACTS)
    both = before.withColumn("n", F.lit(1)).unionByName(facts.withColumn("n", F.lit(-1)))
    changed = both.groupBy(*_FACTS).agg(F.sum("n").alias("n")).filter("n <> 0")
    return newest if changed.isEmpty() else None


def _index_changes(docs, store, encoder, updated_at, root, folder):
    """Warm run: fingerprints first, then only texts whose vector is absent or stale."""
    spark = docs.sparkSession
    facts = write_and_read(docs.select(*_FACTS), "facts")
    if newest := _unchanged(spark, root, facts, store):
        return newest.vectors, newest.documents, 0, True
    described = describe_documents(docs)
    described.write.parquet(f"{folder}/documents")
    shown = spark.read.schema(described.schema).parquet(f"{folder}/documents")
    keys = shown.select("doc_id", "content_hash")
    embedded = incremental_embed(docs, store, encoder, keys=keys, updated_at=updated_at)
    vectors = _all_vectors(shown, keys, store, embedded)
    vectors.select("doc_id", "embedding").write.parquet(f"{folder}/vectors")
    return f"{folder}/vectors", f"{folder}/documents", embedded.misses, False


def index_job(docs, store, encoder, root, force=False, updated_at=None, order_by=None, normalized=True):
    """Bring the store up to date, publish a new index snapshot, return a one-row report.

    ``order_by`` names the column whose highest value wins where a key repeats. ``normalized``
    says that the encoder returns unit vectors, as its contract asks.
    """
    spark = docs.sparkSession
    folder = new_snapshot(root)
    if order_by is not None:
        docs = latest_rows(docs, "doc_id", order_by)
    if force or not store.key_bytes():
        vectors, documents, misses, published = _index_everything(docs, store, encoder, updated_at)
    else:
        vectors, documents, misses, published = _index_changes(docs, store, encoder, updated_at, root, folder)
    if not normalized and not published:
        build_vectors(spark.read.parquet(vectors)).write.parquet(f"{folder}/unit")
        vectors = f"{folder}/unit"
    publish_snapshot(spark, root, vectors, documents, store.state())
    return spark.read.parquet(vectors).agg(F.count(F.lit(1)).alias("indexed_documents")).select(
        "indexed_documents",
        (F.col("indexed_documents") - misses).alias("cache_hits"),
        F.lit(misses).cast("long").alias("cache_misses"),
        store.keys().agg(F.count(F.lit(1))).scalar().alias("cached_embeddings"),
    )
