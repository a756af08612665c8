"""Vector index snapshots: a table of unit vectors and a table of what search shows."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.functions.vectors import l2_normalize
from textharbor.schema import SHOWN_COLUMNS
from textharbor.sources import log

_PUBLISHED = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("vectors", T.StringType()),
        T.StructField("documents", T.StringType()),
        T.StructField("source", T.StringType()),  # state of the store the vectors came from
    ]
)


def build_vectors(embeddings, key="doc_id", vector="embedding"):
    """(key, unit vector); a zero vector stays zero and scores 0."""
    return embeddings.select(key, l2_normalize(F.col(vector)).alias(vector))


def append_vectors(index, embeddings, key="doc_id", vector="embedding"):
    """More vectors behind an index. Keys are not made unique: a repeated key can hit twice."""
    return index.unionByName(build_vectors(embeddings, key, vector))


def new_snapshot(root):
    return f"{root.rstrip('/')}/snapshots/{uuid.uuid4().hex}"


def newest_snapshot(spark, root):
    """The newest log row, or None."""
    entries = log.read(spark, f"{root.rstrip('/')}/published", _PUBLISHED)
    return None if entries is None else entries.orderBy(F.desc("version")).first()


def publish_snapshot(spark, root, vectors, documents, source=None):
    """Make complete folders the current index; readers see the old or the new, never a mix.

    Both may be one folder whose table holds the columns of both.
    """
    newest = newest_snapshot(spark, root)
    version = newest.version + 1 if newest else 1
    path = f"{root.rstrip('/')}/published"
    log.append(spark, path, _PUBLISHED, version=version, vectors=vectors, documents=documents, source=source)
    return version


def clear_index(spark, root):
    """From now on there is no current index; returns how many vectors it had."""
    newest = newest_snapshot(spark, root)
    if not (newest and newest.vectors):
        return 0
    publish_snapshot(spark, root, None, None)
    return spark.read.parquet(newest.vectors).count()


def index_stats(spark, root):
    """One row on the current index: version, vectors, bytes on disk, path. File contents are not read."""
    newest = _current(spark, root)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(newest.vectors)
    vectors = spark.read.parquet(newest.vectors)
    return vectors.agg(F.count(F.lit(1)).alias("vectors")).select(
        F.lit(newest.version).alias("version"),
        "vectors",
        files.agg(F.sum("length")).scalar().alias("size_bytes"),
        F.lit(newest.vectors).alias("path"),
    )


def _current(spark, root):
    newest = newest_snapshot(spark, root)
    if not (newest and newest.vectors):
        raise FileNotFoundError(f"no index is published under {root}")
    return newest


def publish_index(vectors, documents, root):
    """Write both tables as a new snapshot, replacing the index; returns its version."""
    folder = new_snapshot(root)
    vectors.write.parquet(f"{folder}/vectors")
    documents.write.parquet(f"{folder}/documents")
    return publish_snapshot(vectors.sparkSession, root, f"{folder}/vectors", f"{folder}/documents")


def load_index(spark, root):
    """(vectors, documents) of the newest published snapshot."""
    newest = _current(spark, root)
    vectors, documents = spark.read.parquet(newest.vectors), spark.read.parquet(newest.documents)
    if newest.vectors == newest.documents:
        documents = documents.select("doc_id", *SHOWN_COLUMNS)
    if {"doc_id", "embedding"} <= set(vectors.columns):
        vectors = vectors.select("doc_id", "embedding")
    return vectors, documents
