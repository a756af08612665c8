"""An index kept up to date part by part: a run rewrites the parts that hold a change and no others.

The index is one table, partitioned by a hash of the key. Documents and index are compared by one order-independent sum
of fingerprints per part; only for parts whose sums differ are keys compared, vectors joined and texts encoded, and only
these folders are overwritten. A part that lost its last document keeps an empty mark, as an overwrite never removes
folders.
"""

from collections import namedtuple

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textharbor.functions.vectors import l2_normalize
from textharbor.operators.encode import encode
from textharbor.operators.search import describe_documents
from textharbor.session import write_and_read

#: Folders of an index; a run with a single change writes about one in so many of all rows.
PARTS = 64

#: Rows of a file; a part with more is written by several tasks.
FILE_ROWS = 1_000_000

#: What a run did: parts written, documents in them, vectors taken over and texts encoded.
Updated = namedtuple("Updated", "parts rows reused encoded")

_FACTS = ("doc_id", "content_hash", "filename")


def _part_of(key, parts):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _sums(rows, sign):
    """Per part the number of rows and a sum of their hashes, either with a sign."""
    facts = F.xxhash64(*_FACTS).cast("decimal(38,0)")
    return rows.groupBy("part").agg(
        (F.count(F.lit(1)) * sign).alias("n"), (F.sum(facts) * sign).alias("h")
    )


def read_partial_index(spark, path):
    """The current rows (doc_id, content_hash, filename, doc_length, preview, keywords, embedding, part); None without an index."""
    try:
        return spark.read.parquet(path).filter("doc_id is not null")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def changed_parts(docs, index, parts=PARTS):
    """Parts in which keys, fingerprints or file names of documents and index differ, one small row each.

    Nothing but one row per part and task is shuffled. Differing parts with equal counts and equal sums of 64-bit hashes
    have a chance of 2**-64.
    """
    mine = docs.select(*_FACTS).withColumn("part", _part_of("doc_id", parts))
    sums = _sums(mine, 1)
    if index is not None:
        sums = sums.unionByName(_sums(index.select(*_FACTS, "part"), -1))
    total = sums.groupBy("part").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    return total.filter("n <> 0 or h <> 0").select("part")


def update_partial_index(docs, path, encoder, parts=PARTS, normalized=True):
    """Bring the index under ``path`` to the state of ``docs`` (unique keys); returns what was done.

    Vectors of documents with the same key and fingerprint are taken over. ``parts`` is fixed with the first run: a
    later one with another number would look for keys elsewhere, and is refused. ``normalized`` says that the encoder
    returns unit vectors. One writer at a time; a reader during the overwrite may see old and new parts side by side,
    never half a part.
    """
    spark = docs.sparkSession
    index = read_partial_index(spark, path)
    touched = None
    if index is not None:
        # Texts are cleaned once: what is compared here is described below.
        docs = write_and_read(docs.select("doc_id", "content", "filename", "doc_length", "content_hash"), "partial-documents")
        touched = sorted(r["part"] for r in changed_parts(docs, index, parts).collect())  # PARTS rows at most
        if not touched:
            return Updated(0, 0, 0, 0)
        docs = docs.filter(_part_of("doc_id", parts).isin(touched))
    described = describe_documents(docs, keep=["content"]).withColumn("part", _part_of("doc_id", parts))
    if index is None:
        known = None
        fresh = described
    else:
        known = index.filter(F.col("part").isin(touched))  # other folders are not read
        if not known.filter(F.col("part") != _part_of("doc_id", parts)).isEmpty():
            raise ValueError(f"the index under {path} has another number of parts than {parts}")
        known = known.select("doc_id", "content_hash", "embedding")
        flagged = described.join(known.select("doc_id", "content_hash", F.lit(True).alias("held")), ["doc_id", "content_hash"], "left")
        flagged = write_and_read(flagged, "partial-changes")
        fresh = flagged.filter("held is null").drop("held")
    encoded = encode(fresh, "content", encoder)
    if not normalized:
        encoded = encoded.withColumn("embedding", l2_normalize(F.col("embedding")))
    rows = encoded.drop("content")
    if known is not None:
        old = flagged.filter("held").drop("held", "content").join(known, ["doc_id", "content_hash"])
        rows = rows.withColumn("reused", F.lit(False)).unionByName(old.withColumn("reused", F.lit(True)))
    else:
        rows = rows.withColumn("reused", F.lit(False))
    # Written first and counted there: what is overwritten is read until then.
    staged = write_and_read(rows, "partial-parts")
    counts = {r["part"]: (r["n"], r["reused"], r["keys"]) for r in staged.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("reused").alias("reused"), F.count_distinct("doc_id").alias("keys")).collect()}
    if any(n != keys for n, _, keys in counts.values()):
        raise ValueError("a key comes more than once among the documents")
    if touched is None:
        touched = sorted(counts)  # without an index all parts with a document are new
        if not touched:
            return Updated(0, 0, 0, 0)
    out = staged.drop("reused")
    emptied = [p for p in touched if p not in counts]
    if emptied:
        marks = spark.createDataFrame([(p,) for p in emptied], "part int")
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema if f.name != "part"]
        out = out.unionByName(marks.select(*nothing, "part"))
    n, reused = sum(c[0] for c in counts.values()), sum(c[1] for c in counts.values())
    files = max(1, -(-max((c[0] for c in counts.values()), default=0) // FILE_ROWS))
    dealt = out.repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(files)))
    writer = dealt.write.partitionBy("part").option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").parquet(path)
    return Updated(len(touched), n, reused, n - reused)
