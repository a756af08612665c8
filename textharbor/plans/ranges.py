"""Integrity of an index by fingerprints of key ranges: only ranges that differ are compared key by key.

Keys are hashed, and the hashes cut into ``2 ** BITS`` ranges. Per range, documents and vectors each give a count and two
sums of hashes that do not depend on the order of rows: one row per range and task is all that is shuffled. The ranges
form a tree, ``2 ** STEP`` to one above; it is walked from the root, and below a node whose sums agree nothing is looked
at. Keys of the ranges left at the leaves are then counted one by one.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textharbor.plans.reports import index_integrity
from textharbor.session import write_and_read

BITS = 12
STEP = 4

_SUMS = ("n", "s", "t")


class RangeCheck(NamedTuple):
    """``report`` as ``index_integrity`` gives it; ``keys`` (doc_id, documents, vectors) that differ; ``levels`` (level,
    ranges compared, ranges that differ)."""

    report: DataFrame
    keys: DataFrame
    levels: DataFrame


def _range(key):
    return F.shiftrightunsigned(F.xxhash64(key), 64 - BITS).cast("int")


def _fingerprints(rows, side):
    """Per range: the count of its keys and sums of two of their hashes, in the columns of one side."""
    hashed = rows.select(_range("doc_id").alias("range"), "doc_id")
    values = (F.lit(1), F.xxhash64("doc_id"), F.xxhash64(F.lit(1), "doc_id"))
    sums = [F.sum(v.cast("decimal(38,0)")).alias(f"{side}_{c}") for c, v in zip(_SUMS, values)]
    none = [F.lit(0).cast("decimal(38,0)").alias(f"{other}_{c}") for other in ("d", "v") if other != side for c in _SUMS]
    return hashed.groupBy("range").agg(*sums).select("range", "*", *none).select("range", *_columns())


def _columns():
    return [f"{side}_{c}" for side in ("d", "v") for c in _SUMS]


def _unequal():
    different = F.lit(False)
    for c in _SUMS:
        different = different | (F.col(f"d_{c}") != F.col(f"v_{c}"))
    return different


def check_by_ranges(docs, vectors):
    """Documents without a vector, vectors without a document and repeated keys, found by ranges.

    The counts are those of ``index_integrity``, but for one case: a key that comes just as often in both tables, more
    than once, is only seen where its range differs otherwise. Differing ranges with equal counts and both sums equal
    have a chance of about 2**-128. NULL keys are keys like others.
    """
    both = _fingerprints(docs, "d").unionByName(_fingerprints(vectors, "v"))
    ranges = write_and_read(both.groupBy("range").agg(*[F.sum(c).alias(c) for c in _columns()]), "key-ranges")  # 2**BITS rows
    above, levels = None, None
    for bits in range(0, BITS + 1, STEP):
        here = ranges.withColumn("node", F.shiftright("range", BITS - bits))
        nodes = here.groupBy("node").agg(*[F.sum(c).alias(c) for c in _columns()])
        if above is not None:
            nodes = nodes.join(above, F.shiftright(nodes["node"], STEP) == above["parent"], "left_semi")
        unequal = nodes.filter(_unequal()).select(F.col("node").alias("parent"))
        count = nodes.agg(F.count(F.lit(1)).alias("ranges"), F.count_if(_unequal()).alias("unequal")).select(
            F.lit(bits // STEP).alias("level"), "ranges", "unequal"
        )
        levels = count if levels is None else levels.unionByName(count)
        above = unequal
    leaves = F.broadcast(above.withColumnRenamed("parent", "range"))  # 2**BITS at most
    left, right = (
        rows.select("doc_id", _range("doc_id").alias("range")).join(leaves, "range", "left_semi").select("doc_id")
        for rows in (docs, vectors)
    )
    found = index_integrity(left, right).drop("documents", "vectors")
    total = ranges.agg(*[F.coalesce(F.sum(f"{s}_n"), F.lit(0)).cast("long").alias(c) for s, c in (("d", "documents"), ("v", "vectors"))])
    counts = left.withColumn("d", F.lit(1)).withColumn("v", F.lit(0)).unionByName(
        right.withColumn("d", F.lit(0)).withColumn("v", F.lit(1))
    )
    keys = counts.groupBy("doc_id").agg(F.sum("d").alias("documents"), F.sum("v").alias("vectors"))
    report = total.select("documents", "vectors", *[found.select(c).scalar().alias(c) for c in found.columns])
    return RangeCheck(report, keys.filter("documents <> vectors"), levels)
