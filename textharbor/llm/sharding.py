"""Sharding: contiguous shards of nearly equal bytes, cut by global prefix sums.

Rows are dealt into sorted ranges, every range sums its own bytes, and the totals of the ranges say what stands before
each. A row goes to the shard in which the middle of its bytes lies, so a shard differs from its target by at most one
row. Nothing passes through one task but the totals, one row a range.
"""

from pyspark.sql import functions as F

from textharbor.llm.common import attach, nulls_first, prefix_sums, sorted_ranges
from textharbor.session import write_and_read


def with_sizes(df, key, text, overhead):
    """Key, ``size`` in UTF-8 bytes plus ``overhead``, and the CRC-32 of the text; a null text has no bytes."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    return df.select(
        F.col(f"`{key}`").alias("key"),
        (F.octet_length(value) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(value).cast("long").alias("text_crc32"),
    )


def assign_shards(df, key="doc_id", text="text", shards=40, overhead=16):
    """Rows (key, size, text_crc32, shard, slot): shards 0 to ``shards`` - 1 in the order of the key.

    Shards are contiguous in that order, ``slot`` numbers a shard's rows from 0 without gaps. Null keys come first,
    repeated keys are told apart by CRC and size; rows equal in all three are interchangeable. Null texts have size
    ``overhead``. A table of fewer rows than shards, or with one huge text, leaves shards empty. Other columns of
    ``df`` are not looked at. An empty table gives an empty result.
    """
    order = nulls_first("key", "text_crc32", "size")
    sized = with_sizes(df, key, text, overhead).withColumn("one", F.lit(1).cast("long"))
    ranged = sorted_ranges(sized, order, "shard")
    total = ranged.agg(F.sum("size")).first()[0] or 1
    placed = prefix_sums(ranged, order, ["size", "one"]).withColumn(
        "shard", F.expr(f"int(least({shards - 1}, ((2 * before_size + size) * {shards}) div {2 * total}))")
    )
    first = placed.groupBy("shard").agg(F.min("before_one").alias("first"))  # a row a shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("before_one") - F.col("first")).alias("slot")
    )


def shard_report(df, shards=40, **options):
    """Shards under the law ``bytes``: sizes near equal. ``grown_shard`` is null, as one more shard moves all cuts."""
    return assign_shards(df, shards=shards, **options).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded_documents(df, key="doc_id", text="text", **options):
    """Rows (row, size, shard, slot): the rows of ``df``, all columns inside ``row``, with their places."""
    plan = assign_shards(df, key, text, **options)
    plan = write_and_read(plan.withColumnRenamed(key, "id"), "shard-plan")
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    keys = {"id": F.col(f"`{key}`"), "text_crc32": F.crc32(value).cast("long")}
    return attach(df, plan, keys, ["size", "shard", "slot"])
