"""Matching documents against the embedding store."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textharbor.session import BROADCAST_BYTES, write_and_read

#: Rows of one value that one task takes; a value with more is split in proportion.
HOT_ROWS = 1_000_000


def salted_lookup(rows, lookup, on, salt_by, lookup_bytes, how="left", limit=BROADCAST_BYTES, hot_rows=HOT_ROWS):
    """``rows`` joined to ``lookup``, which holds one row per value of ``on``.

    A lookup measured at ``limit`` bytes or less is broadcast. For a larger one the values are
    counted first (a row per value and task is shuffled for that). Values with more than
    ``hot_rows`` rows are salted by column ``salt_by``, each with salts in proportion to its
    count, and their lookup rows copied as often; all other rows are joined as they are. There
    are at most rows / ``hot_rows`` hot values, so they and their copies stay few.
    """
    if lookup_bytes <= limit:
        return rows.join(F.broadcast(lookup), on, how)
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = write_and_read(counts.select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")), "hot")
    if not hot.limit(1).count():
        return rows.join(lookup, on, how)
    of_row = F.pmod(F.xxhash64(salt_by), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", of_row).drop("_salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    copies = lookup.join(F.broadcast(hot), on, "left").withColumn("_salt", every).drop("_salts")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def latest_rows(df, key, order_by, count=None):
    """The row with the highest ``order_by`` per key; NULL is lowest, of equal ones a hash of the row decides.

    The same row wins however often the frame is evaluated. Spark cuts each key to its best row
    before the shuffle, so repeated keys do not move. ``count`` names a column for the number of
    rows the key had, counted on keys alone.
    """
    columns = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes if c != key]
    order = [F.desc_nulls_last(order_by), F.xxhash64(*columns)]
    best = df.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    best = best.filter("_place = 1").drop("_place")
    if not count:
        return best
    return best.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(count)), key)


def _bounded(df, n_bytes):
    return F.broadcast(df) if n_bytes is not None and n_bytes <= BROADCAST_BYTES else df


def cached(docs, store_keys, store_bytes=None):
    """Documents whose stored fingerprint is current."""
    keys = store_keys.select("doc_id", "content_hash")
    return docs.join(_bounded(keys, store_bytes), ["doc_id", "content_hash"], "left_semi")


def uncached(docs, store_keys, store_bytes=None):
    """Documents that are absent from the store or stored with another fingerprint."""
    keys = store_keys.select("doc_id", "content_hash")
    return docs.join(_bounded(keys, store_bytes), ["doc_id", "content_hash"], "left_anti")


def label_hits(docs, store_keys, store_bytes=None, out="hit"):
    """Every document with a flag: is its stored vector still valid?"""
    known = store_keys.select("doc_id", "content_hash", F.lit(True).alias(out))
    joined = docs.join(_bounded(known, store_bytes), ["doc_id", "content_hash"], "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def hit_ratio(docs, store_keys, store_bytes=None):
    """One row: hits, misses and documents."""
    flagged = label_hits(docs.select("doc_id", "content_hash"), store_keys, store_bytes)
    return flagged.agg(
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.count(F.lit(1)).alias("documents"),
    )


def first_by_hash(store_keys):
    """One key per fingerprint, the smallest; combined on the map side, so hot fingerprints stay small."""
    return store_keys.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


def lookup_by_hash(docs, store_keys, store_bytes=None, how="left"):
    """Documents with the key of some stored row of the same text, as ``cached_id``."""
    found = first_by_hash(store_keys).withColumnRenamed("doc_id", "cached_id")
    size = BROADCAST_BYTES + 1 if store_bytes is None else store_bytes
    return salted_lookup(docs, found, ["content_hash"], "doc_id", size, how)
