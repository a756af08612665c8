"""Upserts and deletions as a stream: the last write of every key wins, within a micro-batch and across them.

A state per key remembers version and fingerprint of what won so far, not the text. Events that are older, or that change
nothing, go no further; of each key at most one change leaves a micro-batch, whatever order events arrive in.
"""

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from textharbor.functions import cleaning
from textharbor.functions.text import content_hash
from textharbor.plans.indexing import incremental_embed
from textharbor.session import write_and_read

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Keyed state of any kind needs this state store.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Writes that a store may consist of before a stream compacts it.
COMPACT_AFTER = 32

_COLUMNS = ("doc_id", "content", "filename", "doc_length", "content_hash", "version", "deleted")


def upsert_events(df, key="doc_id", text="text", version="version", deleted=None, filename=None, cleaner=cleaning.clean):
    """Rows of a table or stream as events: ``version`` (whole number or timestamp) orders the writes of a key.

    ``deleted`` names a boolean column; a text that cleans to nothing, or is NULL, is a deletion too. A NULL key or
    version is an error.
    """
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    content = F.when(~gone, cleaner(F.col(text)) if cleaner else F.col(text))
    rows = df.select("*", F.coalesce(content, F.lit("")).alias("_content"))
    order = F.unix_micros(version) if isinstance(df.schema[version].dataType, T.TimestampType) else F.col(version).cast("long")
    needed = {
        name: F.when(column.isNull(), F.raise_error(F.lit(f"{name} must not be NULL"))).otherwise(column)
        for name, column in (("doc_id", F.col(key)), ("version", order))
    }
    return rows.select(
        needed["doc_id"].alias("doc_id"),
        F.col("_content").alias("content"),
        (F.col(filename) if filename else F.lit("")).alias("filename"),
        F.length("_content").alias("doc_length"),
        content_hash(F.col("_content")).alias("content_hash"),
        needed["version"].alias("version"),
        (F.col("_content") == "").alias("deleted"),
    )


class LastWrite(StatefulProcessor):
    """Of a key's events the one with the highest version; a deletion, then the larger fingerprint, among equal ones."""

    def init(self, handle):
        self.last = handle.getValueState("last", "version bigint, deleted boolean, content_hash string")

    @staticmethod
    def _rank(row):
        return row["version"], row["deleted"], row["content_hash"]

    def handleInputRows(self, key, rows, timerValues):
        best = max(rows, key=self._rank, default=None)
        before = Row("version", "deleted", "content_hash")(*self.last.get()) if self.last.exists() else None
        if best is None or (before and self._rank(best) <= self._rank(before)):
            return
        self.last.update(self._rank(best))
        if before and (before["deleted"], before["content_hash"]) == (best["deleted"], best["content_hash"]):
            return  # a newer version of the same text
        yield Row(**{c: best[c] for c in _COLUMNS})

    def close(self):
        pass


def changes(events):
    """The streaming frame ``events`` cut down to changes: a key at most once in a micro-batch."""
    out = T.StructType([events.schema[c] for c in _COLUMNS])
    return events.groupBy("doc_id").transformWithState(
        statefulProcessor=LastWrite(), outputStructType=out, outputMode="Update", timeMode="None"
    )


def stream_upsert(events, store, encoder, checkpoint, stream_id, updated_at=None, trigger=None, compact_after=COMPACT_AFTER):
    """Keep a store up to date with a stream of :func:`upsert_events`; returns the running query.

    Deletions are buried first and texts stored after them, under the number of the micro-batch. A micro-batch that is
    done again after a failure finds its keys buried already, which changes nothing, and its texts stored or not. A store of
    more than ``compact_after`` writes is compacted, so that a micro-batch does not read ever more of them.
    """
    spark = store.spark

    def apply(batch, batch_id):
        if store.committed(stream_id, batch_id):
            return
        batch = write_and_read(batch, "stream-changes")  # the state is updated once, not per action
        gone = batch.filter("deleted")
        if not gone.isEmpty():
            store.delete(gone.select("doc_id"))
        docs = batch.filter("not deleted").select("doc_id", "content", "filename", "doc_length", "content_hash")
        if not docs.isEmpty():
            incremental_embed(docs, store, encoder, updated_at=updated_at, stream_id=stream_id, batch_id=batch_id)
        if store.writes() > compact_after:
            store.compact()

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # a query keeps the settings it is started with
    try:
        writer = changes(events).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        return writer.outputMode("update").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_PROVIDER, before)
