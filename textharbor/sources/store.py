"""The embedding store: an append-only table of vectors keyed by document and model.

``path/data/<name>/`` holds one Parquet folder per accepted write and ``path/log/`` says which
folders count and in which order (``seq``). The newest row of a key wins; a deletion is a row
too. ``compact`` writes the current rows as a new base, after which older folders are not read.
"""

import uuid
from collections import namedtuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.operators.lookup import first_by_hash, latest_rows
from textharbor.schema import store_schema
from textharbor.session import BROADCAST_BYTES
from textharbor.sources import log

#: What one write did: its place in the log, rows handed in, rows stored, its folder.
Written = namedtuple("Written", "seq given rows path")

_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),  # batch, base or clear
        T.StructField("model_id", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("key_type", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("key_bytes", T.LongType()),
        T.StructField("stream_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
_PUBLIC = ["doc_id", "model_id", "embedding", "content_hash", "updated_at", "metadata"]


class EmbeddingStore:
    def __init__(self, spark, path, model_id, key_type=None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.model_id = model_id
        self.key_type = key_type or T.StringType()

    # -- reading -----------------------------------------------------------------

    def _log(self, mine=True):
        """The log as a table, one small row per write; None before the first."""
        rows = log.read(self.spark, f"{self.path}/log", _LOG)
        return rows.filter(F.col("model_id") == self.model_id) if mine and rows is not None else rows

    def _last_seq(self, condition="true", mine=True):
        """The highest number among log rows that meet a condition, 0 without any."""
        rows = self._log(mine)
        return 0 if rows is None else rows.filter(condition).agg(F.max("seq")).first()[0] or 0

    def _entries(self):
        """Log rows of this model that still matter: the last base or clear and what came after.

        Only these come to the driver, however long the log is.
        """
        rows = self._log()
        if rows is None:
            return []
        start = self._last_seq("kind <> 'batch'")
        entries = sorted(rows.filter((F.col("seq") >= start) & (F.col("rows") > 0)).collect(), key=lambda e: e.seq)
        if len({e.seq for e in entries}) < len(entries):
            raise ValueError(f"two writes under {self.path} have one number; only one writer may be at work")
        return entries

    def _next_seq(self):
        return self._last_seq(mine=False) + 1

    def _read(self, entries):
        if not entries:
            return self.spark.createDataFrame([], store_schema(self.key_type))
        schema = store_schema(T.DataType.fromDDL(entries[0].key_type))
        return self.spark.read.schema(schema).parquet(*[self._folder(e.folder) for e in entries])

    def _folder(self, name):
        return f"{self.path}/data/{name}"

    def _live(self, entries):
        rows = self._read(entries)
        if len(entries) > 1:
            # Only keys and sequence numbers decide which rows are read on.
            older, newer = entries[:1], entries[1:]
            recent = self._read(newer).groupBy("doc_id").agg(F.max("seq").alias("seq"))
            if sum(e.key_bytes for e in newer) <= BROADCAST_BYTES:
                recent = F.broadcast(recent)
            base = self._read(older).join(recent, "doc_id", "left_anti")
            rows = base.unionByName(self._read(newer).join(recent, ["doc_id", "seq"], "left_semi"))
        return rows.filter(~F.col("deleted"))

    def scan(self):
        """Current rows, one per key."""
        return self._live(self._entries()).select(*_PUBLIC)

    def keys(self):
        """Current keys and fingerprints; vectors are not read."""
        return self.scan().select("doc_id", "content_hash")

    def key_bytes(self):
        """Upper bound of the size of ``keys()``, from the log alone."""
        return sum(e.key_bytes for e in self._entries())

    def writes(self):
        """Writes that make up the current content: each is read by every scan."""
        return len(self._entries())

    def state(self):
        """Names the store's current content: it changes with every write."""
        return f"{self.path}#{self.model_id}#{self._last_seq()}"

    def batch(self, seq):
        """The rows of one write."""
        entries = [e for e in self._entries() if e.seq == seq]
        return self._read(entries).filter(~F.col("deleted")).select(*_PUBLIC)

    def get(self, keys):
        """Rows of some keys: a list (pushed to the scan) or a DataFrame with ``doc_id``."""
        if isinstance(keys, DataFrame):
            return self.scan().join(keys.select("doc_id").distinct(), "doc_id", "left_semi")
        return self.scan().filter(F.col("doc_id").isin(list(keys)))

    def by_hash(self, hashes):
        """For every distinct fingerprint in ``hashes`` the stored row with the smallest key."""
        first = first_by_hash(self.keys())
        wanted = first.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")
        return self.scan().join(wanted, ["content_hash", "doc_id"], "left_semi").select(*_PUBLIC)

    def stats(self):
        """One row: entries, latest update, bytes on disk, path. File contents are not read."""
        entries = self._entries()
        size = F.lit(0).cast("long")
        if entries:
            files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
            folders = files.load([self._folder(e.folder) for e in entries])
            size = folders.agg(F.sum("length")).scalar()
        rows = self._live(entries).agg(
            F.count(F.lit(1)).alias("total_entries"), F.max("updated_at").alias("latest_update")
        )
        return rows.select("*", size.alias("size_bytes"), F.lit(self.path).alias("path"))

    def committed(self, stream_id, batch_id):
        """Has this micro-batch been stored already?"""
        same = F.col("stream_id").eqNullSafe(F.lit(stream_id)) & F.col("batch_id").eqNullSafe(F.lit(batch_id))
        return self._last_seq(same) > 0

    # -- writing -----------------------------------------------------------------

    def _commit(self, seq, kind, rows=0, **fields):
        if seq < self._next_seq():
            raise ValueError(f"number {seq} is already in the log; only one writer may be at work")
        log.append(
            self.spark, f"{self.path}/log", _LOG, seq=seq, kind=kind, model_id=self.model_id, rows=rows, **fields
        )

    def _write(self, rows, seq):
        """Write rows to a fresh folder; returns log fields and the number of rows of the most frequent key.

        All is counted from the written keys.
        """
        folder = f"{seq:08d}-{uuid.uuid4().hex}"
        rows.withColumn("seq", F.lit(seq).cast("long")).write.parquet(self._folder(folder))
        written = self.spark.read.schema(rows.schema).parquet(self._folder(folder))
        size = F.octet_length(F.col("doc_id").cast("string")) + F.octet_length("content_hash") + F.lit(32)
        per_key = written.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
        n, key_bytes, most = per_key.agg(F.sum("n"), F.sum("size"), F.max("n")).first()
        key_type = rows.schema["doc_id"].dataType.simpleString()
        fields = {"folder": folder, "rows": n or 0, "key_bytes": key_bytes or 0, "key_type": key_type}
        return fields, most or 0

    def upsert(self, rows, updated_at=None, order_by=None, stream_id=None, batch_id=None, also=()):
        """Insert or replace rows (doc_id, embedding, content_hash[, metadata]).

        With ``order_by`` the highest value wins where a key comes more than once; without it
        such a batch is refused. Nothing is visible before the whole batch has been accepted.
        ``also`` names columns written next to the rows, for readers of the returned path only.
        """
        columns = rows.columns
        when = F.current_timestamp() if updated_at is None else F.lit(updated_at)
        no_metadata = F.lit(None).cast("map<string,string>")
        metadata = F.when(F.size("metadata") > 0, F.col("metadata")) if "metadata" in columns else no_metadata
        given = "_given"
        if order_by is not None:
            rows = latest_rows(rows, "doc_id", order_by, count=given)
        needed = {c: self._not_null(c) for c in ("doc_id", "embedding", "content_hash")}
        rows = rows.select(
            needed["doc_id"].alias("doc_id"),
            F.lit(self.model_id).alias("model_id"),
            needed["embedding"].cast("array<float>").alias("embedding"),
            needed["content_hash"].alias("content_hash"),
            when.cast("timestamp").alias("updated_at"),
            metadata.alias("metadata"),
            F.lit(False).alias("deleted"),
            *([given] if order_by is not None else []),
            *also,
        )
        seq = self._next_seq()
        fields, most = self._write(rows, seq)
        path, total = self._folder(fields["folder"]), fields["rows"]
        if order_by is not None:
            total = self.spark.read.schema(rows.schema).parquet(path).agg(F.sum(given)).first()[0] or 0
        elif most > 1:
            raise ValueError("a key comes more than once in the batch; pass order_by to say which row wins")
        if fields["rows"]:  # an empty batch leaves no row; doing it again would store nothing either
            self._commit(seq, "batch", stream_id=stream_id, batch_id=batch_id, **fields)
        return Written(seq, total, fields["rows"], path)

    @staticmethod
    def _not_null(column):
        missing = F.raise_error(F.lit(f"{column} must not be NULL"))
        return F.when(F.col(column).isNull(), missing).otherwise(F.col(column))

    def delete(self, keys):
        """Remove keys (a DataFrame with ``doc_id`` or a list); returns how many existed."""
        return self._bury(self.get(keys).select("doc_id", "content_hash"))

    def vacuum(self, docs):
        """Remove keys that no document has any more; returns how many."""
        return self._bury(self.keys().join(docs.select("doc_id"), "doc_id", "left_anti"))

    def _bury(self, rows):
        dead = rows.select(
            "doc_id",
            F.lit(self.model_id).alias("model_id"),
            F.lit(None).cast("array<float>").alias("embedding"),
            "content_hash",
            F.lit(None).cast("timestamp").alias("updated_at"),
            F.lit(None).cast("map<string,string>").alias("metadata"),
            F.lit(True).alias("deleted"),
        )
        seq = self._next_seq()
        fields, _ = self._write(dead, seq)
        if fields["rows"]:
            self._commit(seq, "batch", **fields)
        return fields["rows"]

    def clear(self):
        """Forget every row; returns how many there were."""
        n = self.keys().count()
        self._commit(self._next_seq(), "clear")
        return n

    def compact(self):
        """Write the current rows as the new base of the log; returns how many there are."""
        seq = self._next_seq()
        rows = self.scan().withColumn("deleted", F.lit(False))
        fields, _ = self._write(rows, seq)
        self._commit(seq, "base", **fields)
        return fields["rows"]
