"""Narrow tables of keys and fingerprints, bucketed once, so that they join without a shuffle.

Corpus and store keys that are compared run after run are dealt to buckets by (key, fingerprint) when they are written.
Two tables with one number of buckets then meet bucket by bucket, and no side is moved. Within a bucket rows are stored
in order; Spark sorts them again, which is quick on sorted rows.
"""

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textharbor.session import run_dir

#: Buckets of a table. Both sides of a join need the same number; a bucket is read by one task.
BUCKETS = 64

_ON = ["doc_id", "content_hash"]


class BucketedKeys(NamedTuple):
    """A bucketed table of (doc_id, content_hash, ...) and its name in the session's catalog."""

    rows: DataFrame
    name: str

    def hits(self, stored):
        """Rows whose key and fingerprint another bucketed table holds."""
        return self.rows.hint("merge").join(stored.rows.select(*_ON), _ON, "left_semi")

    def misses(self, stored):
        """Rows whose key and fingerprint another bucketed table does not hold."""
        return self.rows.hint("merge").join(stored.rows.select(*_ON), _ON, "left_anti")

    def flagged(self, stored, out="hit"):
        """All rows with a flag that says whether another bucketed table holds key and fingerprint."""
        known = stored.rows.select(*_ON, F.lit(True).alias(out))
        return self.rows.hint("merge").join(known, _ON, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))

    def forget(self):
        """Take the table out of the catalog; its files stay."""
        self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def bucket_keys(rows, buckets=BUCKETS, also=()):
    """``doc_id`` and ``content_hash`` of ``rows`` (and the columns ``also``) as a bucketed table below the shared folder.

    Rows are dealt like the buckets before they are written, so a bucket is one file. Rows with a NULL key or fingerprint
    are kept and never match.
    """
    spark = rows.sparkSession
    name = f"textharbor_keys_{uuid.uuid4().hex}"
    dealt = rows.select(*_ON, *also).repartition(buckets, *_ON)
    writer = dealt.write.bucketBy(buckets, *_ON).sortBy(*_ON).format("parquet")
    writer.option("path", run_dir(spark, "bucketed-keys")).saveAsTable(name)
    return BucketedKeys(spark.table(name), name)
