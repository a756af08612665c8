"""Search hits as JSON records."""

from pyspark.sql import functions as F


def search_records(hits, query_id="query_id"):
    """One JSON text per hit: (query_id, rank, record)."""
    fields = [c for c in hits.columns if c not in (query_id, "rank")]
    return hits.select(query_id, "rank", F.to_json(F.struct(*fields)).alias("record"))
