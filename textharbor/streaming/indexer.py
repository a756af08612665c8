"""The incremental embedding job as a stream."""

from textharbor.plans.indexing import incremental_embed


def stream_index(docs, store, encoder, checkpoint, stream_id, order_by=None, updated_at=None, trigger=None):
    """Embed new and changed documents of a streaming DataFrame; returns the running query.

    ``docs`` is a stream of documents (``as_documents`` of a ``readStream``). State lives in the
    store, so there is no watermark. A micro-batch that was stored before a restart is skipped;
    one that was not is done again and leaves no trace of the failed attempt.
    """

    def store_batch(batch, batch_id):
        if store.committed(stream_id, batch_id):
            return
        incremental_embed(
            batch,
            store,
            encoder,
            order_by=order_by,
            updated_at=updated_at,
            stream_id=stream_id,
            batch_id=batch_id,
        )

    writer = docs.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
