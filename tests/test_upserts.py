import random

import numpy as np
import pytest

from textharbor import EmbeddingStore, HashingEncoder, run_dir, stream_upsert, upsert_events

ENCODER = HashingEncoder(32)
SCHEMA = "k string, t string, v long, gone boolean"


class Source:
    def __init__(self, spark):
        self.spark, self.path = spark, run_dir(spark, "events")
        spark.createDataFrame([], SCHEMA).write.parquet(self.path)

    def arrive(self, rows):
        rows = [(*r, None) if len(r) == 3 else r for r in rows]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def events(self):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)
        return upsert_events(stream, "k", "t", "v", "gone")


@pytest.fixture
def source(spark):
    return Source(spark)


@pytest.fixture
def store(spark):
    return EmbeddingStore(spark, run_dir(spark, "store"), ENCODER.model_id)


def drain(source, store, checkpoint):
    query = stream_upsert(source.events(), store, ENCODER, checkpoint, "s")
    query.awaitTermination()


def check(store, texts):
    got = {r.doc_id: r.embedding for r in store.scan().collect()}
    assert set(got) == set(texts)
    for key, text in texts.items():
        assert np.allclose(got[key], ENCODER.encode([text])[0])


def test_last_write_wins_within_and_across_micro_batches(spark, source, store):
    checkpoint = run_dir(spark, "checkpoint")
    source.arrive([("a", "one", 1), ("a", "three", 3), ("a", "two", 2), ("b", "old", 5), ("c", "same", 1)])
    drain(source, store, checkpoint)
    check(store, {"a": "three", "b": "old", "c": "same"})
    writes = len(store._entries())
    source.arrive([("a", "late", 2), ("b", "new", 6), ("c", "same", 9)])
    source.arrive([("b", None, 7, True), ("c", "late", 8)])
    drain(source, store, checkpoint)
    check(store, {"a": "three", "c": "same"})
    source.arrive([("b", "again", 8), ("d", "  ", 1), ("e", "gone at once", 1), ("e", None, 2, True)])
    drain(source, store, checkpoint)
    check(store, {"a": "three", "b": "again", "c": "same"})
    # stored: b's new text, its deletion, b again; versions that changed nothing left no write
    assert len(store._entries()) == writes + 3


def test_any_order_of_events_gives_the_same_store(spark, source, store):
    rng = random.Random(5)
    events = [(f"k{i % 12}", rng.choice([f"text {i}", "shared", None]), i) for i in range(150)]
    wanted = {}
    for key, text, version in events:
        wanted[key] = text
    rng.shuffle(events)
    for at in range(0, 150, 50):
        source.arrive(events[at : at + 50])
    drain(source, store, run_dir(spark, "checkpoint"))
    check(store, {k: t for k, t in wanted.items() if t})


def test_a_micro_batch_done_again(spark, source, store, monkeypatch):
    """The first attempt buries and fails before texts are stored; the second leaves the same store as one attempt."""
    checkpoint = run_dir(spark, "checkpoint")
    source.arrive([("a", "one", 1), ("b", "two", 1)])
    drain(source, store, checkpoint)
    source.arrive([("a", None, 2, True), ("b", "changed", 2), ("c", "new", 1)])
    whole, failed = EmbeddingStore.upsert, []

    def fails(self, *args, **options):
        if not failed:
            failed.append(1)
            raise RuntimeError("lost")
        return whole(self, *args, **options)

    monkeypatch.setattr(EmbeddingStore, "upsert", fails)
    with pytest.raises(Exception, match="lost"):
        drain(source, store, checkpoint)
    check(store, {"b": "two"})
    drain(source, store, checkpoint)
    check(store, {"b": "changed", "c": "new"})


def test_a_hot_key(spark, source, store):
    source.arrive([("hot", f"text {i}", i) for i in range(2000)] + [("b", "x", 1)])
    drain(source, store, run_dir(spark, "checkpoint"))
    check(store, {"hot": "text 1999", "b": "x"})


def test_null_keys_are_refused(spark):
    events = upsert_events(spark.createDataFrame([(None, "t", 1, False)], SCHEMA), "k", "t", "v", "gone")
    with pytest.raises(Exception, match="must not be NULL"):
        events.collect()


def test_a_store_of_many_writes_is_compacted(spark, source, store):
    for i in range(4):
        source.arrive([("a", f"text {i}", i), (f"k{i}", "own", 1)])
    query = stream_upsert(source.events(), store, ENCODER, run_dir(spark, "checkpoint"), "s", compact_after=2)
    query.awaitTermination()
    assert store.writes() <= 2
    check(store, {"a": "text 3", **{f"k{i}": "own" for i in range(4)}})
