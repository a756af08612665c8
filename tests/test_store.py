import datetime as dt

import pytest
from pyspark.sql import functions as F

from textharbor import EmbeddingStore, run_dir

ROW = "doc_id string, embedding array<float>, content_hash string, metadata map<string,string>"


@pytest.fixture
def store(spark):
    return EmbeddingStore(spark, run_dir(spark, "store"), "m")


def rows(spark, *items):
    return spark.createDataFrame([(k, v, h, m) for k, v, h, m in items], ROW)


def content(df):
    return {r.doc_id: (r.embedding, r.content_hash) for r in df.collect()}


def test_round_trip(spark, store):
    written = store.upsert(
        rows(spark, ("a", [1.0] * 384, "hash1", {"filename": "f"}), ("b", [0.5], "hash2", {}), ("c", [0.0], "hash3", None)),
        updated_at="2024-01-01 10:00:00",
    )
    assert written[:3] == (1, 3, 3)
    got = {r.doc_id: r for r in store.scan().collect()}
    assert got["a"].embedding == [1.0] * 384 and got["a"].content_hash == "hash1" and got["a"].model_id == "m"
    assert got["a"].metadata == {"filename": "f"} and got["b"].metadata is None and got["c"].metadata is None
    assert got["a"].updated_at == dt.datetime(2024, 1, 1, 10)


def test_empty_store(spark, store):
    assert store.scan().count() == 0 and store.get(["a"]).count() == 0 and store.key_bytes() == 0
    assert store.clear() == 0 and store.delete(["a"]) == 0 and store.compact() == 0
    stats = store.stats().first()
    assert (stats.total_entries, stats.latest_update, stats.size_bytes) == (0, None, 0)


def test_valid_stale_and_missing(spark, store):
    from textharbor import label_hits

    store.upsert(rows(spark, ("a", [1.0], "new", None), ("b", [1.0], "old", None)))
    docs = spark.createDataFrame([("a", "new"), ("b", "new"), ("c", "new")], "doc_id string, content_hash string")
    assert {r.doc_id: r.hit for r in label_hits(docs, store.keys()).collect()} == {"a": True, "b": False, "c": False}


def test_replacing_a_row(spark, store):
    store.upsert(rows(spark, ("a", [1.0], "hash1", None), ("b", [2.0], "hash2", None)))
    store.upsert(rows(spark, ("a", [0.0], "hash9", None)))
    assert content(store.scan()) == {"a": ([0.0], "hash9"), "b": ([2.0], "hash2")}


def test_upserting_twice_is_upserting_once(spark, store):
    batch = rows(spark, ("a", [1.0], "h", None), ("b", [2.0], "h", None))
    store.upsert(batch)
    once = content(store.scan())
    store.upsert(batch)
    assert content(store.scan()) == once


def test_get(spark, store):
    store.upsert(rows(spark, ("a", [1.0], "h", None), ("b", [2.0], "h", None)))
    assert set(content(store.get(["a", "zz"]))) == {"a"}
    assert set(content(store.get(spark.createDataFrame([("b",), ("b",), ("zz",)], "doc_id string")))) == {"b"}


def test_by_hash_takes_the_smallest_key(spark, store):
    store.upsert(rows(spark, ("b", [2.0], "h", None), ("a", [1.0], "h", None), ("c", [3.0], "g", None)))
    found = store.by_hash(spark.createDataFrame([("h",), ("h",), ("none",)], "content_hash string"))
    assert content(found) == {"a": ([1.0], "h")}


def test_delete(spark, store):
    store.upsert(rows(spark, ("a", [1.0], "h", None), ("b", [2.0], "h", None)))
    assert store.delete(["a", "zz"]) == 1
    assert store.delete(["a"]) == 0
    assert set(content(store.scan())) == {"b"}
    store.upsert(rows(spark, ("a", [5.0], "h5", None)))
    assert content(store.scan())["a"] == ([5.0], "h5")


def test_clear(spark, store):
    store.upsert(rows(spark, ("a", [1.0], "h", None), ("b", [2.0], "h", None)))
    assert store.clear() == 2
    assert store.scan().count() == 0
    store.upsert(rows(spark, ("c", [1.0], "h", None)))
    assert set(content(store.scan())) == {"c"}


def test_compact_keeps_rows_and_times(spark, store):
    store.upsert(rows(spark, ("a", [1.0], "h", None), ("b", [2.0], "h", None)), "2024-01-01 00:00:00")
    store.upsert(rows(spark, ("a", [3.0], "g", {"x": "y"})), "2024-02-01 00:00:00")
    store.delete(["b"])
    before = sorted(store.scan().collect())
    assert store.compact() == 1
    assert sorted(store.scan().collect()) == before
    assert store.upsert(rows(spark, ("b", [4.0], "k", None))).seq > 4
    assert set(content(store.scan())) == {"a", "b"}


def test_vacuum(spark, store):
    store.upsert(rows(spark, ("a", [1.0], "h", None), ("b", [2.0], "h", None)))
    assert store.vacuum(spark.createDataFrame([("a",)], "doc_id string")) == 1
    assert set(content(store.scan())) == {"a"}


def test_stats(spark, store):
    store.upsert(rows(spark, ("a", [1.0], "h", None)), "2024-01-01 00:00:00")
    store.upsert(rows(spark, ("b", [1.0], "h", None)), "2024-03-01 00:00:00")
    stats = store.stats().first()
    assert (stats.total_entries, stats.latest_update, stats.path) == (2, dt.datetime(2024, 3, 1), store.path)
    assert stats.size_bytes > 0


def test_last_write_of_a_batch_wins(spark, store):
    batch = rows(spark, *[("a", [float(i)], f"h{i}", None) for i in range(50)], ("b", [1.0], "h", None))
    batch = batch.withColumn("n", F.substring("content_hash", 2, 9).try_cast("int"))
    assert store.upsert(batch.repartition(4), order_by="n")[:3] == (1, 51, 2)
    assert content(store.scan()) == {"a": ([49.0], "h49"), "b": ([1.0], "h")}


def test_repeated_keys_without_order_are_refused(spark, store):
    store.upsert(rows(spark, ("a", [1.0], "h", None)))
    with pytest.raises(ValueError, match="order_by"):
        store.upsert(rows(spark, ("b", [1.0], "h", None), ("b", [2.0], "h", None)))
    assert set(content(store.scan())) == {"a"}  # nothing of the refused batch is visible


@pytest.mark.parametrize("row", [(None, [1.0], "h", None), ("a", None, "h", None), ("a", [1.0], None, None)])
def test_missing_values_are_refused(spark, store, row):
    with pytest.raises(Exception, match="NULL"):
        store.upsert(rows(spark, row))
    assert store.scan().count() == 0


def test_models_do_not_mix(spark, store):
    other = EmbeddingStore(spark, store.path, "other")
    store.upsert(rows(spark, ("a", [1.0], "h", None)))
    other.upsert(rows(spark, ("a", [9.0], "h", None)))
    assert content(store.scan()) == {"a": ([1.0], "h")} and content(other.scan()) == {"a": ([9.0], "h")}
    other.clear()
    assert store.scan().count() == 1 and other.scan().count() == 0


def test_number_keys_keep_their_type(spark):
    from pyspark.sql import types as T

    store = EmbeddingStore(spark, run_dir(spark, "store"), "m", key_type=T.LongType())
    assert store.scan().schema["doc_id"].dataType == T.LongType()
    store.upsert(spark.createDataFrame([(7, [1.0], "h")], "doc_id bigint, embedding array<float>, content_hash string"))
    store.upsert(spark.createDataFrame([(7, [2.0], "g")], "doc_id bigint, embedding array<float>, content_hash string"))
    assert content(store.scan()) == {7: ([2.0], "g")} and content(store.get([7])) == {7: ([2.0], "g")}


def test_keys_do_not_read_vectors(spark, store):
    store.upsert(rows(spark, ("a", [1.0], "h", None)))
    store.upsert(rows(spark, ("a", [2.0], "g", None)))
    plan = store.keys()._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and not any("embedding" in line.split("ReadSchema")[1] for line in schemas)


def test_random_history_equals_a_dict(spark, store):
    import random

    rng = random.Random(5)
    want = {}
    for step in range(8):
        action = rng.choice(["put", "put", "put", "drop", "compact"])
        keys = rng.sample("abcdefgh", 3)
        if action == "put":
            new = {k: ([float(step)], f"h{step}") for k in keys}
            store.upsert(rows(spark, *[(k, v, h, None) for k, (v, h) in new.items()]))
            want.update(new)
        elif action == "drop":
            assert store.delete(keys) == len(set(keys) & set(want))
            want = {k: v for k, v in want.items() if k not in keys}
        else:
            assert store.compact() == len(want)
        assert content(store.scan()) == want


def test_empty_writes_leave_no_log_row(spark, store):
    store.upsert(rows(spark, ("a", [1.0, 0.0], "h", None)))
    state = store.state()
    store.upsert(rows(spark, ("a", [1.0, 0.0], "h", None)).limit(0), stream_id="s", batch_id=3)
    assert store.state() == state and not store.committed("s", 3)
    store.upsert(rows(spark, ("b", [1.0, 0.0], "h", None)), stream_id="s", batch_id=4)
    assert store.committed("s", 4) and not store.committed("s", 5)


def test_a_used_number_is_refused(spark, store):
    store.upsert(rows(spark, ("a", [1.0, 0.0], "h", None)))
    with pytest.raises(ValueError, match="already"):
        store._commit(1, "batch", rows=1)


def test_only_rows_after_the_last_base_are_read(spark, store):
    for key in "abc":
        store.upsert(rows(spark, (key, [1.0, 0.0], "h", None)))
    store.compact()
    store.upsert(rows(spark, ("d", [1.0, 0.0], "h", None)))
    assert len(store._entries()) == 2 and store.scan().count() == 4
