import numpy as np
import pytest
from paths import DATA
from pyspark import cloudpickle
from pyspark.sql import functions as F

import textharbor.operators.encode as encode_module
from textharbor import (
    EmbeddingStore,
    HashingEncoder,
    as_documents,
    engine_stats,
    incremental_embed,
    index_integrity,
    index_job,
    list_documents,
    load_index,
    run_dir,
    search,
)

ENCODER = HashingEncoder(64)
OLD, NEW = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


@pytest.fixture
def store(spark):
    return EmbeddingStore(spark, run_dir(spark, "store"), ENCODER.model_id)


def docs(spark, texts, **extra):
    rows = [(k, t) for k, t in texts.items()]
    return as_documents(spark.createDataFrame(rows, "k string, t string"), "k", "t", **extra)


def updates(store):
    return {r.doc_id: r.updated_at.month for r in store.scan().collect()}


TEXTS = {"a": "alpha one", "b": "beta two", "c": "gamma three"}


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_only_new_and_changed_documents_are_encoded(spark, store, limit):
    first = incremental_embed(docs(spark, TEXTS), store, ENCODER, updated_at=OLD, broadcast_bytes=limit)
    assert first.misses == 3
    changed = {**TEXTS, "b": "beta changed", "d": "delta"}
    second = incremental_embed(docs(spark, changed), store, ENCODER, updated_at=NEW, broadcast_bytes=limit)
    assert second.misses == 2
    assert updates(store) == {"a": 1, "b": 2, "c": 1, "d": 2}
    got = {r.doc_id: r.embedding for r in second.vectors.collect()}
    assert set(got) == set(changed)
    for key, text in changed.items():
        assert np.allclose(got[key], ENCODER.encode([text])[0])


def test_repeat_run_encodes_nothing(spark, store):
    incremental_embed(docs(spark, TEXTS), store, ENCODER)
    again = incremental_embed(docs(spark, TEXTS), store, ENCODER)
    assert again.misses == 0 and again.vectors.count() == 3


def test_markup_only_edits_are_hits(spark, store):
    incremental_embed(docs(spark, TEXTS), store, ENCODER)
    marked = {k: f"<p>{t.upper()}</p>\n" for k, t in TEXTS.items()}
    assert incremental_embed(docs(spark, marked), store, ENCODER).misses == 0


def test_force_encodes_everything(spark, store):
    incremental_embed(docs(spark, TEXTS), store, ENCODER, updated_at=OLD)
    forced = incremental_embed(docs(spark, TEXTS), store, ENCODER, force=True, updated_at=NEW)
    assert forced.misses == 3 and forced.vectors.count() == 3 and set(updates(store).values()) == {2}


def test_removed_documents_stay_stored_but_leave_the_result(spark, store):
    incremental_embed(docs(spark, TEXTS), store, ENCODER)
    rest = incremental_embed(docs(spark, {"a": TEXTS["a"]}), store, ENCODER)
    assert [r.doc_id for r in rest.vectors.collect()] == ["a"] and store.scan().count() == 3


def test_equal_texts_are_not_encoded_again_when_asked(spark, store):
    class Counting(HashingEncoder):
        def encode(self, texts):
            assert "alpha one" not in texts, "a stored text was encoded again"
            return super().encode(texts)

    cloudpickle.register_pickle_by_value(encode_module)
    incremental_embed(docs(spark, TEXTS), store, ENCODER, updated_at=OLD)
    for limit in (64 << 20, 0):
        more = {**TEXTS, f"x{limit}": "alpha one", f"y{limit}": f"new {limit}"}
        got = incremental_embed(
            docs(spark, more), store, Counting(64), reuse="content", updated_at=NEW, broadcast_bytes=limit
        )
        vectors = {r.doc_id: r.embedding for r in got.vectors.collect()}
        assert set(vectors) == set(more) and vectors[f"x{limit}"] == vectors["a"] and got.misses == 2
    with pytest.raises(Exception, match="encoded again"):
        incremental_embed(docs(spark, {"z": "alpha one"}), store, Counting(64))


def test_last_version_of_a_repeated_key_wins(spark, store):
    rows = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "only", 1)], "k string, t string, v int")
    versions = as_documents(rows, "k", "t", keep=["v"])
    with pytest.raises(ValueError, match="order_by"):
        incremental_embed(versions, store, ENCODER)
    got = incremental_embed(versions, store, ENCODER, order_by="v")
    vectors = {r.doc_id: r.embedding for r in got.vectors.collect()}
    assert np.allclose(vectors["a"], ENCODER.encode(["new"])[0]) and set(vectors) == {"a", "b"}


def test_another_model_is_refused(spark, store):
    with pytest.raises(ValueError, match="encoder makes"):
        incremental_embed(docs(spark, TEXTS), store, HashingEncoder(32))


def test_hits_and_misses_are_the_corpus(spark, store):
    from textharbor.operators import lookup

    corpus = as_documents(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text")
    known = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").select("doc_id")
    store.key_type = corpus.schema["doc_id"].dataType
    incremental_embed(corpus.join(known, "doc_id", "left_semi"), store, ENCODER)
    for size in (None, store.key_bytes()):
        hits = lookup.cached(corpus, store.keys(), size).count()
        misses = lookup.uncached(corpus, store.keys(), size).count()
        ratio = lookup.hit_ratio(corpus, store.keys(), size).first()
        assert hits == store.scan().count() and hits + misses == corpus.count()
        assert tuple(ratio) == (hits, misses, hits + misses)


def test_lookup_by_hash_with_a_hot_text(spark):
    from textharbor import lookup_by_hash

    keys = spark.range(900).select("id", F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("h"))
    rows = keys.select(F.col("id").alias("doc_id"), F.col("h").alias("content_hash"))
    for size in (0, None):
        got = {r.doc_id: r.cached_id for r in lookup_by_hash(rows, rows, size).collect()}
        assert got == {i: 0 if i < 300 else i for i in range(900)}


def test_index_job_and_search(spark, store):
    root = run_dir(spark, "index")
    cold = index_job(docs(spark, TEXTS), store, ENCODER, root, updated_at=OLD).first()
    assert tuple(cold) == (3, 0, 3, 3)
    warm = index_job(docs(spark, {**TEXTS, "d": "delta four"}), store, ENCODER, root, updated_at=NEW).first()
    assert tuple(warm) == (4, 3, 1, 4)
    forced = index_job(docs(spark, {"a": TEXTS["a"]}), store, ENCODER, root, force=True).first()
    assert tuple(forced) == (1, 0, 1, 4)
    vectors, shown = load_index(spark, root)
    assert vectors.count() == shown.count() == 1
    queries = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    assert [h.doc_id for h in search(queries, vectors, shown, ENCODER).collect()] == ["a"]


def test_failed_run_leaves_the_index_as_it_was(spark, store):
    root = run_dir(spark, "index")
    index_job(docs(spark, TEXTS), store, ENCODER, root)
    broken = docs(spark, {"a": "changed"}).withColumn("content", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        index_job(broken, store, ENCODER, root)
    assert load_index(spark, root)[0].count() == 3 and store.scan().count() == 3


def test_empty_corpus(spark, store):
    report = index_job(docs(spark, {"a": " "}), store, ENCODER, run_dir(spark, "index")).first()
    assert tuple(report) == (0, 0, 0, 0)


def test_reports(spark, store, science):
    embedded = incremental_embed(science, store, ENCODER)
    stats = engine_stats(embedded.vectors, store).first()
    assert (stats.indexed_documents, stats.cached_embeddings, stats.index_type, stats.index_loaded) == (3, 3, "exact", True)
    assert stats.cache_size_bytes > 0
    listing = list_documents(science).collect()
    assert {r.doc_id for r in listing} == {"physics", "biology", "chemistry"}
    assert all(r.total == 3 and r.length == len(r.preview) for r in listing)


def test_integrity(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",)], "doc_id string")
    right = spark.createDataFrame([("b",), ("c",)], "doc_id string")
    assert tuple(index_integrity(left, right).first()) == (3, 2, 1, 1, 1)


def test_vectors_that_are_not_unit_vectors_are_scaled_for_the_index(spark):
    raw = HashingEncoder(16, normalize=False)
    store, root = EmbeddingStore(spark, run_dir(spark, "store"), raw.model_id), run_dir(spark, "index")
    index_job(docs(spark, TEXTS), store, raw, root, normalized=False).collect()
    for r in load_index(spark, root)[0].collect():
        assert np.allclose(r.embedding, HashingEncoder(16).encode([TEXTS[r.doc_id]])[0])
    assert any(abs(x) > 1 - 1e-9 for r in store.scan().collect() for x in r.embedding)


def test_index_job_takes_the_last_version(spark, store):
    rows = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "k string, t string, v int")
    versions = as_documents(rows, "k", "t", keep=["v"])
    root = run_dir(spark, "index")
    assert tuple(index_job(versions, store, ENCODER, root, order_by="v").first()) == (1, 0, 1, 1)
    assert tuple(index_job(versions, store, ENCODER, root, order_by="v").first()) == (1, 1, 0, 1)
    assert load_index(spark, root)[1].first().preview == "new"


def test_removed_documents_leave_the_index(spark, store):
    root = run_dir(spark, "index")
    index_job(docs(spark, TEXTS), store, ENCODER, root).collect()
    report = index_job(docs(spark, {"a": TEXTS["a"], "x": "new"}), store, ENCODER, root).first()
    assert tuple(report) == (2, 1, 1, 4)
    assert {r.doc_id for r in load_index(spark, root)[0].collect()} == {"a", "x"}


def folders(spark, root):
    from textharbor.sources.index import newest_snapshot

    return newest_snapshot(spark, root).vectors


def test_a_run_without_changes_copies_no_vectors(spark, store):
    root = run_dir(spark, "index")
    index_job(docs(spark, TEXTS), store, ENCODER, root).collect()
    first = folders(spark, root)
    assert tuple(index_job(docs(spark, TEXTS), store, ENCODER, root).first()) == (3, 3, 0, 3)
    assert folders(spark, root) == first and load_index(spark, root)[1].count() == 3
    fewer = {k: TEXTS[k] for k in ("a", "b")}
    assert tuple(index_job(docs(spark, fewer), store, ENCODER, root).first()) == (2, 2, 0, 3)
    assert {r.doc_id for r in load_index(spark, root)[0].collect()} == {"a", "b"}
    assert tuple(index_job(docs(spark, fewer), store, ENCODER, root).first()) == (2, 2, 0, 3)
    second = folders(spark, root)
    store.upsert(store.scan().select("doc_id", "embedding", "content_hash"))  # the store has moved on
    index_job(docs(spark, fewer), store, ENCODER, root).collect()
    assert folders(spark, root) != second and load_index(spark, root)[0].count() == 2
