import pytest

from textharbor import EmbeddingStore, HashingEncoder, as_documents, incremental_embed, run_dir, stream_index

ENCODER = HashingEncoder(32)
SCHEMA = "k string, t string"


class Source:
    """A folder of Parquet files that arrive one after the other."""

    def __init__(self, spark):
        self.spark, self.path = spark, run_dir(spark, "arrivals")
        spark.createDataFrame([], SCHEMA).write.parquet(self.path)

    def arrive(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def docs(self):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)
        return as_documents(stream, "k", "t")


@pytest.fixture
def source(spark):
    return Source(spark)


@pytest.fixture
def store(spark):
    return EmbeddingStore(spark, run_dir(spark, "store"), ENCODER.model_id)


def drain(source, store, checkpoint):
    stream_index(source.docs(), store, ENCODER, checkpoint, "s").awaitTermination()


def rows_by_seq(spark, store):
    return [e["rows"] for e in store._entries()]


def content(store):
    return {r.doc_id: (r.content_hash, r.embedding) for r in store.scan().collect()}


def test_unchanged_changed_and_new(spark, source, store):
    checkpoint = run_dir(spark, "checkpoint")
    source.arrive([(f"k{i}", f"text {i}") for i in range(10)])
    drain(source, store, checkpoint)
    second = [(f"k{i}", f"text {i}") for i in range(4)] + [("k5", "changed")] + [(f"n{i}", f"new {i}") for i in range(5)]
    source.arrive(second)
    drain(source, store, checkpoint)
    assert rows_by_seq(spark, store) == [10, 6] and store.scan().count() == 15


def test_stream_equals_batch(spark, source, store):
    rows = [(f"k{i}", f"some text {i}") for i in range(20)]
    for start in (0, 7, 14):
        source.arrive(rows[start : start + 7])
    drain(source, store, run_dir(spark, "checkpoint"))
    other = EmbeddingStore(spark, run_dir(spark, "store"), ENCODER.model_id)
    incremental_embed(as_documents(spark.createDataFrame(rows, SCHEMA), "k", "t"), other, ENCODER)
    assert content(store) == content(other)


def test_a_stored_batch_is_skipped_when_replayed(spark, source, store):
    source.arrive([("a", "one"), ("b", "two")])
    drain(source, store, run_dir(spark, "checkpoint"))
    before, log = content(store), rows_by_seq(spark, store)
    drain(source, store, run_dir(spark, "checkpoint"))  # a lost checkpoint: the same batch numbers again
    assert content(store) == before and rows_by_seq(spark, store) == log


def test_a_batch_that_failed_midway_is_done_again(spark, source, store, monkeypatch):
    source.arrive([("a", "one"), ("b", "two")])
    checkpoint = run_dir(spark, "checkpoint")
    commit = EmbeddingStore._commit
    monkeypatch.setattr(EmbeddingStore, "_commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception):
        drain(source, store, checkpoint)
    assert store.scan().count() == 0
    monkeypatch.setattr(EmbeddingStore, "_commit", commit)
    drain(source, store, checkpoint)
    assert set(content(store)) == {"a", "b"}


def test_text_files_as_a_stream(spark, store, tmp_path):
    from textharbor.sources.corpus import text_corpus_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Alpha <b>one</b>")
    (folder / "b.txt").write_text("   ")
    checkpoint = run_dir(spark, "checkpoint")

    def run():
        stream_index(text_corpus_stream(spark, str(folder)), store, ENCODER, checkpoint, "files").awaitTermination()

    run()
    assert set(content(store)) == {"a"}
    (folder / "c.txt").write_text("gamma")
    run()
    assert set(content(store)) == {"a", "c"}
