import sys

import numpy as np
import plain
import pytest
from paths import DATA
from pyspark import cloudpickle
from pyspark.sql import functions as F

from textharbor import HashingEncoder, encode, nonzero_weights
from textharbor.operators.encode import _WordCodes


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module


class LengthEncoder:
    """A stand-in for a user's model: one number per text."""

    model_id, dim, batch_size = "length", 1, 2

    def encode(self, texts):
        assert len(texts) <= self.batch_size
        return np.array([[float(len(t))] for t in texts])


class BrokenEncoder(LengthEncoder):
    def encode(self, texts):
        return np.zeros((len(texts), 3))


def test_hashing_equals_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").repartition(3)
    rows = encode(docs, "text", HashingEncoder(64)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.allclose(r.embedding, plain.hashed(r.text, 64), atol=1e-6)


def test_unit_length_and_default_dim(spark):
    vector = HashingEncoder().encode(["some words here"])[0]
    assert vector.shape == (384,) and vector.dtype == np.float32 and abs(np.linalg.norm(vector) - 1) < 1e-6


def test_no_texts_and_texts_without_words():
    encoder = HashingEncoder(8)
    assert encoder.encode([]).shape == (0, 8)
    assert not encoder.encode(["", "  "]).any()


def test_null_text_gives_null(spark):
    rows = spark.createDataFrame([(1, None), (2, "a")], "k int, t string")
    got = {r.k: r.embedding for r in encode(rows, "t", HashingEncoder(4)).collect()}
    assert got[1] is None and len(got[2]) == 4


def test_own_encoder_gets_small_batches(spark):
    rows = spark.range(7).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t")).coalesce(1)
    assert {r.id: r.embedding for r in encode(rows, "t", LengthEncoder()).collect()} == {i: [float(i)] for i in range(7)}


def test_wrong_shape_is_refused(spark):
    with pytest.raises(Exception, match="expected"):
        encode(spark.createDataFrame([("a",)], "t string"), "t", BrokenEncoder()).collect()


def test_no_rows(spark):
    assert encode(spark.createDataFrame([], "t string"), "t", HashingEncoder(4)).collect() == []


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(_WordCodes, "limit", 10)
    codes = _WordCodes(16)
    first = codes["word"]
    for i in range(100):
        codes[f"w{i}"]
    assert len(codes) <= 10 and codes["word"] == first


def test_a_filter_on_the_vector_does_not_encode_twice(spark):
    df = encode(spark.createDataFrame([("a",)], "t string"), "t", HashingEncoder(4)).filter(F.size("embedding") > 0)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_unused_vectors_are_not_computed(spark):
    df = encode(spark.createDataFrame([("a",)], "t string"), "t", HashingEncoder(4))
    assert "ArrowEvalPython" not in df.groupBy().count()._jdf.queryExecution().executedPlan().toString()


def test_nonzero_weights(spark):
    rows = spark.createDataFrame([(1, [0.0, 2.0, 0.0, -1.0])], "k int, embedding array<float>")
    assert sorted(map(tuple, nonzero_weights(rows).collect())) == [(1, 1, 2.0), (1, 3, -1.0)]


def test_sums_without_scaling(spark):
    raw, unit = HashingEncoder(16, normalize=False), HashingEncoder(16)
    sums = raw.encode(["one two two three"])[0]
    assert raw.model_id != unit.model_id and np.abs(sums).sum() in (2, 4)
    assert np.allclose(sums / np.linalg.norm(sums), unit.encode(["one two two three"])[0])
