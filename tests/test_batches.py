import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textharbor import encode
from textharbor.functions import batches, cleaning


def test_a_call_of_the_encoder_is_bounded_in_bytes(spark):
    class CallBytes:
        """Gives every text the bytes of all texts of its call."""

        model_id, dim, batch_size = "call-bytes", 1, 1024

        def encode(self, texts):
            return np.full((len(texts), 1), sum(len(t.encode()) for t in texts), np.float32)

    rows = spark.range(60).coalesce(1).withColumn("text", F.when(F.col("id") != 7, F.repeat(F.lit("x"), 100_000)))
    got = {r.id: r.v for r in encode(rows, "text", CallBytes(), "v").collect()}
    assert len(got) == 60 and got[7] is None
    assert 0 < max(v[0] for v in got.values() if v) <= batches.SLICE_BYTES


def test_slices_keep_order_nulls_and_texts_beyond_the_limit():
    texts = pa.array(["a" * 30, None, "b", "", "c" * 5, None] * 50).slice(1)
    parts = list(batches.slices(texts, rows=7, n_bytes=20))
    assert [t for p in parts for t in p.to_pylist()] == texts.to_pylist()
    assert all(0 < len(p) <= 7 for p in parts)
    assert all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= 20 for p in parts)
    assert list(batches.slices(texts.slice(0, 0))) == []
    assert cleaning.unescaped(texts.slice(0, 0)).to_pylist() == []
    assert cleaning.unescaped(pa.array(["&amp;", None])).to_pylist() == ["&", None]


def test_a_batch_is_let_go_before_the_next_is_asked_for():
    before = pa.total_allocated_bytes()

    def arriving():
        for _ in range(3):
            assert pa.total_allocated_bytes() - before < 1 << 20
            yield pa.array(["x" * 300] * 5000)

    found = []
    for part in batches.parts(arriving(), rows=3000):
        found.append(len(part))
        del part
    assert found == [3000, 2000] * 3
    batches.give_back()
