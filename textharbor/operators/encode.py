"""Text to vectors: the encoder contract, a self-contained default, and the Spark operator.

An encoder is any picklable object with

* ``model_id`` - part of the embedding store's key, so vectors of two models never mix,
* ``dim`` - length of every vector,
* ``encode(texts) -> ndarray`` of shape ``(len(texts), dim)`` and L2-normalised rows,
* optionally ``batch_size`` - how many texts one ``encode`` call gets.

A model that is slow to load should load itself lazily in ``encode`` and keep itself in a
module-level variable, so that each Python worker loads it once.
"""

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textharbor.functions.batches import slices

DEFAULT_DIM = 384
DEFAULT_BATCH = 1024


class _WordCodes(dict):
    """word -> (bucket, sign) in one number; forgets everything when it has grown too large."""

    limit = 1 << 18

    def __init__(self, dim):
        super().__init__()
        self.dim = dim

    def __missing__(self, word):
        digits = md5(word.encode("utf-8"), usedforsecurity=False).hexdigest()
        bucket = int(digits[:8], 16) % self.dim
        code = 2 * bucket + (int(digits[8], 16) & 1)
        if len(self) >= self.limit:
            self.clear()
        self[word] = code
        return code


class HashingEncoder:
    """Signed feature hashing of lower-cased words: lexical, not semantic.

    Bucket: the first eight hex digits of the word's MD5 modulo ``dim``. Sign: minus where
    the ninth digit is odd. Counts are summed and, unless ``normalize`` is off, the vector is
    scaled to unit length.
    """

    def __init__(self, dim=DEFAULT_DIM, batch_size=DEFAULT_BATCH, normalize=True):
        self.dim = dim
        self.batch_size = batch_size
        self.normalize = normalize
        self.model_id = f"signed-md5-{dim}" if normalize else f"signed-md5-{dim}-sums"
        self._codes = None

    def __getstate__(self):
        return {**self.__dict__, "_codes": None}

    def encode(self, texts):
        if self._codes is None:
            self._codes = _WordCodes(self.dim)
        codes = self._codes
        per_text = [[codes[w] for w in t.lower().split()] for t in texts]
        counts = np.fromiter(map(len, per_text), np.int64, len(per_text))
        flat = np.fromiter((c for row in per_text for c in row), np.int64, int(counts.sum()))
        slot = np.repeat(np.arange(len(per_text)), counts) * self.dim + (flat >> 1)
        sums = np.bincount(slot, weights=1.0 - 2.0 * (flat & 1), minlength=len(per_text) * self.dim)
        sums = sums.reshape(len(per_text), self.dim)
        if not self.normalize:
            return sums.astype(np.float32)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        return (sums / np.where(length > 0, length, 1.0)).astype(np.float32)


def _vectors_to_arrow(matrix, missing):
    rows, dim = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * dim
    values = pa.array(np.ascontiguousarray(matrix).reshape(-1), pa.float32())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(missing))


def encode(df, text, encoder, out="embedding"):
    """Add ``out`` (``array<float>``): the vector of column ``text``; NULL text gives NULL.

    A narrow operator: no shuffle, one Arrow batch in a Python worker at a time, at most
    ``encoder.batch_size`` texts (and ``SLICE_BYTES``) per model call. Order is irrelevant: rows keep their keys.
    """
    step = getattr(encoder, "batch_size", None) or DEFAULT_BATCH

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in (part for batch in batches for part in slices(batch, step)):
            texts = [t or "" for t in part.to_pylist()]
            vectors = np.asarray(encoder.encode(texts), np.float32)
            if vectors.shape != (len(texts), encoder.dim):
                raise ValueError(f"{encoder.model_id}: expected {(len(texts), encoder.dim)}, got {vectors.shape}")
            missing = part.is_null().to_numpy(zero_copy_only=False)
            vectors = np.where(missing[:, None], np.float32(0), vectors)
            yield _vectors_to_arrow(vectors, missing)

    # Declared so that a filter on the vector is not pushed below it, which would encode twice.
    return df.withColumn(out, embed.asNondeterministic()(F.col(text)))


def nonzero_weights(df, vector="embedding"):
    """One row per non-zero entry: (other columns, bucket, weight)."""
    kept = [c for c in df.columns if c != vector]
    entries = df.select(*kept, F.posexplode(vector).alias("bucket", "weight"))
    return entries.filter(F.col("weight") != 0)
