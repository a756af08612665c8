"""Text, vector and search functions for use from SQL.

``register_sql`` makes them known to a session. Text and score functions are SQL functions, so that they are expanded
into the plan; entities and encoding are Arrow functions; ``nearest`` is a table function over a table of vectors that
the caller deals to partitions.
"""

import copy
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from textharbor.functions import cleaning
from textharbor.functions.batches import give_back, parts
from textharbor.functions.scores import RANK_SCALE
from textharbor.functions.text import LABEL_LENGTH, LISTING_LENGTH, MIN_KEYWORD, PREVIEW_LENGTH
from textharbor.operators.encode import HashingEncoder, _vectors_to_arrow
from textharbor.operators.topk import _Best


def _literal(pattern):
    """A regular expression as a raw SQL string."""
    return f"r'{pattern}'"


_SPACES = _literal(rf"(?![!-~])(?:{cleaning.WS_BUT_SPACE}{cleaning.WS}*| {cleaning.WS}+)")

#: Fixed order: a function may use those above it.
FUNCTIONS = (
    ("text_normalize(x STRING)", "STRING", f"trim(regexp_replace(x, {_SPACES}, ' '))"),
    ("text_strip_tags(x STRING)", "STRING", f"regexp_replace(x, {_literal(cleaning.TAG)}, ' ')"),
    ("text_entities(x STRING)", "STRING", "coalesce(text_unescaped(CASE WHEN contains(x, '&') THEN x END), x)"),
    ("text_strip_urls(x STRING)", "STRING", f"regexp_replace(x, {_literal(cleaning.LINK)}, ' ')"),
    ("text_clean(x STRING)", "STRING", "text_normalize(text_strip_urls(text_entities(text_strip_tags(lower(x)))))"),
    ("text_hash(x STRING)", "STRING", "sha2(x, 256)"),
    ("text_words(x STRING)", "ARRAY<STRING>", f"filter(split(lower(x), {_literal(cleaning.WS + '+')}), w -> w <> '')"),
    ("text_keywords(x STRING)", "ARRAY<STRING>",
     f"array_distinct(filter(text_words(x), w -> length(w) >= {MIN_KEYWORD} AND w rlike {_literal(chr(94) + chr(92) + 'p{L}+' + chr(92) + 'z')}))"),
    ("text_overlap(a ARRAY<STRING>, b ARRAY<STRING>)", "DOUBLE",
     "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE double(size(array_intersect(a, b))) / size(array_union(a, b)) END"),
    ("text_preview(x STRING)", "STRING",
     f"CASE WHEN length(x) <= {PREVIEW_LENGTH} THEN x"
     f" ELSE concat(regexp_replace(substring(x, 1, {PREVIEW_LENGTH - 3}), {_literal(' [^ ]*' + chr(92) + 'z')}, ''), '...') END"),
    ("text_listing(x STRING)", "STRING", f"CASE WHEN length(x) > {LISTING_LENGTH} THEN concat(substring(x, 1, {LISTING_LENGTH}), '...') ELSE x END"),
    ("text_label(x STRING)", "STRING", f"substring(x, 1, {LABEL_LENGTH})"),
    ("vector_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>)", "DOUBLE",
     "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (t, x) -> t + x)"),
    ("vector_norm(v ARRAY<FLOAT>)", "DOUBLE", "sqrt(aggregate(v, 0D, (t, x) -> t + double(x) * double(x)))"),
    ("vector_unit(v ARRAY<FLOAT>)", "ARRAY<FLOAT>",
     "get(transform(array(vector_norm(v)), n -> CASE WHEN n > 0 THEN transform(v, x -> float(double(x) / n)) ELSE v END), 0)"),
    ("vector_cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>)", "DOUBLE", "vector_dot(vector_unit(a), vector_unit(b))"),
    ("score_rank(s DOUBLE)", "BIGINT", f"floor(s * {RANK_SCALE:.0f}D + 0.5D)"),
    ("score_length_normalized(s DOUBLE, n INT)", "DOUBLE", "CASE WHEN n > 0 THEN s * (1D / (1D + log1p(n / 1000D))) ELSE s END"),
)


def _pack(vector):
    """The bytes of a vector's 32-bit numbers, deflated where that is shorter, so that the length tells which."""
    raw = vector.astype("<f4").tobytes()
    return min(zlib.compress(raw, 1), raw, key=len)


def _unpack(packed, dim):
    """The numbers of a packed vector, as bytes; nothing if they are not ``dim``."""
    if packed is None or len(packed) >= 4 * dim:
        return packed if packed is not None and len(packed) == 4 * dim else b""
    try:
        raw = zlib.decompress(packed, bufsize=4 * dim)
    except zlib.error:
        return b""
    return raw if len(raw) == 4 * dim else b""


class Nearest:
    """``nearest(TABLE(blocks) PARTITION BY (...), queries, k)``: of every partition the best ``k`` vectors of each query.

    The table holds blocks, a list of keys and a list of their vectors in its first two columns, so that a call from the
    engine brings thousands of vectors; a block is what one row can hold. Vectors are arrays of floats or, for many of
    them, ``text_embed_packed`` ones: the engine hands a task's blocks over many at a time, and as objects their numbers
    take ten times the memory. ``queries`` is a JSON array of objects with
    ``query_id`` and ``q``, a bounded set that every call is handed. Rows out are (query_id STRING, key, score DOUBLE).
    """

    @staticmethod
    def analyze(blocks: AnalyzeArgument, queries: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        kinds = [f.dataType for f in blocks.dataType][:2] if blocks.isTable else []
        vectors = ("array<array<float>>", "array<binary>")
        if len(kinds) < 2 or not isinstance(kinds[0], T.ArrayType) or kinds[1].simpleString() not in vectors:
            raise ValueError("nearest takes a table with an array of keys and an array of float vectors first")
        if k.value is not None and k.value < 1:
            raise ValueError("k must be at least 1")
        schema = T.StructType([
            T.StructField("query_id", T.StringType()), T.StructField("key", kinds[0].elementType), T.StructField("score", T.DoubleType())
        ])
        return AnalyzeResult(schema=schema)

    def __init__(self):
        self.best = None

    def eval(self, block, queries, k):
        if self.best is None and (asked := json.loads(queries or "[]")):
            self.ids = [str(q["query_id"]) for q in asked]
            self.best = _Best(np.array([q["q"] for q in asked], np.float32), k)
        if self.best is None or not block[0]:
            return
        dim = self.best.queries.shape[1]
        packed = isinstance(block[1][0] if block[1] else None, (bytes, bytearray))
        found, length = ([_unpack(v, dim) for v in block[1]], 4 * dim) if packed else (block[1], dim)
        if len(block[0]) != len(found) or any(v is None or len(v) != length for v in found):
            raise ValueError(f"a block needs a vector of {dim} numbers for every key")
        vectors = np.frombuffer(b"".join(found), "<f4").reshape(-1, dim) if packed else np.array(found, np.float32)
        if not np.isfinite(vectors).all():
            raise ValueError("a vector holds NaN or an infinite number")
        self.best.add(pa.array(block[0]), vectors)

    def terminate(self):
        if self.best is not None:
            self.best.prune()
            if self.best.kept is not None:
                for hit in self.best.kept.to_pylist():
                    yield self.ids[hit["q"]], hit["key"], hit["score"]
            self.best = None
            give_back()


def register_sql(spark, encoder=None):
    """Make the functions of this module known to the session.

    ``text_embed`` uses ``encoder`` (feature hashing); ``text_embed_packed`` gives the same vector as the bytes of its
    32-bit numbers, little-endian, deflated (zlib) where that is shorter.
    """
    encoder = encoder or HashingEncoder()

    def embedded(batches):
        own = copy.copy(encoder)  # with what it remembers of this task's words
        for part in parts(batches):
            vectors = np.asarray(own.encode([t or "" for t in part.to_pylist()]), np.float32)
            missing = part.is_null().to_numpy(zero_copy_only=False)
            del part  # or the batch it is of would stay while the next one is read
            yield vectors, missing
        del own
        give_back()

    @F.arrow_udf("array<float>")
    def text_embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors, missing in embedded(batches):
            yield _vectors_to_arrow(np.where(missing[:, None], np.float32(0), vectors), missing)

    @F.arrow_udf("binary")
    def text_embed_packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors, missing in embedded(batches):
            yield pa.array([None if m else _pack(v) for v, m in zip(vectors, missing)], pa.binary())

    @F.arrow_udf("string")
    def text_unescaped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts(batches):
            done = cleaning.unescaped(part)
            del part
            yield done
        give_back()

    spark.udf.register("text_embed", text_embed)
    spark.udf.register("text_embed_packed", text_embed_packed)
    spark.udf.register("text_unescaped", text_unescaped)
    for signature, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
    spark.udtf.register("nearest", F.udtf(Nearest))
