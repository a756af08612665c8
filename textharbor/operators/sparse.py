"""Sparse vectors of very many dimensions: encoding, an inverted index, and exact top-k by MaxScore.

Vectors are lists of (bucket, weight). The index deals documents to parts of bounded size; a part holds, sorted by
bucket, a list of postings per bucket with the largest and the smallest weight in it. For a query, a bucket can add at
most its weight times one of these. Buckets are taken in falling order of that bound. Once what the remaining ones can
add together does not lift a document without any of the earlier ones to the k-th score, only documents seen already
are looked up in the rest, and only those that may still get there. Nothing is approximate.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.functions.batches import slices
from textharbor.functions.scores import RANK_SCALE, rank_score
from textharbor.operators.encode import _WordCodes
from textharbor.session import BROADCAST_BYTES, run_dir

SPARSE_DIM = 1 << 18
#: Documents and entries of a part; a part of one document may have more entries.
PART_ROWS = 8192
PART_ENTRIES = 1 << 20

ENTRIES = "array<struct<bucket: int, weight: float>>"


class SparseHashingEncoder:
    """Signed feature hashing as in ``HashingEncoder``, with only the entries that are not zero.

    ``encode(texts)`` gives the number of entries of each text, all buckets (rising within a text) and all weights; a
    text's weights have unit length.
    """

    def __init__(self, dim=SPARSE_DIM, batch_size=1024):
        self.dim, self.batch_size = dim, batch_size
        self.model_id = f"signed-md5-sparse-{dim}"
        self._codes = None

    def __getstate__(self):
        return {**self.__dict__, "_codes": None}

    def encode(self, texts):
        if self._codes is None:
            self._codes = _WordCodes(self.dim)
        codes = self._codes
        per_text = [[codes[w] for w in t.lower().split()] for t in texts]
        rows = np.repeat(np.arange(len(per_text)), [len(p) for p in per_text])
        flat = np.fromiter((c for p in per_text for c in p), np.int64, len(rows))
        slots, back = np.unique(rows * self.dim + (flat >> 1), return_inverse=True)
        sums = np.bincount(back, 1.0 - 2.0 * (flat & 1), minlength=len(slots))
        slots, sums = slots[sums != 0], sums[sums != 0]
        row = slots // self.dim
        length = np.sqrt(np.bincount(row, sums * sums, minlength=len(per_text)))
        counts = np.bincount(row, minlength=len(per_text))
        return counts, (slots % self.dim).astype(np.int32), (sums / length[row]).astype(np.float32)


def encode_sparse(df, text, encoder, out="entries"):
    """Add ``out``, the entries (bucket, weight) of column ``text`` that are not zero; a NULL text gives NULL."""
    step = encoder.batch_size

    @F.arrow_udf(ENTRIES)
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in (part for batch in batches for part in slices(batch, step)):
            counts, buckets, weights = encoder.encode([t or "" for t in part.to_pylist()])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            pairs = pa.StructArray.from_arrays(
                [pa.array(buckets, pa.int32()), pa.array(weights, pa.float32())], names=["bucket", "weight"]
            )
            yield pa.ListArray.from_arrays(offsets, pairs, mask=part.is_null())

    return df.withColumn(out, embed.asNondeterministic()(F.col(text)))


class SparseIndex(NamedTuple):
    """Parts (part, keys, buckets, starts, most, least, places, weights), one row for at most ``PART_ROWS`` documents."""

    parts: DataFrame


def _part_schema(key_type):
    packed = [T.StructField(c, T.BinaryType()) for c in ("buckets", "starts", "most", "least", "places", "weights")]
    return T.StructType([T.StructField("part", T.LongType()), T.StructField("keys", T.ArrayType(key_type)), *packed])


def _postings(rows, buckets, weights):
    """Packed columns of a part from its entries: row, bucket and weight of each."""
    order = np.lexsort((rows, buckets))
    rows, buckets, weights = rows[order], buckets[order], weights[order]
    starts = np.flatnonzero(np.diff(buckets, prepend=-1))
    if len(starts):
        most, least = np.maximum.reduceat(weights, starts), np.minimum.reduceat(weights, starts)
    else:
        most = least = weights
    ends = np.append(starts, len(rows)).astype(np.int32)
    return [x.tobytes() for x in (buckets[starts], ends, most, least, rows.astype(np.int32), weights)]


def _pack(names):
    """One row per part from rows (part, key, entries) in the order of their parts."""

    def row_of(part, number, keys, entries):
        keys = pa.concat_arrays(keys)
        counts = np.concatenate([np.diff(e.offsets.to_numpy()) for e in entries])
        pairs = [e.flatten() for e in entries]
        rows = np.repeat(np.arange(len(counts)), counts)
        buckets = np.concatenate([p.field("bucket").to_numpy() for p in pairs])
        weights = np.concatenate([p.field("weight").to_numpy() for p in pairs])
        packed = [pa.array([x], pa.binary()) for x in _postings(rows, buckets, weights)]
        listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), listed, *packed], names=names)

    def pack(batches):
        part, number, keys, entries, rows, size = None, 0, [], [], 0, 0
        for batch in batches:
            parts, counts = batch.column(0).to_numpy(), np.diff(batch.column(2).offsets.to_numpy())
            start = 0
            while start < batch.num_rows:
                if parts[start] != part or rows >= PART_ROWS or size >= PART_ENTRIES:
                    if rows:
                        yield row_of(part, number, keys, entries)
                    number = number + 1 if parts[start] == part else 0
                    part, keys, entries, rows, size = int(parts[start]), [], [], 0, 0
                same = int(np.searchsorted(parts, part, "right"))
                room = int(np.searchsorted(np.cumsum(counts[start:same]), max(1, PART_ENTRIES - size))) + 1
                stop = min(same, start + PART_ROWS - rows, start + room)
                keys.append(batch.column(1).slice(start, stop - start))
                entries.append(batch.column(2).slice(start, stop - start))
                rows, size, start = rows + stop - start, size + int(counts[start:stop].sum()), stop
        if rows:
            yield row_of(part, number, keys, entries)

    return pack


def build_sparse_index(vectors, key="doc_id", entries="entries", path=None):
    """Write an inverted index of sparse vectors, below the shared folder or at ``path``.

    Documents are dealt to parts by a hash of their key, so no bucket makes a part large; parts are cut at
    ``PART_ROWS`` documents and ``PART_ENTRIES`` entries. Within a vector buckets are distinct. Vectors that are NULL are
    left out, empty ones score 0.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(entries).cast(ENTRIES).alias("entries")).filter("entries is not null")
    parts = max(1, -(-vectors.count() // PART_ROWS))
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), "key", "entries")
    ordered = dealt.repartition("part").sortWithinPartitions("part")
    schema = _part_schema(rows.schema["key"].dataType)
    path = path or run_dir(vectors.sparkSession, "sparse-index")
    ordered.mapInArrow(_pack(schema.names), schema).write.parquet(path)
    return SparseIndex(vectors.sparkSession.read.schema(schema).parquet(path))


class _Part:
    """One part as a search sees it."""

    def __init__(self, row):
        kinds = {"buckets": np.int32, "starts": np.int32, "most": np.float32, "least": np.float32, "places": np.int32, "weights": np.float32}
        for name, kind in kinds.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.keys = row["keys"]
        self.order = None

    def best(self, buckets, weights, k, floor):
        """(rank score, score, key) of the part's best ``k`` documents that reach ``floor``, a rank score."""
        at = np.minimum(np.searchsorted(self.buckets, buckets), max(len(self.buckets) - 1, 0))
        there = self.buckets[at] == buckets if len(self.buckets) else np.zeros(len(buckets), bool)
        at, weights = at[there], weights[there].astype(np.float64)
        bounds = np.maximum(0, np.maximum(weights * self.most[at], weights * self.least[at]))
        order = np.argsort(-bounds, kind="stable")
        at, weights, bounds = at[order], weights[order], bounds[order]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0.0)  # what the list and all behind it can add
        need = (floor - 1) / RANK_SCALE  # a score below cannot reach the floor, whatever its rounding
        if rest[0] < need:
            return []
        scores, seen = np.zeros(len(self.keys)), np.zeros(len(self.keys), bool)
        for i, (t, w) in enumerate(zip(at.tolist(), weights.tolist())):
            lo, hi = self.starts[t], self.starts[t + 1]
            places, values = self.places[lo:hi], w * self.weights[lo:hi].astype(np.float64)
            if rest[i] < need:  # documents not seen yet cannot get there: only those that may are looked up
                alive = seen & (scores + rest[i] >= need)
                if not alive.any():
                    return []
                hit = alive[places]
                places, values = places[hit], values[hit]
                seen = alive
            else:
                seen[places] = True
            scores[places] += values
        if need <= 0:  # documents without any of the buckets score 0
            seen[:] = True
        ranks = np.floor(scores * RANK_SCALE + 0.5)
        found = np.flatnonzero(seen & (ranks >= floor))
        if len(found) > k:
            last = np.partition(ranks[found], len(found) - k)[len(found) - k]
            found = found[ranks[found] >= last]
        hits = sorted(((-ranks[i], self.keys[i], scores[i]) for i in found.tolist()), key=lambda h: h[:2])
        return hits[:k]


def _task_hits(parts, shared, k, schema):
    key_name = schema.names[1]

    def run(batches):
        queries = shared.value
        best, floor = [[] for _ in queries], [-np.inf] * len(queries)
        for batch in batches:
            for i in range(batch.num_rows):
                part = _Part(batch.slice(i, 1).to_pylist()[0])
                for q, (_, buckets, weights) in enumerate(queries):
                    hits = part.best(buckets, weights, k, floor[q])
                    if hits:
                        best[q] = sorted(best[q] + hits, key=lambda h: h[:2])[:k]
                        if len(best[q]) == k:
                            floor[q] = -best[q][-1][0]
        rows = [(queries[q][0], key, float(score)) for q, hits in enumerate(best) for _, key, score in hits]
        if rows:
            columns = dict(zip(schema.names, zip(*rows)))
            types = {schema.names[0]: None, key_name: None, "score": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(columns[c], types[c]) for c in schema.names], names=schema.names)

    return parts.mapInArrow(run, schema)


def sparse_topk(queries, index, k=5, query_id="query_id", entries="entries", key="doc_id", max_query_bytes=BROADCAST_BYTES):
    """The ``k`` best documents of every query: (query_id, key, score DOUBLE, rank INT), exactly.

    ``query_id`` is unique; ties at ``RANK_SCALE`` go to the smaller key, and documents that share no bucket with the
    query score 0, as in ``exact_topk``. Queries are broadcast as many at a time as ``max_query_bytes`` holds (entries
    and running hits, counted beforehand); every such part of them reads the index once. NULL entries give no hits.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = queries.select(F.col(query_id), F.col(entries).cast(ENTRIES).alias("entries")).filter("entries is not null")
    size = asked.agg(F.sum(F.size("entries") * 16 + F.octet_length(F.col(query_id).cast("string")) + 200 + 64 * k)).first()[0] or 0
    parts = max(1, -(-size // max_query_bytes))
    schema = T.StructType([
        queries.schema[query_id], T.StructField(key, index.parts.schema["keys"].dataType.elementType), T.StructField("score", T.DoubleType())
    ])
    hits = None
    for part in range(parts):
        mine = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part)
        table = mine.toArrow()
        rows = [
            (i, np.array([e["bucket"] for e in es], np.int32), np.array([e["weight"] for e in es], np.float32))
            for i, es in zip(table[query_id].to_pylist(), table["entries"].to_pylist())
        ]
        shared = queries.sparkSession.sparkContext.broadcast(rows)
        found = _task_hits(index.parts, shared, k, schema)
        hits = found if hits is None else hits.unionByName(found)
    order = Window.partitionBy(query_id).orderBy(rank_score(F.col("score")).desc(), F.col(key))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
