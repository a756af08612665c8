"""Exact top-k over a clustered vector table that leaves out blocks no query needs.

Vectors are written in blocks of near ones, each with its centre, the radius around it and the number of vectors. No
vector v of a block scores more against a query q than q . centre + |q| * radius, so a block whose bound stays below the
k-th score found already cannot hold a hit. The most promising blocks of every query are scored first, which sets that
score; then the blocks that still may matter are read, the others are not. The result is that of ``exact_topk``.
"""

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.functions.scores import RANK_SCALE, rank_score
from textharbor.operators.topk import _Best, _first, _matrix, _norms, query_bytes
from textharbor.session import BROADCAST_BYTES, run_dir, write_and_read

#: Vectors of a block; of a cell dealt as one; centres at most, and sampled vectors for each.
BLOCK_ROWS = 512
CELL_ROWS = 1 << 17
MAX_CENTRES = 4096
SAMPLE_ROWS = 16
SAMPLE_BYTES = 32 << 20
ROUNDS = 4
#: Blocks scored first for every query.
SEEDS = 3
#: Bytes of bounds (blocks times queries) that a task holds at once.
STEP_BYTES = 8 << 20
#: Queries and points that are doubles at once.
_ROWS_STEP = 1 << 11


class ClusteredVectors(NamedTuple):
    """Blocks (block, centre, radius, size, keys, numbers) and the length of their vectors, None without any."""

    blocks: DataFrame
    dim: int | None

    def summaries(self):
        return self.blocks.select("block", "centre", "radius")


def _centres(vectors, key, vector, dim, count):
    """At most ``count`` centres from a bounded sample of vectors, picked by hash and moved to the middle of their share."""
    rows = max(1, min(count * SAMPLE_ROWS, SAMPLE_BYTES // (4 * dim)))
    sample = vectors.orderBy(F.xxhash64(key), key).limit(rows).select(vector).toArrow()
    points = _matrix(sample[vector], dim)
    centres = points[:: max(1, len(points) // max(count, 1))][:count].copy()
    for _ in range(ROUNDS if len(centres) > 1 else 0):
        nearest = _nearest(points, centres)
        sums = np.zeros(centres.shape, np.float64)
        np.add.at(sums, nearest, points)
        n = np.bincount(nearest, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def _nearest(points, centres):
    """The place of the nearest centre of each point."""
    half = (centres.astype(np.float64) ** 2).sum(axis=1) / 2
    steps = range(0, len(points), _ROWS_STEP)
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(points[i : i + _ROWS_STEP] @ centres.T - half, axis=1) for i in steps)])


def _assigned(vectors, key, vector, dim, centres):
    """Rows (key, vector, cell)."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # MAX_CENTRES at most
    schema = T.StructType([vectors.schema[key], vectors.schema[vector], T.StructField("cell", T.IntegerType())])

    def assign(batches):
        for batch in batches:
            cell = _nearest(_matrix(batch.column(1), dim), shared.value) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=schema.names)

    written = write_and_read(vectors.select(key, vector).mapInArrow(assign, schema), "cells")
    shared.destroy()
    return written


def _block_schema(key_type):
    return T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("centre", T.BinaryType()),
            T.StructField("radius", T.DoubleType()),
            T.StructField("size", T.IntegerType()),
            T.StructField("keys", T.ArrayType(key_type)),
            T.StructField("numbers", T.BinaryType()),
        ]
    )


def _pack(dim, names):
    """Rows in the order of their cells to blocks; a block never holds two cells."""

    def row_of(number, keys, points):
        centre = points.mean(axis=0, dtype=np.float64)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))
        row = [
            pa.array([number], pa.int64()),
            pa.array([centre.tobytes()], pa.binary()),
            pa.array([radius * (1 + 1e-9) + 1e-12], pa.float64()),  # its own rounding counted in
            pa.array([len(points)], pa.int32()),
            pa.ListArray.from_arrays(pa.array([0, len(points)], pa.int32()), keys),
            pa.array([points.tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(row, names=names)

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        cell, keys, points = None, [], np.zeros((0, dim), np.float32)
        for batch in batches:
            cells, fresh = batch.column(2).to_numpy(), _matrix(batch.column(1), dim)
            ends = np.append(np.flatnonzero(np.diff(cells)) + 1, len(cells)) if len(cells) else []
            start = 0
            for end in ends:
                if cells[start] != cell and len(points):
                    yield row_of(number, pa.concat_arrays(keys), points)
                    number, keys, points = number + 1, [], points[:0]
                cell = cells[start]
                while start < end:
                    stop = min(end, start + BLOCK_ROWS - len(points))
                    keys.append(batch.column(0).slice(start, stop - start))
                    points = np.concatenate([points, fresh[start:stop]])
                    start = stop
                    if len(points) == BLOCK_ROWS:
                        yield row_of(number, pa.concat_arrays(keys), points)
                        number, keys, points = number + 1, [], points[:0]
        if len(points):
            yield row_of(number, pa.concat_arrays(keys), points)

    return pack


def cluster_vectors(vectors, key="doc_id", vector="embedding", dim=None, centres=None, path=None):
    """Write a vector table in blocks of near vectors, below the shared folder or at ``path``.

    ``centres`` is the number of cells (by default the square root of the number of vectors, ``MAX_CENTRES`` at most);
    they are placed by a bounded sample. Cells of more than ``CELL_ROWS`` vectors are dealt to several tasks. Keys need
    not be unique. Vectors have one length and are finite, anything else is an error.
    """
    vectors = vectors.select(key, vector)
    if dim is None:
        first = vectors.select(F.size(vector)).first()
        known, dim = bool(first), max(first[0], 1) if first else 1
    else:
        known = True
    count = centres or min(MAX_CENTRES, max(1, math.isqrt(vectors.count())))
    path = path or run_dir(vectors.sparkSession, "clustered")
    placed = _centres(vectors, key, vector, dim, count)
    rows = _assigned(vectors, key, vector, dim, placed if len(placed) else np.zeros((1, dim), np.float32))
    shares = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("salts"))  # a row a centre
    salt = F.pmod(F.xxhash64(key), F.col("salts")).alias("salt")
    dealt = rows.join(F.broadcast(shares), "cell").select(key, vector, "cell", salt)
    dealt = dealt.repartition("cell", "salt").sortWithinPartitions("cell", "salt", key).drop("salt")
    schema = _block_schema(rows.schema[key].dataType)
    dealt.mapInArrow(_pack(dim, schema.names), schema).write.parquet(path)
    return ClusteredVectors(vectors.sparkSession.read.schema(schema).parquet(path), dim if known else None)


def _bounds(matrix, norms, centres, radii):
    """The most that a vector of each block can score against each query: blocks x queries."""
    bounds = radii[:, None] * norms
    for i in range(0, len(matrix), _ROWS_STEP):
        bounds[:, i : i + _ROWS_STEP] += centres @ matrix[i : i + _ROWS_STEP].astype(np.float64).T
    return bounds


def _steps(batch, queries):
    """Slices of a batch small enough to bound all queries against at once."""
    step = max(1, STEP_BYTES // (8 * max(queries, 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _centres_of(column, dim):
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _reaches(bounds, floor):
    """Can a score up to the bound reach this rank score? Rounding of either is counted in."""
    return bounds + 1e-9 >= floor / RANK_SCALE - 1.0 / RANK_SCALE


def _seed_blocks(summaries, shared, dim):
    """The ``SEEDS`` blocks with the largest bounds of every query."""
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("bound", T.DoubleType()), T.StructField("block", T.LongType())])

    def run(batches):
        _, matrix, norms = shared.value
        best, blocks = np.zeros((0, len(matrix))), np.zeros((0, len(matrix)), np.int64)
        for batch in (part for whole in batches for part in _steps(whole, len(matrix))):
            found = _bounds(matrix, norms, _centres_of(batch.column(1), dim), batch.column(2).to_numpy())
            names = np.broadcast_to(batch.column(0).to_numpy()[:, None], found.shape)
            best, blocks = np.concatenate([best, found]), np.concatenate([blocks, names])
            order = np.argsort(-best, axis=0, kind="stable")[:SEEDS]
            best, blocks = np.take_along_axis(best, order, axis=0), np.take_along_axis(blocks, order, axis=0)
        q = np.broadcast_to(np.arange(len(matrix)), best.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (q, best, blocks)], names=schema.names)

    found = summaries.mapInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    return found.withColumn("place", place).filter(F.col("place") <= SEEDS).select("block").distinct()


def _wanted_blocks(summaries, shared, floor, dim):
    """Blocks that may hold a hit of some query, with the number of queries."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("queries", T.LongType())])

    def run(batches):
        _, matrix, norms = shared.value
        for batch in (part for whole in batches for part in _steps(whole, len(matrix))):
            found = _bounds(matrix, norms, _centres_of(batch.column(1), dim), batch.column(2).to_numpy())
            asked = _reaches(found, floor.value).sum(axis=1)
            some = asked > 0
            columns = [batch.column(0).filter(pa.array(some)), pa.array(asked[some])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return summaries.mapInArrow(run, schema)


def _block_hits(blocks, shared, floor, k, dim, schema):
    """Hits of a task's blocks; queries that a block cannot serve are not compared with it."""

    def run(batches):
        ids, matrix, norms = shared.value
        best = _Best(matrix, k)
        best.floor = floor.value.copy()
        for batch in (part for whole in batches for part in _steps(whole, len(matrix))):
            bounds = _bounds(matrix, norms, _centres_of(batch.column(1), dim), batch.column(2).to_numpy())
            for row in np.argsort(-bounds.max(axis=1, initial=-np.inf), kind="stable").tolist():
                asked = np.flatnonzero(_reaches(bounds[row], best.floor))
                if len(asked):
                    vectors = np.frombuffer(batch.column(4)[row].as_buffer(), np.float32).reshape(-1, dim)
                    best.add(batch.column(3)[row].values, vectors, asked)
        out = best.result(ids, schema.names)
        if out is not None:
            yield out

    return blocks.select("block", "centre", "radius", "keys", "numbers").mapInArrow(run, schema)


def _ranked(hits, k, query_id, key):
    order = Window.partitionBy(query_id).orderBy(rank_score(F.col("score")).desc(), F.col(key))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Pruned(NamedTuple):
    """Hits (query_id, key, score, rank) and one row for each block of queries: blocks there are and blocks read,
    pairs of query and block there are and pairs compared (at most)."""

    hits: DataFrame
    report: DataFrame


def _pruned_part(queries, index, k, query_id, query_vector, key):
    context, dim = queries.sparkSession.sparkContext, index.dim
    wrong = F.raise_error(F.lit(f"every query vector needs {dim} numbers"))
    checked = F.when(F.size(query_vector) == dim, F.col(query_vector)).otherwise(wrong)
    table = queries.select(query_id, checked.alias(query_vector)).toArrow()  # measured by pruned_topk
    ids, matrix = _first(table[query_id]), _matrix(table[query_vector], dim)
    norms = _norms(matrix)
    shared = context.broadcast((ids, matrix, norms))
    schema = T.StructType(
        [queries.schema[query_id], T.StructField(key, index.blocks.schema["keys"].dataType.elementType), T.StructField("score", T.DoubleType())]
    )
    none = context.broadcast(np.full(len(matrix), -np.inf))
    seeds = _seed_blocks(index.summaries(), shared, dim)
    first = _block_hits(index.blocks.join(F.broadcast(seeds), "block", "left_semi"), shared, none, k, dim, schema)
    last = _ranked(first, k, query_id, key).filter(F.col("rank") == k).select(query_id, "score").toArrow()
    at_least = dict(zip(last[query_id].to_pylist(), last["score"].to_numpy().tolist()))
    floor = [math.floor(at_least[i] * RANK_SCALE + 0.5) if i in at_least else -np.inf for i in ids.to_pylist()]
    floor = context.broadcast(np.array(floor, np.float64))
    wanted = write_and_read(_wanted_blocks(index.summaries(), shared, floor, dim), "wanted-blocks")
    n_read, pairs = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum("queries"), F.lit(0))).first()
    names = wanted.select("block")
    near = index.blocks.join(F.broadcast(names) if 8 * n_read <= BROADCAST_BYTES else names, "block", "left_semi")
    hits = write_and_read(_ranked(_block_hits(near, shared, floor, k, dim, schema), k, query_id, key), "pruned-hits")
    for variable in (shared, none, floor):
        variable.destroy()
    report = index.blocks.agg(F.count(F.lit(1)).alias("blocks")).select(
        "blocks", F.lit(n_read).alias("blocks_read"), (F.col("blocks") * len(matrix)).alias("pairs"), F.lit(pairs).alias("pairs_compared")
    )
    return Pruned(hits, report)


def pruned_topk(queries, index, k=5, query_id="query_id", query_vector="q", key="doc_id", max_query_bytes=BROADCAST_BYTES):
    """The rows of ``exact_topk`` from a table written by :func:`cluster_vectors`, and what was left out.

    Queries are taken as many at a time as ``max_query_bytes`` holds (measured; dealt by a hash of the unique
    ``query_id``). How much is skipped depends on the data: vectors without any structure have large radii, and then
    nearly all blocks are read. Ties go to the smaller key; a zero query vector gets the smallest keys.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    queries = queries.select(query_id, query_vector)
    if index.dim is None:
        first = queries.select(F.size(query_vector)).first()
        index = index._replace(dim=max(first[0], 1) if first else 1)
    parts = max(1, -(-query_bytes(queries, query_id, index.dim, k) // max_query_bytes))
    done = []
    for part in range(parts):
        mine = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part)
        done.append(_pruned_part(mine, index, k, query_id, query_vector, key))
    hits, report = done[0]
    for more in done[1:]:
        hits, report = hits.unionByName(more.hits), report.unionByName(more.report)
    return Pruned(hits, report)
