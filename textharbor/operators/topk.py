"""Exact top-k inner products of a query table against a vector table.

Exact search has to look at every (query, vector) pair; what can be avoided is moving, storing
or emitting them. Pairs are scored as block products inside tasks and only each query's best k
of a task leave it.

* ``scan``: the query vectors, measured and at most ``max_query_bytes``, are broadcast as one
  matrix; the vector table is read once, in place, without a shuffle.
* ``grid``: for more queries than that. Both tables are packed into block rows; vector blocks
  are dealt evenly to cells by block number (never by key, so no key can make a cell hot),
  query blocks are sent to every cell, and an equi-join on the cell brings them together.
  Neither side passes through the driver, and a task holds one pair of blocks at a time.

Both strategies give the same rows: score descending at ``RANK_SCALE``, then key ascending.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.functions.scores import RANK_SCALE, rank_score
from textharbor.session import BROADCAST_BYTES, write_and_read

BLOCK_ROWS = 4096
QUERY_STEP = 1024
CELL_BYTES = 256 << 20
#: Tasks whose hits meet in one step of the final merge, and bytes of vectors that count as a task there.
MERGE_TASKS = 512
MERGE_BYTES = 64 << 20
#: What the plan says of tables that do not come from files.
UNKNOWN_BYTES = 1 << 60
_RESCORE_STEP = 1 << 13
#: Bytes of one side of the pairs that are scored again at once.
_RESCORE_BYTES = 4 << 20
#: Offers put together as one table: one of a few rows takes kilobytes.
_OFFERS = 256
_NORM_STEP = 1 << 13
_PAIR_STEP = 1 << 18


def _matrix(column, dim):
    """An Arrow list column as a float32 matrix; refuses NULLs, other lengths and numbers that are not finite.

    A single NaN would make every bound of its block NaN, and the block's vectors would silently drop out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    wrong = column.null_count or flat.null_count
    if len(column) and not wrong:
        wrong = pc.any(pc.not_equal(pc.list_value_length(column), dim)).as_py()
    if wrong:
        raise ValueError(f"every vector needs {dim} numbers; use split_by_dim to set others aside")
    matrix = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    if not np.isfinite(matrix).all():
        raise ValueError("a vector holds NaN or an infinite number; use split_by_dim to set it aside")
    return matrix


def _smallest_copies(keys, block, k):
    """Rows of a block without those that k equal vectors with smaller keys are ahead of.

    Whatever the query, equal vectors score the same and the smaller key wins, so a row with
    k such rows ahead is in no result. A block of copies comes down to k rows.
    """
    as_bytes = np.ascontiguousarray(block).view(np.dtype((np.void, block.shape[1] * 4))).ravel()
    distinct, group = np.unique(as_bytes, return_inverse=True)
    if len(distinct) == len(block):
        return keys, block
    rows = pa.table({"group": group, "key": keys})
    order = pc.sort_indices(rows, [("group", "ascending"), ("key", "ascending")]).to_numpy()
    sorted_group = group[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group)
    kept = np.sort(order[place < k])
    return keys.take(pa.array(kept)), block[kept]


def _norms(matrix):
    """Lengths of the rows, without a copy of them all in double precision."""
    parts = (matrix[i : i + _NORM_STEP].astype(np.float64) for i in range(0, len(matrix), _NORM_STEP))
    return np.concatenate([np.zeros(0), *(np.sqrt((part**2).sum(axis=1)) for part in parts)])


class _Best:
    """Running top k of a block of queries over any number of vector blocks."""

    def __init__(self, queries, k):
        self.queries = queries
        self.k = k
        norms = _norms(queries)
        self.max_norm = float(norms.max(initial=0.0))
        self.is_blank = norms == 0  # all vectors tie for these: the smallest keys win
        self.blank = np.flatnonzero(self.is_blank)
        self.floor = np.full(len(queries), -np.inf)  # rank score a candidate has to reach
        self.kept = None
        self.fresh = []  # the last offers, then many at a time
        self.merged = []
        self.n_fresh = 0

    def add(self, keys, vectors, wanted=None):
        """Offer vectors to all queries, or to those at the places ``wanted``."""
        for start in range(0, len(vectors), BLOCK_ROWS):
            block = vectors[start : start + BLOCK_ROWS]
            self._add_block(*_smallest_copies(keys.slice(start, len(block)), block, self.k), wanted)

    def _add_block(self, keys, block, wanted=None):
        dim = block.shape[1]
        norm = float(np.sqrt((block.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0))
        # Bound on the rounding error of a 32-bit inner product, with room to spare.
        slack = 2.0 * (dim + 2) * 2.0**-24 * self.max_norm * norm + 1.0 / RANK_SCALE
        if len(self.blank):
            order = pc.sort_indices(pa.table({"key": keys}), [("key", "ascending")])
            smallest = order[: self.k].to_numpy()
            self._offer(np.repeat(self.blank, len(smallest)), np.tile(smallest, len(self.blank)), keys, block)
        everything = np.arange(len(self.queries)) if wanted is None else wanted
        for start in range(0, len(everything), QUERY_STEP):
            places = everything[start : start + QUERY_STEP]
            part = self.queries[start : start + QUERY_STEP] if wanted is None else self.queries[places]
            rough = part @ block.T
            need = self.floor[places] / RANK_SCALE - slack
            if len(block) > self.k and np.isneginf(need).any():
                kth = np.partition(rough, len(block) - self.k, axis=1)[:, len(block) - self.k]
                need = np.maximum(need, kth - 2.0 * slack)
            need[self.is_blank[places]] = np.inf
            q, v = np.nonzero(rough >= need[:, None])
            step = min(_RESCORE_STEP, max(1, _RESCORE_BYTES // (8 * dim)))
            for at in range(0, len(q), step):
                self._offer(places[q[at : at + step]], v[at : at + step], keys, block)
        if self.kept is None or self.n_fresh > max(self.k * len(self.queries), 16 * _RESCORE_STEP):
            self.prune()

    def _offer(self, q, v, keys, block):
        left = self.queries[q].astype(np.float64)
        score = np.einsum("ij,ij->i", left, block[v].astype(np.float64))
        rank = np.floor(score * RANK_SCALE + 0.5)
        ok = rank >= self.floor[q]
        q, v, score, rank = q[ok], v[ok], score[ok], rank[ok]
        self.fresh.append(
            pa.table({"q": q, "rank": rank, "score": score, "key": keys.take(pa.array(v))})
        )
        self.n_fresh += len(q)
        if len(self.fresh) >= _OFFERS:
            self.merged.append(pa.concat_tables(self.fresh).combine_chunks())
            self.fresh = []

    def prune(self):
        parts = [*([] if self.kept is None else [self.kept]), *self.merged, *self.fresh]
        self.merged, self.fresh, self.n_fresh = [], [], 0
        if not parts:
            return
        table = pa.concat_tables(parts)
        order = [("q", "ascending"), ("rank", "descending"), ("key", "ascending")]
        table = table.take(pc.sort_indices(table, order))
        q = table["q"].to_numpy()
        first = np.searchsorted(q, np.arange(len(self.queries)))
        place = np.arange(len(q)) - first[q]
        self.kept = table.filter(pa.array(place < self.k)).combine_chunks()
        last = place == self.k - 1
        self.floor[q[last]] = table["rank"].to_numpy()[last]

    def result(self, query_ids, names):
        self.prune()
        if self.kept is None or not self.kept.num_rows:
            return None
        columns = [query_ids.take(self.kept["q"].combine_chunks()), self.kept["key"].combine_chunks()]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        columns.append(self.kept["score"].combine_chunks())
        return pa.RecordBatch.from_arrays(columns, names=names)


def _first(column):
    """A column of a record batch or table as one contiguous array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _hit_schema(queries, vectors, query_id, key):
    return T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(key, vectors.schema[key].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def query_bytes(queries, query_id, dim, k):
    """What every task holds of the queries: one vector and ``k`` running hits each. Vectors are not computed for this."""
    each = F.octet_length(F.col(query_id).cast("string")) + F.lit(16 + 4 * dim + 64 * k)
    return queries.agg(F.sum(each)).first()[0] or 0


def _scan(queries, vectors, k, query_id, key, query_vector, vector, dim):
    wrong = F.raise_error(F.lit(f"every query vector needs {dim} numbers"))
    checked = F.when(F.size(query_vector) == dim, F.col(query_vector)).otherwise(wrong)
    # At most max_query_bytes: exact_topk has counted the queries, and their vectors are checked here.
    table = queries.select(query_id, checked.alias(query_vector)).toArrow()
    shared = queries.sparkSession.sparkContext.broadcast(
        (_first(table[query_id]), _matrix(table[query_vector], dim))
    )
    names = [query_id, key, "score"]

    def best_of_task(batches):
        ids, matrix = shared.value
        best = _Best(matrix, k)
        for batch in batches:
            best.add(batch.column(0), _matrix(batch.column(1), dim))
        out = best.result(ids, names)
        if out is not None:
            yield out

    schema = _hit_schema(queries, vectors, query_id, key)
    return vectors.select(key, vector).mapInArrow(best_of_task, schema)


def _packed(df, key, vector, dim, rows):
    """Rows -> (block BIGINT, keys ARRAY, numbers BINARY), at most ``rows`` vectors per block."""
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("keys", T.ArrayType(df.schema[key].dataType)),
            T.StructField("numbers", T.BinaryType()),
        ]
    )

    def pack(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, matrix = batch.column(0), _matrix(batch.column(1), dim)
            for start in range(0, len(matrix), rows):
                part = matrix[start : start + rows]
                ids = keys.slice(start, len(part))
                row = [
                    pa.array([block], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids),
                    pa.array([part.tobytes()], pa.binary()),
                ]
                block += 1
                yield pa.RecordBatch.from_arrays(row, names=["block", "keys", "numbers"])

    # Written out: a task run again after a lost executor must see the same blocks.
    return write_and_read(df.select(key, vector).mapInArrow(pack, schema), "blocks")


def _grid_shape(blocks, vector_bytes, query_bytes, cores):
    """(cells, groups): vector blocks are dealt to cells, query blocks to groups.

    Every query block goes to each cell and every vector block to each group. There are cells
    times groups tasks, enough for the cluster and for the size of both tables; they are
    divided so that the bytes moved, queries * cells + vectors * groups, are least.
    """
    tasks = max(4 * cores, -(-(vector_bytes + query_bytes) // CELL_BYTES))
    best = round(math.sqrt(tasks * vector_bytes / max(query_bytes, 1)))
    cells = max(1, min(blocks, tasks, best))
    return cells, -(-tasks // cells)


def _grid(queries, vectors, k, query_id, key, query_vector, vector, dim, cells, block_rows):
    left = _packed(queries, query_id, query_vector, dim, block_rows)
    right = _packed(vectors, key, vector, dim, block_rows)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks, total = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    asked = left.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    shape = _grid_shape(blocks, 4 * dim * total, 4 * dim * asked, cores)
    cells, groups = (cells or shape[0]), shape[1]
    left = left.select(
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"),
        F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"),
        F.col("block").alias("q_block"),
        F.col("keys").alias("q_keys"),
        F.col("numbers").alias("q_numbers"),
    )
    right = right.select(
        F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int").alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.col("keys").alias("v_keys"),
        F.col("numbers").alias("v_numbers"),
    )
    # As a sort-merge join with the queries streamed, pairs of one query block come in a row.
    # A partition per cell and group, so that a task's share does not grow with the tables.
    parts = max(cores, cells * groups)
    left, right = (side.repartition(parts, "cell", "group") for side in (left, right))
    pairs = left.hint("merge").join(right, ["cell", "group"]).drop("cell", "group")
    names = [query_id, key, "score"]

    def unpack(column, row):
        return np.frombuffer(column[row].as_buffer(), np.float32).reshape(-1, dim)

    def best_of_pairs(batches):
        current, best, ids = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column(0)[row].as_py()
                if block != current:
                    if best is not None and (out := best.result(ids, names)) is not None:
                        yield out
                    current, ids = block, batch.column(1)[row].values
                    best = _Best(unpack(batch.column(2), row), k)
                best.add(batch.column(3)[row].values, unpack(batch.column(4), row))
        if best is not None and (out := best.result(ids, names)) is not None:
            yield out

    return pairs.mapInArrow(best_of_pairs, _hit_schema(queries, vectors, query_id, key))


def exact_topk(
    queries,
    vectors,
    k=5,
    query_id="query_id",
    key="doc_id",
    query_vector="q",
    vector="embedding",
    dim=None,
    strategy="auto",
    max_query_bytes=BROADCAST_BYTES,
    cells=None,
    block_rows=BLOCK_ROWS,
):
    """The ``k`` best vectors of every query: (query_id, key, score DOUBLE, rank INT).

    Both vector columns hold unit vectors of one length. ``query_id`` is unique and ``key``
    orderable. ``dim`` saves a look at the first query vector; a vector of another length is an
    error. Ties at ``RANK_SCALE`` go to the smaller key. Fewer than ``k`` rows come back
    where there are fewer vectors; no vectors give no rows.
    """
    if not 1 <= k:
        raise ValueError("k must be at least 1")
    if strategy not in ("auto", "scan", "grid"):
        raise ValueError(f"unknown strategy {strategy!r}")
    queries = queries.select(query_id, query_vector)
    if dim is None:
        # Without queries there is nothing to score, but vectors are still read in their own length.
        first = queries.select(F.size(query_vector)).first() or vectors.select(F.size(vector)).first()
        dim = max(first[0], 1) if first else 1
    if strategy == "auto":
        strategy = "scan" if query_bytes(queries, query_id, dim, k) <= max_query_bytes else "grid"
    elif strategy == "scan" and (asked := query_bytes(queries, query_id, dim, k)) > max_query_bytes:
        raise ValueError(f"queries of {asked} bytes are too large to broadcast (max_query_bytes); use strategy='grid'")
    if strategy == "scan":
        hits = _scan(queries, vectors, k, query_id, key, query_vector, vector, dim)
    else:
        hits = _grid(queries, vectors, k, query_id, key, query_vector, vector, dim, cells, block_rows)
    best = [rank_score(F.col("score")).desc(), F.col(key)]
    size = int(str(vectors._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if MERGE_TASKS * MERGE_BYTES < size < UNKNOWN_BYTES:
        # Very many tasks: hits of so many at a time are cut to k before those of one query meet in one place.
        part = F.floor(F.spark_partition_id() / F.lit(max(MERGE_TASKS, 1)))
        first = Window.partitionBy(query_id, "_part").orderBy(*best)
        hits = hits.withColumn("_part", part).withColumn("rank", F.row_number().over(first))
        hits = hits.filter(F.col("rank") <= k).drop("_part", "rank")
    order = Window.partitionBy(query_id).orderBy(*best)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def score_pairs(queries, vectors, query_id="query_id", key="doc_id", query_vector="q", vector="embedding", dim=None, max_query_bytes=BROADCAST_BYTES):
    """The inner product of every query with every vector: rows (query_id, key, score DOUBLE).

    All pairs are what is asked for, so the query table should be a stated, small set. It is measured, and broadcast as
    many queries at a time as ``max_query_bytes`` holds; the vector table is read in place, once for each such part.
    ``query_id`` is unique. Vectors have one length and are finite, anything else is an error.
    """
    queries = queries.select(query_id, query_vector)
    if dim is None:
        first = queries.select(F.size(query_vector)).first() or vectors.select(F.size(vector)).first()
        dim = max(first[0], 1) if first else 1
    schema = _hit_schema(queries, vectors, query_id, key)
    parts = max(1, -(-query_bytes(queries, query_id, dim, 0) // max_query_bytes))
    scored = None
    for part in range(parts):
        mine = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part)
        found = vectors.select(key, vector).mapInArrow(_pairs_of(mine, query_id, query_vector, dim, schema.names), schema)
        scored = found if scored is None else scored.unionByName(found)
    return scored


def _pairs_of(queries, query_id, query_vector, dim, names):
    table = queries.toArrow()  # measured by score_pairs
    shared = queries.sparkSession.sparkContext.broadcast((_first(table[query_id]), _matrix(table[query_vector], dim)))

    def run(batches):
        ids, matrix = shared.value
        step = max(1, _PAIR_STEP // max(len(ids), 1))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                block = _matrix(part.column(1), dim).astype(np.float64)
                score = block @ matrix.astype(np.float64).T
                query = np.tile(np.arange(len(ids)), len(block))
                row = np.repeat(np.arange(len(block)), len(ids))
                columns = [ids.take(pa.array(query)), part.column(0).take(pa.array(row)), pa.array(score.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
