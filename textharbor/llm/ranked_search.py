"""Ranked lexical search over a length-stratified index.

Documents are grouped by their length normaliser m: a stratum is all documents with one m. A stratum is written as
blocks of bounded size; a block has a sorted list of its terms, and the postings of a term in falling order of term
frequency (tf), as runs of equal tf. Within a stratum a posting's impact depends on tf alone, so impacts are computed
once for each tf of a block, and the first run of each term gives the most that the term can add there.

A search bounds what every block can give every item, scores the most promising blocks of each item first and so learns
a score that the item's last hit reaches at least; then all blocks are visited in the order of their bounds, as long as
the bound reaches that score. Nothing is left out: the result is the exact ranking.

Terms are 64-bit hashes of their bytes. Two terms of a corpus share one with a chance of about t**2 / 2**65 for t
distinct terms (three in a million for ten million terms).
"""

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.llm import common
from textharbor.session import write_and_read

#: A block has at most so many documents, and postings of about so many terms.
BLOCK_DOCS = 1024
BLOCK_TERMS = 1 << 18
#: Distinct terms of items searched for at once, of which every task holds a table (about 100 bytes each).
QUERY_TERMS = 200_000
#: Blocks scored first for each item.
SEEDS = 2
#: Bytes of postings that a task opens at once.
OPEN_BYTES = 8 << 20

_LOWER = common.lowered_table()
#: Terms: anything but ASCII characters that are neither letters nor digits.
_TERM = common.byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _term_rows(data, offsets):
    """The term hashes of a piece of texts and the row of each."""
    starts, ends, rows = common.word_bounds(_TERM[data], offsets)
    return common.span_hashes(common.prefix_hashes(_LOWER[data]), starts, ends), rows


def _distinct(hashes, rows):
    """Distinct (row, hash) in this order, with how often each occurs."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(first)
    return hashes[at], rows[at], np.diff(np.append(at, len(hashes)))


def _sliced(values, counts):
    """A binary Arrow array whose rows are runs of ``counts`` values."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.large_binary(), len(counts), buffers).cast(pa.binary())


def _counted(array):
    """Number of terms of each row."""
    counts = []
    for _, data, offsets in common.pieces(array):
        _, _, rows = common.word_bounds(_TERM[data], offsets)
        counts.append(np.bincount(rows, minlength=len(offsets) - 1))
    return [pa.array(np.concatenate(counts or [np.zeros(0, np.int64)]), pa.int64())]


def _postings(array):
    """Number of terms of each row, its distinct terms in order of their hashes, and how often each occurs."""
    columns = [[pa.array([], pa.int64())], [pa.array([], pa.binary())], [pa.array([], pa.binary())]]
    for _, data, offsets in common.pieces(array):
        size = len(offsets) - 1
        hashes, rows = _term_rows(data, offsets)
        n = np.bincount(rows, minlength=size)
        hashes, rows, tf = _distinct(hashes, rows)
        counts = np.bincount(rows, minlength=size)
        found = pa.array(n, pa.int64()), _sliced(hashes, counts), _sliced(tf.astype(np.uint32), counts)
        for column, part in zip(columns, found):
            column.append(part)
    return [pa.concat_arrays(column) for column in columns]


def _terms(array):
    """Distinct terms of each row, as signed numbers."""
    out = []
    for _, data, offsets in common.pieces(array):
        hashes, rows, _ = _distinct(*_term_rows(data, offsets))
        cuts = np.searchsorted(rows, np.arange(len(offsets)))
        out.extend(hashes[i:j].view(np.int64).tolist() for i, j in zip(cuts, cuts[1:]))
    return [pa.array(out, pa.list_(pa.int64()))]


_BLOCK = [
    T.StructField("m", T.LongType()),
    T.StructField("block", T.LongType()),
    T.StructField("docs", T.LongType()),
    T.StructField("terms", T.BinaryType()),  # hashes, sorted
    T.StructField("starts", T.BinaryType()),  # where the postings of each term start, and their end
    T.StructField("tops", T.BinaryType()),  # the largest tf of each term
    T.StructField("run_starts", T.BinaryType()),  # where each run of equal term and tf starts, and their end
    T.StructField("run_tfs", T.BinaryType()),
    T.StructField("places", T.BinaryType()),  # documents of the postings, as places in ``keys``
]


def _packed(terms, tfs):
    """Binary columns of a block from the terms and tfs of its documents."""
    place = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    terms, tfs = np.concatenate(terms), np.concatenate(tfs)
    order = np.lexsort((place, ~tfs, terms))  # ~: falling
    terms, tfs, place = terms[order], tfs[order], place[order]
    new_term = np.ones(len(terms), bool)
    new_term[1:] = terms[1:] != terms[:-1]
    new_run = new_term.copy()
    new_run[1:] |= tfs[1:] != tfs[:-1]
    at, runs = np.flatnonzero(new_term), np.flatnonzero(new_run)
    end = [len(terms)]
    return (
        terms[at].tobytes(), np.concatenate([at, end]).astype(np.uint32).tobytes(), tfs[at].tobytes(),
        np.concatenate([runs, end]).astype(np.uint32).tobytes(), tfs[runs].tobytes(), place.astype(np.uint16).tobytes(),
    )


def _pack(schema):
    """Blocks from documents that come in the order of their strata."""
    arrow_names = schema.names

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        label, keys, terms, tfs, size = None, [], [], [], 0

        def block():
            row = (label[0], (part << 32) + number, len(keys), *_packed(terms, tfs))
            arrays = [pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in row]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([keys], pa.list_(key_type))], names=arrow_names)

        for batch in batches:
            key_type = batch.column(0).type
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for key, m, salt, hashes, counts in zip(*columns):
                full = len(keys) >= BLOCK_DOCS or size >= BLOCK_TERMS
                if keys and (full or label != (m, salt)):
                    yield block()
                    number += 1
                    keys, terms, tfs, size = [], [], [], 0
                label = m, salt
                keys.append(key)
                terms.append(np.frombuffer(hashes, np.uint64))
                tfs.append(np.frombuffer(counts, np.uint32))
                size += len(terms[-1])
        if keys:
            yield block()

    return run


class Index(NamedTuple):
    """Blocks (m, block, docs, terms, starts, tops, run_starts, run_tfs, places, keys) and the numbers of the corpus."""

    blocks: DataFrame
    documents: int
    terms: int


def build_index(df, key="doc_id", text="text"):
    """The index of all rows of ``df`` that have a term; written to the shared folder.

    A first pass counts the terms of every text, which gives each document's m and the size of every stratum. The second
    writes postings, dealt by stratum; a stratum of more than a block is dealt by row number too, so that no stratum is
    too large for a task. A null or empty text has no terms. Null and repeated keys are kept like others, every row is a
    document. Other columns are not looked at. An empty table gives an empty index.
    """
    n = T.StructField("n", T.LongType())
    counted = common.annotate(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", _counted, [n], keep=["key"])
    lengths = write_and_read(counted.filter("n > 0").groupBy("n").agg(F.count("*").alias("docs")), "index-lengths")
    documents, terms = lengths.agg(F.sum("docs"), F.sum(F.col("docs") * F.col("n"))).first()
    documents, terms = documents or 0, terms or 0
    m = F.expr(f"50L + (cast(n AS decimal(18, 0)) * cast('{50 * documents}' AS decimal(19, 0))) div cast('{max(terms, 1)}' AS decimal(20, 0))")
    strata = lengths.withColumn("m", m).groupBy("m").agg(
        F.greatest(F.ceil(F.sum("docs") / BLOCK_DOCS), F.ceil(F.sum(F.col("docs") * F.col("n")) / BLOCK_TERMS)).alias("cells")
    )
    fields = [n, T.StructField("terms", T.BinaryType()), T.StructField("tfs", T.BinaryType())]
    posted = common.annotate(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", _postings, fields, keep=["key"])
    rows = posted.filter("n > 0").select(F.col("row.key").alias("key"), m.alias("m"), "terms", "tfs", F.monotonically_increasing_id().alias("number"))
    dealt = rows.join(strata, "m").select("key", "m", F.pmod("number", "cells").alias("salt"), "terms", "tfs")
    ordered = dealt.repartition("m", "salt").sortWithinPartitions("m", "salt")
    schema = T.StructType([*_BLOCK, T.StructField("keys", T.ArrayType(dealt.schema["key"].dataType))])
    return Index(write_and_read(ordered.mapInArrow(_pack(schema), schema), "lexical-index"), documents, terms)


def _impact(tf, m):
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Items:
    """Items searched for at once: their terms as places in one sorted vocabulary."""

    def __init__(self, rows):
        self.numbers = [r["number"] for r in rows]
        every = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
        self.vocabulary = np.unique(np.concatenate(every))
        self._place([np.searchsorted(self.vocabulary, terms) for terms in every])

    def _place(self, places):
        self.places = places
        self.flat = np.concatenate(places)
        self.item = np.repeat(np.arange(len(places)), [len(p) for p in places])

    def weigh(self, counts, documents):
        """Weights from the numbers of documents that hold each term; terms that weigh nothing are left out."""
        df = np.array([counts.get(h, 0) for h in self.vocabulary.view(np.int64).tolist()])
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()])
        kept = (df > 0) & (weights > 0)
        new = np.cumsum(kept) - 1
        self.vocabulary, self.weights = self.vocabulary[kept], weights[kept].astype(np.float64)
        self._place([new[p[kept[p]]] for p in self.places])


class _Block:
    """One block as a search sees it. Scores stay below 2**53, so that sums of doubles are exact."""

    def __init__(self, row, items):
        self.row, self.m = row, row["m"]
        terms = np.frombuffer(row["terms"], np.uint64)
        at = np.minimum(np.searchsorted(terms, items.vocabulary), len(terms) - 1)
        self.there = terms[at] == items.vocabulary
        self.at = at
        most = _impact(np.frombuffer(row["tops"], np.uint32)[at], self.m) * self.there * items.weights
        self.bounds = np.bincount(items.item, most[items.flat], minlength=len(items.places))
        self.impacts = None

    def scores(self, places, weights):
        """Score of every document for the terms at these places of the vocabulary."""
        if self.impacts is None:
            runs = np.frombuffer(self.row["run_starts"], np.uint32)
            tfs, back = np.unique(np.frombuffer(self.row["run_tfs"], np.uint32), return_inverse=True)
            self.impacts = np.repeat(_impact(tfs, self.m).astype(np.int32)[back], np.diff(runs.astype(np.int64)))
            self.starts = np.frombuffer(self.row["starts"], np.uint32).astype(np.int64)
            self.places = np.frombuffer(self.row["places"], np.uint16)
        places = places[self.there[places]]
        first = self.starts[self.at[places]]
        sizes = self.starts[self.at[places] + 1] - first
        before = np.cumsum(sizes) - sizes
        postings = np.repeat(first - before, sizes) + np.arange(sizes.sum())
        added = self.impacts[postings] * np.repeat(weights[places], sizes)
        return np.bincount(self.places[postings], added, minlength=self.row["docs"])


def _opened(batch, items):
    """The blocks of a batch, a few at a time."""
    found, size = [], 0
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        found.append(_Block(row, items))
        size += len(row["places"])
        if size >= OPEN_BYTES or i == batch.num_rows - 1:
            yield found
            found, size = [], 0


class _Best:
    """The best ``k`` hits of each item so far, and the score that a further hit has to reach."""

    def __init__(self, items, k, least):
        self.k, self.hits = k, [[] for _ in items.numbers]
        self.least = np.array([max(1, least.get(n, 1)) for n in items.numbers], np.float64)

    def add(self, item, scores, keys):
        found = np.flatnonzero(scores >= self.least[item])
        if len(found) > self.k:
            last = np.partition(scores[found], len(found) - self.k)[len(found) - self.k]
            found = found[scores[found] >= last]
        if not len(found):
            return
        hits = self.hits[item] + [(scores[i], keys[i]) for i in found.tolist()]
        hits.sort(key=lambda h: (-h[0], h[1] is not None, h[1]))
        self.hits[item] = hits[: self.k]
        if len(hits) >= self.k:
            self.least[item] = max(self.least[item], hits[self.k - 1][0])


def _document_counts(blocks, items):
    """Rows (term, df) of the terms that items look for."""
    vocabulary = blocks.sparkSession.sparkContext.broadcast(items.vocabulary)
    schema = T.StructType([T.StructField("term", T.LongType()), T.StructField("df", T.LongType())])

    def run(batches):
        wanted = vocabulary.value
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for packed, packed_starts in zip(batch.column(0), batch.column(1)):
                terms = np.frombuffer(packed.as_buffer(), np.uint64)
                starts = np.frombuffer(packed_starts.as_buffer(), np.uint32).astype(np.int64)
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                df += np.where(terms[at] == wanted, starts[at + 1] - starts[at], 0)
        there = df > 0
        yield pa.RecordBatch.from_arrays([pa.array(wanted[there].view(np.int64)), pa.array(df[there])], names=schema.names)

    counts = blocks.select("terms", "starts").mapInArrow(run, schema).groupBy("term").agg(F.sum("df").alias("df"))
    found = {r["term"]: r["df"] for r in counts.collect()}
    vocabulary.destroy()
    return found


def _seeds(blocks, shared):
    """The blocks with the largest bounds of each item."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("number", "bound", "block")])

    def run(batches):
        items = common.opened(shared)
        best = [[] for _ in items.numbers]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                bounds = _Block(row, items).bounds
                for i in np.flatnonzero(bounds).tolist():
                    best[i] = sorted([*best[i], (-int(bounds[i]), row["block"])])[:SEEDS]
        rows = [(n, -bound, block) for n, found in zip(items.numbers, best) for bound, block in found]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=pa.schema([(c, pa.int64()) for c in schema.names]))

    found = blocks.select("m", "block", "terms", "tops").mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("bound"), "block"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= SEEDS).select("block").distinct()


def _hits(blocks, shared, k, least):
    """Rows (number, score, key): of each task the best ``k`` hits of each item that reach its ``least``."""
    key = blocks.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("score", T.LongType()), T.StructField("key", key)])

    def run(batches):
        items = common.opened(shared)
        best = _Best(items, k, least)
        key_type = pa.null()
        for batch in batches:
            key_type = batch.schema.field("keys").type.value_type
            for found in _opened(batch, items):
                bounds = np.array([b.bounds for b in found])
                for item, places in enumerate(items.places):
                    for j in np.argsort(-bounds[:, item], kind="stable").tolist():
                        if bounds[j, item] < best.least[item]:
                            break
                        best.add(item, found[j].scores(places, items.weights), found[j].row["keys"])
        rows = [(n, int(s), key) for n, hits in zip(items.numbers, best.hits) for s, key in hits]
        if rows:
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], key_type)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return blocks.mapInArrow(run, schema)


def _ranked(hits, k):
    best_first = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("key"))
    return hits.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def _search_block(index, rows, k):
    """Hits of a block of items."""
    items = Items(rows)
    items.weigh(_document_counts(index.blocks, items), index.documents)
    if not len(items.vocabulary):
        return None
    shared = common.share(index.blocks.sparkSession, items)
    seeds = index.blocks.join(F.broadcast(_seeds(index.blocks, shared)), "block", "left_semi")  # SEEDS blocks an item
    last = _ranked(_hits(seeds.select(*index.blocks.columns), shared, k, {}), k).filter(F.col("rank") == k)
    least = {r["number"]: r["score"] for r in last.select("number", "score").collect()}
    found = write_and_read(_ranked(_hits(index.blocks, shared, k, least), k), "lexical-hits")
    shared.destroy()
    return found


def search(index, items, key="item_id", text="text", k=50, result_key="doc_id"):
    """Rows (item key, rank, document key, score): the ``k`` best documents of every row of ``items``.

    Only documents with a score above 0 are hits; equal scores are ranked by key, nulls first. Every row of ``items`` is
    an item: rows with equal or null keys are ranked each for itself. Items without terms (null and empty texts, or only
    signs) have no hits, nor has anything in an empty index. Items are searched for in blocks of ``QUERY_TERMS`` terms
    counted beforehand (an item is never split), every block reads the index once more. Other columns are not looked at.
    """
    narrow = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    found = common.annotate(narrow, "text", _terms, [T.StructField("terms", T.ArrayType(T.LongType()))], keep=["key"])
    found = found.select("row.key", "terms", F.size("terms").cast("long").alias("size")).filter("size > 0")
    listed = write_and_read(found.withColumn("number", F.monotonically_increasing_id()), "search-items")
    ranged = common.sorted_ranges(listed.select("number", "size"), ["number"], "search-ranges")
    summed = common.prefix_sums(ranged, ["number"], ["size"])
    blocks = write_and_read(summed.select("number", F.expr(f"before_size div {QUERY_TERMS}").alias("block")), "search-blocks")
    hits = None
    for (block,) in blocks.select("block").distinct().orderBy("block").collect():
        rows = listed.join(blocks.filter(F.col("block") == block), "number", "left_semi").collect()
        rows.sort(key=lambda r: r["number"])
        part = _search_block(index, rows, k)
        if part is not None:
            hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        empty = T.StructType([T.StructField(c, T.LongType()) for c in ("number", "score")] + [
            T.StructField("key", index.blocks.schema["keys"].dataType.elementType), T.StructField("rank", T.IntegerType())])
        hits = items.sparkSession.createDataFrame([], empty)
    names = listed.select("number", F.col("key").alias("item"))
    return hits.join(names, "number").select(
        F.col("item").alias(key), F.col("rank").cast("int").alias("rank"), F.col("key").alias(result_key), "score"
    )
