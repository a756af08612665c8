"""Near-duplicate documents: one-permutation hashing, banded buckets, star-shaped candidates, exact confirmation.

One hash of every shingle gives both its bin and its value; a bin keeps its smallest value, and empty bins borrow from
bins drawn at random (optimal densification). Bands of bins are bucket keys. Within a bucket candidates form stars:
members are compared with two hubs, the member with most bucket mates overall and the one with the smallest key, so a
bucket gives at most two pairs a member. Pairs are confirmed on full shingle sets. Buckets that still hold several
components get other hubs, round after round, as long as rounds find links. What is open then is settled for certain:
all members of a bucket that lie in different components are compared, pair by pair in small buckets, and in larger
ones block against block, where the intersections of all sets of two blocks are one product of 0/1 matrices.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.llm import common
from textharbor.llm.components import connected_components
from textharbor.session import write_and_read

BINS = 256
BAND_ROWS = 5
BANDS = BINS // BAND_ROWS

SMALL_BUCKET = 8  # members up to which an open bucket is compared by pairs of keys
BLOCK_BYTES = 8 << 20  # sets of one side that a task compares at once
ROW_BYTES = 8 << 10  # a smaller set counts as so many bytes, which bounds the rows of a block
COLUMNS = 2048  # shingles multiplied at once

_LOWER = common.lowered_table()
_SPACE = common.byte_table(common.SPACE_BYTES)
_BIN_SHIFT = np.uint64(64 - 8)  # the top bits of a hash are its bin


def _orders():
    """For each bin, all bins in a random order: where it looks for a value if it is empty."""
    rng = np.random.default_rng(20170817)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)]).astype(np.uint8)


_ORDERS = _orders()


def shingle_sets(data, offsets, size):
    """Sorted distinct shingle hashes of all rows of a piece, and the row of each.

    Shingles are ``size`` consecutive words; a row with fewer words, but not none, has all of them as its one shingle.
    """
    lower = _LOWER[data]
    starts, ends, rows = common.word_bounds(~_SPACE[lower], offsets)
    sums = common.prefix_hashes(common.span_hashes(common.prefix_hashes(lower), starts, ends))
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    begins = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(max(0, len(starts) - size + 1))
    first = first[rows[first] == rows[first + size - 1]] if len(first) else first
    short = np.flatnonzero((counts > 0) & (counts < size))
    hashes = np.concatenate([
        common.span_hashes(sums, first, first + size), common.span_hashes(sums, begins[short], begins[short + 1])
    ])
    owner = np.concatenate([rows[first], short])
    by_row = np.argsort(owner, kind="stable")
    hashes, owner = hashes[by_row], owner[by_row]
    edges = np.searchsorted(owner, np.arange(len(offsets)))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if hi - lo > 1:
            hashes[lo:hi].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], owner[fresh]


def _row_sums(values, owner, rows):
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    edges = np.searchsorted(owner, np.arange(rows + 1))
    return sums[edges[1:]] - sums[edges[:-1]]


def _set_sums(hashes, owner, rows):
    """Two sums over the spread hashes of each set, 128 bits that tell sets apart."""
    salt = np.uint64(0x5851F42D4C957F2D)
    spread = common.mixed(hashes ^ salt), common.mixed(hashes + salt)
    return [_row_sums(x, owner, rows).view(np.int64) for x in spread]


def sketches(hashes, owner, rows):
    """The smallest hash in each bin of each row, empty bins filled; rows without shingles stay all zero."""
    sketch = np.zeros((rows, BINS), np.uint64)
    full = np.zeros((rows, BINS), bool)
    bins = (hashes >> _BIN_SHIFT).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (owner[1:] != owner[:-1])
    sketch[owner[first], bins[first]] = hashes[first]
    full[owner[first], bins[first]] = True
    row, bin_ = np.nonzero(~full & full.any(axis=1, keepdims=True))
    for attempt in range(BINS):
        if not len(row):
            break
        source = _ORDERS[bin_, attempt]
        found = full[row, source]
        sketch[row[found], bin_[found]] = sketch[row[found], source[found]]
        row, bin_ = row[~found], bin_[~found]
    return sketch


def band_keys(sketch):
    """One bucket key for each band of each row."""
    bands = sketch[:, : BANDS * BAND_ROWS].reshape(len(sketch), BANDS, BAND_ROWS)
    odd = common.mixed(np.arange(1, BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    number = common.mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(1000))
    return common.mixed((common.mixed(bands) * odd).sum(axis=2, dtype=np.uint64) + number)


def _sketch_columns(size):
    def run(array):
        out = [[], [], [], []]
        for _, data, offsets in common.pieces(array):
            rows = len(offsets) - 1
            hashes, owner = shingle_sets(data, offsets, size)
            counts = np.bincount(owner, minlength=rows)
            high, low = _set_sums(hashes, owner, rows)
            keys = band_keys(sketches(hashes, owner, rows)).view(np.int64)
            out[0].append(counts)
            out[1].append(high)
            out[2].append(low)
            out[3].append(keys)
        counts, high, low = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out[:3]]
        flat = np.concatenate(out[3]).ravel() if out[3] else np.zeros(0, np.int64)
        bands = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), flat)
        return [pa.array(counts, pa.int64()), pa.array(high), pa.array(low), bands]

    return run


def sketch_documents(df, key, text, size):
    """Rows (key, n, set_high, set_low, bands): the number of shingles, a 128-bit sum of the set, and bucket keys."""
    long = T.LongType()
    fields = [T.StructField(c, long) for c in ("n", "set_high", "set_low")]
    fields.append(T.StructField("bands", T.ArrayType(long)))
    rows = common.annotate(df, text, _sketch_columns(size), fields, keep=[key])
    return rows.select(F.col("row").getField(key).alias("key"), *[f.name for f in fields])


def _full_sets(size):
    def run(array):
        shingles, sums = [], [[], []]
        for _, data, offsets in common.pieces(array):
            hashes, owner = shingle_sets(data, offsets, size)
            edges = np.searchsorted(owner, np.arange(len(offsets)))
            shingles.extend(hashes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:]))
            for into, got in zip(sums, _set_sums(hashes, owner, len(offsets) - 1)):
                into.append(got)
        high, low = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in sums]
        return [pa.array(high), pa.array(low), pa.array(shingles, pa.binary())]

    return run


def _confirm(percent):
    """Keep pairs (a, b, set_a, set_b) of which 100 * intersection reaches ``percent`` * union."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                at = np.searchsorted(x, y)
                both = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)) if len(x) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs, sets, percent):
    """Links among candidate pairs (a, b); ``sets`` are rows (key, shingles)."""
    pair_type = pairs.schema["a"].dataType
    first = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = first.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("set_b")), "b")
    schema = T.StructType([T.StructField("a", pair_type), T.StructField("b", pair_type)])
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), schema)


def _stars(members, hub, allowed=None):
    """Distinct pairs (a > b) of members with the hub that ``hub`` (an aggregate) picks in each bucket."""
    hubs = common.moved_apart(members.groupBy("bucket").agg(hub.alias("hub")), "bucket")
    joined = members.join(hubs, "bucket")
    pairs = joined.filter(F.col("node") != F.col("hub.node"))
    if allowed is not None:
        pairs = pairs.filter(allowed)
    return pairs.select(
        F.greatest("node", "hub.node").alias("a"), F.least("node", "hub.node").alias("b")
    ).distinct()


def _open_members(members, components):
    """Rows of ``members`` with their component, in buckets that hold several components."""
    labelled = members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = common.moved_apart(mixed, "bucket")
    return labelled.join(mixed.filter("lo <> hi").select("bucket"), "bucket", "left_semi")


def _small_pairs(members):
    """Distinct pairs (a > b) of nodes of different components that share a bucket."""
    other = members.select("bucket", F.col("node").alias("b"), F.col("component").alias("other"))
    pairs = members.join(other, "bucket").filter((F.col("node") > F.col("b")) & (F.col("component") != F.col("other")))
    return pairs.select(F.col("node").alias("a"), "b").distinct()


def _intersections(left, right):
    """The size of the intersection of each set on the left with each on the right."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    distinct, column = np.unique(np.concatenate(sets), return_inverse=True)
    first = owner < len(left)
    both = np.bincount(column[first], minlength=len(distinct)) > 0
    both &= np.bincount(column[~first], minlength=len(distinct)) > 0
    keep = both[column]
    owner, column = owner[keep], (np.cumsum(both) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2**24 are exact
    for at in range(0, int(both.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[owner[lo:hi], column[lo:hi] - at] = 1
        out += table[: len(left)] @ table[len(left) :].T
    return out.astype(np.int64)


def _cell_links(percent):
    """Links (a, b) between components of one cell; of links that close a circle none but the first."""

    def run(table):
        codes = pa.concat_arrays(table.column("component").chunks).dictionary_encode()
        component, minor = codes.indices.to_numpy(), table.column("minor").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(left) and len(right):
            sizes = np.array([len(x) for x in sets])
            both = _intersections([sets[i] for i in left], [sets[i] for i in right])
            linked = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
            linked &= component[left][:, None] != component[right][None, :]
            x, y = np.nonzero(linked)
            a, b = np.unique(np.stack([component[left[x]], component[right[y]]]), axis=1)
        parent, chosen = list(range(len(codes.dictionary))), []
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[x] = y
                chosen.append(i)
        return pa.table({"a": codes.dictionary.take(pa.array(a[chosen])), "b": codes.dictionary.take(pa.array(b[chosen]))})

    return run


def _block_links(members, sets, percent):
    """Links (a, b) between components that share a bucket; ``members`` are open and written.

    In each bucket all members outside its largest component meet all members. Either side is dealt to blocks by hash,
    and each pair of blocks is a cell, compared whole by one task. A member outside goes to as many cells as there are
    blocks of all members, any member to as many as there are blocks of members outside.
    """
    counted = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("times"))
    largest = counted.groupBy("bucket").agg(F.max(F.struct("times", "component")).alias("largest"))
    sizes = sets.select(F.col("key").alias("node"), F.greatest("bytes", F.lit(ROW_BYTES)).cast("long").alias("bytes"))
    rows = members.join(sizes, "node").join(largest, "bucket")
    rows = rows.withColumn("outside", F.col("component") != F.col("largest.component"))
    blocks = rows.groupBy("bucket").agg(
        F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"),
        F.ceil(F.sum(F.when(F.col("outside"), F.col("bytes"))) / BLOCK_BYTES).cast("int").alias("outside_blocks"),
    )
    rows = rows.select("bucket", "node", "component", "outside").join(blocks, "bucket")
    own = [F.pmod(F.xxhash64("node"), F.col(c)).cast("int") for c in ("outside_blocks", "blocks")]
    every = [F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("outside_blocks", "blocks")]
    cells = rows.filter("outside").select("node", "component", "bucket", own[0].alias("i"), every[1].alias("j"), F.lit(True).alias("minor"))
    cells = cells.unionByName(
        rows.select("node", "component", "bucket", every[0].alias("i"), own[1].alias("j"), F.lit(False).alias("minor"))
    )
    # One row a node while sets are joined, so that each set is moved to its node once.
    cells = cells.groupBy("node", "component").agg(F.collect_list(F.struct("bucket", "i", "j", "minor")).alias("cells"))
    full = cells.join(sets.select(F.col("key").alias("node"), "shingles"), "node")
    full = full.select(F.explode("cells").alias("cell"), "component", "shingles").select("cell.*", "component", "shingles")
    kind = members.schema["component"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return full.groupBy("bucket", "i", "j").applyInArrow(_cell_links(percent), schema).distinct()


def near_duplicates(df, key="doc_id", text="text", size=3, percent=85):
    """Rows (key, n_shingles, component_id, kept) for every row of ``df``.

    Words are runs without ASCII white space, A-Z in lower case; a document's set are its distinct ``size``-word
    shingles. Documents are linked where 100 * intersection >= ``percent`` * union of their full sets, and
    ``component_id`` is the smallest key reachable over links. Null and empty texts and texts without words have no
    shingles and no links. Rows with one key are one document; if their texts differ, one of them stands for it in
    links. Rows with a null key stay unlinked, have a null component and are kept. Equal sets are one node throughout, so copies of any number cost one
    row each. Columns beside the two named are not looked at. An empty table gives an empty result.

    Two documents at the threshold share none of the 51 bands with a chance below 1e-12; every pair that shares one
    is compared, or found connected by other links.
    """
    sketched = write_and_read(sketch_documents(df, key, text, size), "sketches")
    known = sketched.filter("key is not null and n > 0")
    identity = ["n", "set_high", "set_low"]
    repeated = known.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").limit(1).count() > 0
    if repeated:
        chosen = known.groupBy("key").agg(F.min(F.struct("set_high", "set_low")).alias("c")).select("key", "c.*")
        known = known.join(chosen, ["key", "set_high", "set_low"]).dropDuplicates(["key"])
    nodes = known.groupBy(*identity).agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("times"))
    # Written, so that the join stands alone and Spark can split the rows of a set with very many copies.
    copies = write_and_read(nodes.filter("times > 1").drop("times"), "copies")
    placed = known.join(copies, identity, "left").withColumn("node", F.coalesce("node", "key"))
    own = write_and_read(placed.select("key", "node"), "nodes")

    # bands of one row for each distinct set
    firsts = placed.filter("key = node").select("node", "bands")
    bands = firsts.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("mates")).filter("mates > 1")
    members = write_and_read(bands.join(shared, "bucket").select("bucket", "node", "mates"), "buckets")
    degrees = members.groupBy("node").agg(F.sum("mates").alias("degree"))
    members = write_and_read(members.join(degrees, "node").select("bucket", "node", "degree"), "members")

    texts = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    wanted = degrees.select(F.col("node").alias("key"))
    fields = [T.StructField(c, T.LongType()) for c in ("set_high", "set_low")]
    full = common.annotate(
        texts.join(wanted, "key", "left_semi"), "text", _full_sets(size),
        [*fields, T.StructField("shingles", T.BinaryType())], keep=["key"],
    )
    sets = full.select("row.key", "set_high", "set_low", "shingles")
    if repeated:
        sets = sets.join(chosen, ["key", "set_high", "set_low"], "left_semi").dropDuplicates(["key"])
    sets = write_and_read(sets.select("key", "shingles", F.octet_length("shingles").alias("bytes")), "sets")

    by_degree = F.max_by(F.struct("node"), F.struct("degree", F.xxhash64("node")))
    by_key = F.min(F.struct("node"))
    pairs = _stars(members, by_degree).unionByName(_stars(members, by_key)).distinct()
    tested = [write_and_read(pairs, "pairs")]
    components = connected_components(write_and_read(confirmed(tested[0], sets, percent), "links"))
    number = 0
    while True:
        number += 1
        open_ = _open_members(members, components)
        hub = F.max_by(F.struct("node", "component"), F.xxhash64("node", F.lit(number)))
        new = _stars(open_, hub, F.col("component") != F.col("hub.component"))
        for old in tested:
            new = new.join(old, ["a", "b"], "left_anti")
        tested.append(write_and_read(new, "pairs"))
        found = write_and_read(confirmed(tested[-1], sets, percent), "links")
        if not found.limit(1).count():
            break
        stars = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
        components = connected_components(stars.unionByName(found))

    # What hubs left open: every pair of members of different components that was not compared.
    open_ = _open_members(members, components)
    mates = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("mates"))
    open_ = write_and_read(open_.join(mates, "bucket").select("bucket", "node", "component", "mates"), "open")
    rest = _small_pairs(open_.filter(F.col("mates") <= SMALL_BUCKET))
    for old in tested:
        rest = rest.join(old, ["a", "b"], "left_anti")
    found = confirmed(write_and_read(rest, "pairs"), sets, percent)
    large = open_.filter(F.col("mates") > SMALL_BUCKET).drop("mates")
    if large.limit(1).count():
        found = found.unionByName(_block_links(large, sets, percent))
    found = write_and_read(found, "links")
    if found.limit(1).count():
        stars = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
        components = connected_components(stars.unionByName(found))

    placed = own.join(components, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    rows = sketched.select("key", "n").join(placed, "key", "left")
    component = F.coalesce("component", "key")
    return rows.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(df, key="doc_id", text="text", **options):
    """``df`` with one document of each group of near duplicates: the one with the smallest key.

    Of rows that share a key one stays; rows with a null key all stay.
    """
    judged = near_duplicates(df, key, text, **options)
    judged = write_and_read(judged, "judged")
    gone = judged.filter("not kept").select(key).distinct()
    left = df.join(gone, key, "left_anti")
    kept = judged.filter(F.col("kept") & F.col(f"`{key}`").isNotNull())
    if kept.groupBy(key).count().filter("count > 1").limit(1).count():
        left = common.numbered(left, [key], [F.xxhash64(F.col(f"`{text}`").cast("string"))])
        left = left.filter(F.col("number").eqNullSafe(1) | F.col("row").getField(key).isNull()).select("row.*")
    return left
