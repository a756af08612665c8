"""What the operators share: Arrow passes over texts, hashes of words, prefix sums over sorted ranges."""

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.session import write_and_read

#: Bytes of text that numpy works on at once inside a task; a longer text is one piece of its own.
PIECE_BYTES = 2 << 20

SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class _Powers:
    """Tables of powers, made anew in every process: functions sent to tasks do not carry them along."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def grow(self, n):
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        one = np.ones(1, np.uint64)
        self.up, self.down = [np.concatenate([one, np.cumprod(np.full(n, b))]) for b in (_BASE, inverse)]


_POWERS = _Powers()


def annotate(df, text, fn, fields, keep=None):
    """``row`` (a struct of the columns in ``keep``, all by default) and ``fields``, computed from the column ``text``.

    ``fn`` gets an Arrow string array and returns one Arrow array per field. Columns of the input may have any name:
    they stay inside ``row``.
    """
    keep = df.columns if keep is None else keep
    inside = text in keep
    columns = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")]
    if not inside:
        columns.append(F.col(f"`{text}`").cast("string").alias("text"))
    narrow = df.select(*columns)
    schema = T.StructType([narrow.schema["row"], *fields])
    names = schema.names

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            got = row.field(keep.index(text)) if inside else batch.column(1)
            yield pa.RecordBatch.from_arrays([row, *fn(got)], names=names)

    return narrow.mapInArrow(run, schema)


def share(spark, value):
    """A broadcast of any object together with its class, so that executors need nothing installed; see :func:`opened`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared):
    return pickle.loads(shared.value)


def as_text(array):
    """Strings; other types (a column of nulls only) as strings."""
    return array if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else array.cast(pa.string())


def raw(array):
    """UTF-8 bytes of a string array as one uint8 view, and the offsets of its rows; a null is empty."""
    array = as_text(array)
    if array.null_count:
        array = array.fill_null("")
    wide = np.int64 if pa.types.is_large_string(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], wide)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    return data[: offsets[-1]], offsets


def pieces(array, size=PIECE_BYTES):
    """Runs of whole rows of about ``size`` bytes: first row, bytes, offsets within these bytes."""
    data, offsets = raw(array)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def powers(n):
    """Powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    if len(_POWERS.up) < n:
        _POWERS.grow(max(n, PIECE_BYTES + 1))
    return _POWERS.up, _POWERS.down


def mixed(x):
    """Spread 64-bit numbers over all 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(values):
    """Sums from which :func:`span_hashes` makes the hash of any span of ``values``."""
    up, _ = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return sums


def span_hashes(sums, start, end):
    """Hashes of spans [start, end); equal spans have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start])


def word_bounds(is_word, offsets):
    """Starts and ends of the runs of word bytes, none across two rows, and the row of each."""
    if not len(is_word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(is_word))]
    first[inner] = is_word[inner]
    last[inner - 1] = is_word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lowered_table():
    """Bytes with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def byte_table(members):
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


def nulls_first(*columns):
    """An order in which nulls come first, for ranges and windows alike."""
    return [F.asc_nulls_first(c) if isinstance(c, str) else c.asc_nulls_first() for c in columns]


def sorted_ranges(df, order, label):
    """``df`` dealt into sorted ranges and written to the shared folder; ``pid`` numbers the ranges in order.

    Written, so that a lost executor cannot lead to other ranges. Rows with equal keys stay in one range, so the
    order should end in columns that tell rows apart.
    """
    dealt = df.repartitionByRange(*order).withColumn("pid", F.spark_partition_id())
    return write_and_read(dealt, label)


def prefix_sums(ranged, order, values, group=()):
    """Sums of ``values`` over all earlier rows of the group, as ``before_<value>``.

    Each range sums its own rows; totals of ranges (one row for each group and range) give what stands before it.
    """
    group = list(group)
    totals = ranged.groupBy(*group, "pid").agg(*[F.sum(v).alias(f"sum_{v}") for v in values])
    earlier = Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = totals.select(
        *group, "pid", *[F.coalesce(F.sum(f"sum_{v}").over(earlier), zero).alias(f"offset_{v}") for v in values]
    )
    inside = Window.partitionBy(*group, "pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), zero).alias(f"local_{v}") for v in values])
    joined = local.alias("l").join(
        offsets.alias("o"), [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*group, "pid"]]
    )
    return joined.select(
        "l.*", *[(F.col(f"local_{v}") + F.col(f"offset_{v}")).alias(f"before_{v}") for v in values]
    ).drop(*[f"local_{v}" for v in values])


def moved_apart(df, column):
    """``df`` with ``column`` written so that Spark does not see it is dealt by it already.

    A table grouped by a key and joined to the rows it was grouped from stays where it is; then Spark cannot split the
    join where one key has very many rows. Moved once more, which costs little as it has a row a key, it lets it.
    """
    return df.withColumn(column, F.get(F.array_repeat(column, 1), 0))


def numbered(df, keys, order):
    """``row`` (a struct of all columns) and ``number``, counting from 1 among rows with equal ``keys``."""
    inside = Window.partitionBy(*[F.col(f"`{k}`") if isinstance(k, str) else k for k in keys]).orderBy(*order)
    columns = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(columns.alias("row"), F.row_number().over(inside).alias("number"))


def attach(df, plan, keys, fields):
    """Rows (row, fields) of ``df`` joined one to one with the rows of ``plan``.

    ``keys`` are expressions over ``df``; ``plan`` has a column of each name. Rows with equal keys are interchangeable
    and paired off by number, which costs a sort only where such rows exist.
    """
    names = list(keys)
    several = plan.groupBy(*names).count().filter("count > 1").limit(1).count() > 0
    columns = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    left = df.select(columns.alias("row"), *[e.alias(f"key_{n}") for n, e in keys.items()])
    right = plan.select(*[F.col(n).alias(f"plan_{n}") for n in names], *fields)
    if several:
        left = left.withColumn(
            "key_number", F.row_number().over(Window.partitionBy(*[f"key_{n}" for n in names]).orderBy(F.lit(1)))
        )
        inside = Window.partitionBy(*[f"plan_{n}" for n in names]).orderBy(*fields)
        right = right.withColumn("plan_number", F.row_number().over(inside))
        names = [*names, "number"]
    on = [F.col(f"key_{n}").eqNullSafe(F.col(f"plan_{n}")) for n in names]
    return left.join(right, on).select("row", *fields)
