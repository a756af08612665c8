"""Tables laid out for point lookups: sorted by key in small row groups, with bloom filters.

A lookup of some keys reads the row groups whose range and bloom filter admit one of them, which is a few of many; the
rest of the table is not read. The filters cost about ten bits a key.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textharbor.session import run_dir

#: Bytes of a row group, the least that a lookup reads of a file, and rows of a file.
GROUP_BYTES = 1 << 20
FILE_ROWS = 1 << 20
#: Keys that a lookup hands to the scan; more are joined.
PUSHED_KEYS = 1000
#: Keys that Spark pushes as single values.
SLICE = 10


def write_keyed(rows, key="doc_id", path=None, group_bytes=GROUP_BYTES, file_rows=FILE_ROWS):
    """Write ``rows`` sorted by ``key``, below the shared folder or at ``path``; returns the path.

    Rows are dealt into ranges of the key, about ``file_rows`` each. Rows with one key stay in one range.
    """
    path = path or run_dir(rows.sparkSession, "keyed")
    files = max(1, -(-rows.count() // file_rows))
    ordered = rows.repartitionByRange(files, key).sortWithinPartitions(key)
    writer = ordered.write.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer = writer.option(f"parquet.bloom.filter.expected.ndv#{key}", str(file_rows))
    # Row groups are closed by size, checked often enough for large rows.
    writer = writer.option("parquet.block.size", str(group_bytes)).option("parquet.page.size.row.check.min", "10")
    writer.option("parquet.block.size.row.check.min", "10").option("parquet.block.size.row.check.max", "1000").parquet(path)
    return path


def lookup(table, keys, key="doc_id"):
    """Rows of a table whose ``key`` is among ``keys``: a list, or a DataFrame with that column.

    Up to ``PUSHED_KEYS`` distinct keys are handed to the scan, which skips files and row groups with them; more are
    joined. NULL keys find nothing.
    """
    if isinstance(keys, DataFrame):
        some = keys.select(key).filter(F.col(key).isNotNull()).distinct().limit(PUSHED_KEYS + 1).toArrow()[key].to_pylist()
        if len(some) > PUSHED_KEYS:
            return table.join(keys.select(key).distinct(), key, "left_semi")
    else:
        some = sorted({k for k in keys if k is not None})
    if not some:
        return table.limit(0)
    # A long list is pushed as its range only, so the scan gets it in slices, any of which may admit a row group.
    some = sorted(some)
    slices = [F.col(key).isin(some[i : i + SLICE]) for i in range(0, len(some), SLICE)]
    return table.filter(reduce(lambda a, b: a | b, slices))
