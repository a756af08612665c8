import pytest
from pyspark.sql import functions as F

from textharbor import keyed_lookup, run_dir, write_keyed
from textharbor.sources import keyed


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(20_000).select(
        (F.col("id") * 7).alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: F.rand(5)).cast("array<float>").alias("v")
    )
    return spark.read.parquet(write_keyed(rows, path=run_dir(spark, "keyed"), group_bytes=64 << 10, file_rows=6000))


def scanned(df):
    """Rows that the scans of a plan gave on."""
    df.collect()
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Scan" in node.nodeName():
            out += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_a_lookup_reads_few_rows(table):
    assert scanned(keyed_lookup(table, [7 * 1234])) < 0.05 * 20_000
    assert [r.doc_id for r in keyed_lookup(table, [7 * 1234]).collect()] == [7 * 1234]


def test_absent_keys_read_next_to_nothing(table):
    """Their range is there, only the bloom filters know."""
    missing = [7 * i + 1 for i in range(500, 19_000, 2500)]
    assert keyed_lookup(table, missing).count() == 0 and scanned(keyed_lookup(table, missing)) < 0.05 * 20_000


def test_long_lists_and_frames(spark, table, monkeypatch):
    keys = list(range(0, 9000, 9))
    wanted = [k for k in keys if k % 7 == 0]
    frame = spark.createDataFrame([(k,) for k in [*keys, *keys, None]], "doc_id long")
    for some in (keys, frame):
        assert sorted(r.doc_id for r in keyed_lookup(table, some).select("doc_id").collect()) == wanted
    near = list(range(70_000, 70_350, 7))
    assert scanned(keyed_lookup(table, near)) < 0.1 * 20_000
    monkeypatch.setattr(keyed, "PUSHED_KEYS", 3)
    assert sorted(r.doc_id for r in keyed_lookup(table, frame).select("doc_id").collect()) == wanted


def test_empty_lists_and_tables(spark, table):
    assert keyed_lookup(table, []).count() == 0 and keyed_lookup(table, [None]).count() == 0
    empty = spark.createDataFrame([], "doc_id long, v string")
    path = write_keyed(empty)
    assert keyed_lookup(spark.read.schema(empty.schema).parquet(path), [1]).count() == 0


def test_string_and_repeated_keys(spark):
    rows = spark.createDataFrame([(f"k{i % 50}", i) for i in range(200)] + [(None, -1)], "doc_id string, n long")
    found = keyed_lookup(spark.read.parquet(write_keyed(rows)), ["k7", "nothing"])
    assert sorted(r.n for r in found.collect()) == [7, 57, 107, 157]
