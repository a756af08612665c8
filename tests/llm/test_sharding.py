import zlib

from textharbor.llm import sharding

TEXTS = [(i, "ab" * (i % 7) + "é" * (i % 3)) for i in range(60)]
ROWS = TEXTS + [(None, "n"), (60, None), (61, ""), (5, "other"), (5, "other"), (62, "x" * 900)]


def check(rows, expected, shards):
    assert len(rows) == len(expected)
    total = sum(r["size"] for r in rows)
    by_shard = {}
    for r in rows:
        assert 0 <= r.shard < shards
        by_shard.setdefault(r.shard, []).append(r)
    largest = max(r["size"] for r in rows)
    for mine in by_shard.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / shards) <= 2 * largest
    order = [(r.shard, r.slot) for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32))]
    assert order == sorted(order)


def test_contiguous_and_balanced(spark, documents):
    rows = sharding.assign_shards(documents(ROWS), shards=7).collect()
    check(rows, ROWS, 7)
    sizes = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == sizes


def test_fewer_rows_than_shards(spark, documents):
    rows = sharding.assign_shards(documents([(1, "a"), (2, "b")]), shards=40).collect()
    assert sorted(r.shard for r in rows) == [10, 30] and {r.slot for r in rows} == {0}
    assert sharding.assign_shards(documents([])).count() == 0


def test_rows_with_their_places(spark, documents):
    df = documents(ROWS)
    rows = sharding.sharded_documents(df, shards=7).collect()
    assert len(rows) == len(ROWS) and len({(r.shard, r.slot) for r in rows}) == len(ROWS)
    assert sorted(map(str, (r.row.text for r in rows))) == sorted(str(t) for _, t in ROWS)
    for r in rows:
        assert r["size"] == len((r.row.text or "").encode()) + 16


def test_a_very_long_text(spark, documents):
    rows = [(i, "x") for i in range(20)] + [(20, "y" * 3_000_000)]
    got = {r.doc_id: r for r in sharding.assign_shards(documents(rows), shards=5).collect()}
    assert got[20]["size"] == 3_000_016 and got[20].shard == 2 and {got[i].shard for i in range(20)} == {0}
