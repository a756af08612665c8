import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from textharbor.llm import manifest

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("part", T.StringType()),  # names that the operator uses itself
    T.StructField("lo", T.StringType()),
    T.StructField("children", T.StringType()),
])


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """All levels of a tree over digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, k):
    steps = []
    for nodes in levels[:-1]:
        first = k // 8 * 8
        steps.append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 8])))
        k //= 8
    return steps


def plainly(rows):
    def change(row):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]) if row[4] else row[4]
        return leaf((*row[:4], low)) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 else None

    parts = {}
    for row in rows:
        parts.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), change(row) or "", row))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda x: x[:4])
        trees[name] = climb([x[2] for x in parts[name]])
    top = climb([trees[name][-1][0] for name in names]) if names else []
    out = []
    for p, name in enumerate(names):
        for k, (_, _, digest, changed, row) in enumerate(parts[name]):
            steps = way(trees[name], k) + way(top, p)
            at = changed or digest
            for left, right in steps:
                at = h(left, at, right)
            root = top[-1][0]
            out.append((row[0], digest, trees[name][-1][0], root, h(*[a + b for a, b in steps]), at, at == root))
    return out


def compare(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in manifest.tamper_report(frame).collect()]
    assert sorted(got, key=repr) == sorted(plainly(rows), key=repr)
    return got


def test_against_plain_trees(spark):
    rng = random.Random(3)
    rows = []
    for i in rng.sample(range(5000), 300):
        text = rng.choice([None, "", "plain", "Größe ÄÖ A", f"Text {i}", "x" * 50 + "Z"])
        rows.append((i, rng.choice([None, "", "web"]), rng.choice(["en"] * 8 + ["de", None, "", "é"]), rng.choice([None, i]), text))
    rows += [(None, None, None, None, None), (None, "web", "en", 3, "ABC"), rows[0], rows[0]]
    got = compare(spark, rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_sizes_around_full_runs(spark, n):
    compare(spark, [(i, "web", "en", i, f"Text {i}") for i in range(n)])


def test_many_parts(spark):
    compare(spark, [(i, "web", f"l{i % 70}", i, f"Text {i}") for i in range(150)])


def test_a_very_long_text(spark):
    compare(spark, [(i, "web", "en", 0, "Long text, ÄÖ. " * n) for i, n in enumerate((1, 200_000, 3))])


def test_nodes_cover_their_leaves(spark):
    rows = [(i, None, "en" if i % 4 else "de", None, str(i)) for i in range(100)]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    leaves = frame.selectExpr("lang AS part", "doc_id AS id", "sha2(text, 256) AS digest")
    nodes = manifest.build(leaves).nodes().collect()
    for part, size in (("en", 75), ("de", 25)):
        for level in {n.level for n in nodes if n.part == part}:
            spans = sorted((n.lo, n.hi) for n in nodes if n.part == part and n.level == level)
            assert [lo for lo, _ in spans] == list(range(0, size, 8**level)) and spans[-1][1] == size - 1
            assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
