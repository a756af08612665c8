import math
import random
from hashlib import md5

import numpy as np
import pytest

import textharbor.operators.sparse as sparse
from textharbor import build_sparse_index, encode_sparse, sparse_topk

WORDS = [f"w{i}" for i in range(60)] + ["the"] * 40


def entries_of(text, dim):
    sums = {}
    for word in text.lower().split():
        digits = md5(word.encode()).hexdigest()
        bucket = int(digits[:8], 16) % dim
        sums[bucket] = sums.get(bucket, 0) + 1 - 2 * (int(digits[8], 16) % 2)
    sums = {b: s for b, s in sums.items() if s}
    length = math.sqrt(sum(s * s for s in sums.values()))
    return {b: float(np.float32(s / length)) for b, s in sums.items()}


def plainly(queries, docs, k):
    out = []
    for i, q in queries:
        scored = []
        for key, d in docs:
            score = sum(w * d[b] for b, w in q.items() if b in d)
            scored.append((-math.floor(score * 1e7 + 0.5), key))
        out += [(i, key, rank) for rank, (_, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def frame(spark, rows, name):
    listed = [(i, list(e.items())) for i, e in rows]
    return spark.createDataFrame(listed, f"{name} long, entries array<struct<bucket: int, weight: float>>").repartition(3)


def found(spark, queries, docs, k, **options):
    index = build_sparse_index(frame(spark, docs, "doc_id"))
    hits = sparse_topk(frame(spark, queries, "query_id"), index, k, **options).collect()
    return sorted((h.query_id, h.doc_id, h["rank"]) for h in hits)


def corpus(rng, n, dim):
    return [(i, entries_of(" ".join(rng.choices(WORDS, k=rng.randint(0, 40))), dim)) for i in range(n)]


@pytest.mark.parametrize("rows, entries, dim", [(8192, 1 << 20, 1 << 18), (7, 1 << 20, 1 << 18), (50, 60, 64)])
def test_equals_all_pairs(spark, monkeypatch, rows, entries, dim):
    monkeypatch.setattr(sparse, "PART_ROWS", rows)
    monkeypatch.setattr(sparse, "PART_ENTRIES", entries)
    rng = random.Random(rows)
    docs, queries = corpus(rng, 200, dim), corpus(rng, 25, dim)
    docs += [(300, docs[0][1]), (301, docs[0][1]), (302, {})]  # ties go to the smaller key
    for k in (1, 6):
        assert found(spark, queries, docs, k) == plainly(queries, docs, k)


def test_queries_are_taken_in_parts(spark):
    rng = random.Random(3)
    docs, queries = corpus(rng, 60, 1 << 18), corpus(rng, 20, 1 << 18)
    assert found(spark, queries, docs, 3, max_query_bytes=2000) == plainly(queries, docs, 3)


def test_empty_tables(spark):
    docs = corpus(random.Random(4), 10, 64)
    assert found(spark, [], docs, 3) == [] and found(spark, docs[:3], [], 3) == []


def test_lists_without_a_chance_are_skipped():
    """Once the floor is out of reach of the rest, documents outside are not scored, and parts below it not opened."""
    rng = random.Random(5)
    docs = corpus(rng, 100, 64)
    rows = np.repeat(np.arange(100), [len(d) for _, d in docs])
    buckets = np.array([b for _, d in docs for b in d], np.int32)
    weights = np.array([w for _, d in docs for w in d.values()], np.float32)
    names = ("buckets", "starts", "most", "least", "places", "weights")
    part = sparse._Part(dict(zip(names, sparse._postings(rows, buckets, weights))) | {"keys": [i for i, _ in docs]})
    query = docs[7][1]
    asked = np.array(list(query), np.int32), np.array(list(query.values()), np.float32)
    everything = part.best(*asked, 100, -np.inf)
    assert [(h[1], -h[0]) for h in everything[:3]] == [(h[1], -h[0]) for h in part.best(*asked, 3, -everything[2][0])]
    assert part.best(*asked, 3, 3e7) == []
    for floor in (-h[0] for h in everything[:20]):
        assert [h[:2] for h in part.best(*asked, 100, floor)] == [h[:2] for h in everything if -h[0] >= floor]


def test_encoding(spark):
    texts = [(1, "The the w1 W2 ü"), (2, ""), (3, None), (4, "  ")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.entries for r in encode_sparse(df, "text", sparse.SparseHashingEncoder(1000)).collect()}
    assert got[3] is None and got[2] == got[4] == []
    wanted = entries_of("The the w1 W2 ü", 1000)
    assert {e.bucket: e.weight for e in got[1]} == pytest.approx(wanted)
    assert [e.bucket for e in got[1]] == sorted(wanted)
