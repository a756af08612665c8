import numpy as np
import pyarrow as pa
import pytest
from test_topk import brute, frames, units

import textharbor.operators.pruned as pruned
from textharbor import cluster_vectors, pruned_topk
from textharbor.operators import topk


def run(q, v, k, centres=None, **options):
    index = cluster_vectors(v, centres=centres)
    hits, report = pruned_topk(q, index, k, **options)
    rows = sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in hits.collect())
    return rows, report.collect(), index


@pytest.mark.parametrize("k", [1, 7])
@pytest.mark.parametrize("centres", [None, 1, 60])
def test_equals_brute_force(spark, monkeypatch, k, centres):
    monkeypatch.setattr(pruned, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(1)
    queries, vectors = units(rng, 40, 24), list(enumerate(units(rng, 400, 24)))
    assert run(*frames(spark, queries, vectors), k, centres)[0] == sorted(brute(queries, vectors, k))


def test_blocks_of_other_clusters_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(pruned, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    middles = units(rng, 20, 32)
    points = np.repeat(middles, 30, axis=0) + rng.normal(scale=0.02, size=(600, 32))
    vectors = list(enumerate(points / np.linalg.norm(points, axis=1, keepdims=True)))
    rows, (report,), _ = run(*frames(spark, middles[:3], vectors), 5, 20)
    assert rows == sorted(brute(middles[:3], vectors, 5))
    assert report.blocks_read < report.blocks / 2 and report.pairs_compared < report.pairs / 4


def test_a_third_of_all_rows_are_copies(spark, monkeypatch):
    monkeypatch.setattr(pruned, "BLOCK_ROWS", 32)
    monkeypatch.setattr(pruned, "CELL_ROWS", 50)
    rng = np.random.default_rng(3)
    hot = units(rng, 1, 8)[0]
    vectors = [(i, hot if i % 3 == 0 else v) for i, v in enumerate(units(rng, 300, 8))]
    queries = np.vstack([hot, -hot, units(rng, 3, 8)])
    assert run(*frames(spark, queries, vectors), 5)[0] == sorted(brute(queries, vectors, 5))


def test_zero_vectors_and_few_rows(spark):
    vectors = [(3, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    queries = [[0.0, 0.0], [1.0, 0.0]]
    assert run(*frames(spark, queries, vectors), 5)[0] == sorted(brute(queries, vectors, 5))
    assert run(*frames(spark, queries, vectors), 1)[0] == sorted(brute(queries, vectors, 1))


def test_empty_tables(spark):
    q, v = frames(spark, [[1.0, 0.0]], [(1, [1.0, 0.0])])
    assert run(q, v.limit(0), 3)[0] == []
    assert run(q.limit(0), v, 3)[0] == []


def test_queries_are_taken_in_parts(spark):
    rng = np.random.default_rng(4)
    queries, vectors = units(rng, 30, 8), list(enumerate(units(rng, 100, 8)))
    rows, report, _ = run(*frames(spark, queries, vectors), 3, max_query_bytes=1000)
    assert rows == sorted(brute(queries, vectors, 3)) and len(report) > 5


def test_blocks_hold_near_vectors_within_their_radius(spark, monkeypatch):
    monkeypatch.setattr(pruned, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(5)
    _, v = frames(spark, [], list(enumerate(units(rng, 95, 6))))
    blocks = cluster_vectors(v).blocks.collect()
    assert sorted(k for b in blocks for k in b["keys"]) == list(range(95)) and max(b["size"] for b in blocks) <= 10
    for b in blocks:
        centre = np.frombuffer(b["centre"], np.float64)
        points = np.frombuffer(b["numbers"], np.float32).reshape(-1, 6)
        assert np.linalg.norm(points - centre, axis=1).max() <= b["radius"]


@pytest.mark.parametrize("wrong", [[1.0], [float("nan"), 0.0], None])

def test_unusable_vectors_are_refused(spark, wrong):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, wrong)], "doc_id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="numbers|NaN|split_by_dim"):
        cluster_vectors(v, dim=2).blocks.collect()


def test_many_small_offers_stay_few_tables():
    rng = np.random.default_rng(5)
    queries, best = np.array(units(rng, 8, 6), np.float32), None
    best = topk._Best(queries, 3)
    vectors = np.array(units(rng, 4000, 6), np.float32)
    for i in range(0, 4000, 2):
        best.add(pa.array([i, i + 1]), vectors[i : i + 2], np.arange(8))
        assert len(best.fresh) + len(best.merged) <= topk._OFFERS + 4000 // topk._OFFERS
    best.prune()
    scores = queries.astype(np.float64) @ vectors.astype(np.float64).T
    wanted = [row.argsort()[::-1][:3].tolist() for row in scores]
    assert best.kept["key"].to_pylist() == [key for row in wanted for key in row]


def test_bounds_in_steps_equal_bounds_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    matrix, centres, radii = np.array(units(rng, 50, 6), np.float32), rng.normal(size=(7, 6)), rng.random(7)
    norms = topk._norms(matrix)
    monkeypatch.setattr(pruned, "_ROWS_STEP", 8)
    at_once = centres @ matrix.astype(np.float64).T + radii[:, None] * norms
    assert np.allclose(pruned._bounds(matrix, norms, centres, radii), at_once, atol=1e-12)
    assert pruned._nearest(matrix[:0], centres).tolist() == []
