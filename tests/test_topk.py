import numpy as np
import pytest

import textharbor.operators.topk as topk
from textharbor import exact_topk

STRATEGIES = ("scan", "grid")


def frames(spark, queries, vectors, key="bigint", parts=3):
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id bigint, q array<float>")
    rows = [(k, [float(x) for x in v]) for k, v in vectors]
    return q, spark.createDataFrame(rows, f"doc_id {key}, embedding array<float>").repartition(parts)


def brute(queries, vectors, k):
    """Score at the shared resolution, then key."""
    out = []
    for i, q in enumerate(np.asarray(queries, np.float32).astype(np.float64)):
        scored = []
        for key, v in vectors:
            score = float(q @ np.asarray(v, np.float32).astype(np.float64))
            scored.append((-np.floor(score * 1e7 + 0.5), key, score))
        for rank, (_, key, score) in enumerate(sorted(scored)[:k], 1):
            out.append((i, key, round(score, 9), rank))
    return out


def run(q, v, k, **options):
    rows = exact_topk(q, v, k, **options).collect()
    return sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in rows)


def units(rng, n, dim):
    m = rng.normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("k", [1, 7])
def test_equals_brute_force(spark, monkeypatch, strategy, k):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    monkeypatch.setattr(topk, "QUERY_STEP", 16)
    rng = np.random.default_rng(1)
    queries, vectors = units(rng, 40, 24), list(enumerate(units(rng, 500, 24)))
    q, v = frames(spark, queries, vectors)
    assert run(q, v, k, strategy=strategy, block_rows=33, cells=3) == sorted(brute(queries, vectors, k))


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_a_third_of_all_rows_are_copies(spark, monkeypatch, strategy):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(2)
    hot = units(rng, 1, 8)[0]
    vectors = [(i, hot if i % 3 == 0 else v) for i, v in enumerate(units(rng, 300, 8))]
    queries = np.vstack([hot, -hot, units(rng, 3, 8)])
    q, v = frames(spark, queries, vectors)
    assert run(q, v, 5, strategy=strategy, block_rows=40) == sorted(brute(queries, vectors, 5))


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_ties_and_zero_vectors_go_to_the_smallest_key(spark, strategy):
    vectors = [("d", [1, 0]), ("b", [1, 0]), ("c", [0, 0]), ("a", [0, 1])]
    q, v = frames(spark, [[1, 0], [0, 0]], vectors, "string")
    assert run(q, v, 3, strategy=strategy) == [
        (0, "a", 0.0, 3),
        (0, "b", 1.0, 1),
        (0, "d", 1.0, 2),
        (1, "a", 0.0, 1),
        (1, "b", 0.0, 2),
        (1, "c", 0.0, 3),
    ]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_fewer_vectors_than_k_and_none_at_all(spark, strategy):
    q, v = frames(spark, [[1, 0]], [(1, [1, 0]), (2, [0, 1])])
    assert [r[1] for r in run(q, v, 5, strategy=strategy)] == [1, 2]
    assert run(q, v.filter("false"), 5, strategy=strategy) == []
    assert run(q.filter("false"), v, 5, strategy=strategy) == []


def test_scores_closer_than_float_resolution(spark, monkeypatch):
    """Products that 32-bit arithmetic would put in the wrong order."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(3)
    base = units(rng, 1, 48)[0]
    vectors = [(i, base + rng.normal(size=48) * 3e-7) for i in range(200)]
    q, v = frames(spark, [base], vectors)
    for strategy in STRATEGIES:
        assert run(q, v, 10, strategy=strategy) == sorted(brute([base], vectors, 10))


def test_first_document_wins_for_its_own_vector(spark):
    q, v = frames(spark, [[1, 0, 0, 0]], [("d1", [1, 0, 0, 0]), ("d2", [0, 1, 0, 0]), ("d3", [0, 0, 1, 0])], "string")
    hits = exact_topk(q, v, 2).orderBy("rank").collect()
    assert hits[0].doc_id == "d1" and hits[0].score > hits[1].score


def test_wrong_sizes_are_refused(spark):
    q, v = frames(spark, [[1, 0]], [(1, [1, 0, 0])])
    for strategy in STRATEGIES:
        with pytest.raises(Exception, match="2 numbers"):
            run(q, v, 1, strategy=strategy)
    mixed, ok = frames(spark, [[1, 0], [1, 0, 0]], [(1, [1, 0])])
    with pytest.raises(Exception, match="numbers"):
        run(mixed, ok, 1)


@pytest.mark.parametrize("wrong", [float("nan"), float("inf"), -float("inf")])
def test_numbers_that_are_not_finite_are_refused(spark, wrong):
    fine = [(i, [1, i]) for i in range(10)]
    for strategy in STRATEGIES:
        q, v = frames(spark, [[1, 0]], [*fine, (10, [wrong, 0])])
        with pytest.raises(Exception, match="split_by_dim"):
            run(q, v, 5, strategy=strategy)
        q, v = frames(spark, [[1, 0], [wrong, 0]], fine)
        with pytest.raises(Exception, match="split_by_dim"):
            run(q, v, 5, strategy=strategy)


def test_merging_in_two_steps_changes_nothing(spark, monkeypatch):
    q, v = frames(spark, [[1, 0], [0, 1], [1, 1]], [(i, [i % 7, i % 5]) for i in range(60)])
    for strategy in STRATEGIES:
        wanted = run(q, v.repartition(9), 4, strategy=strategy)
        with monkeypatch.context() as patch:
            patch.setattr(topk, "MERGE_TASKS", 2)
            patch.setattr(topk, "MERGE_BYTES", 0)
            patch.setattr(topk, "UNKNOWN_BYTES", 1 << 100)
            hits = exact_topk(q, v.repartition(9), 4, strategy=strategy)
            assert hits._jdf.queryExecution().optimizedPlan().toString().count("Window") >= 2
            assert run(q, v.repartition(9), 4, strategy=strategy) == wanted


def test_the_grid_moves_as_little_as_it_can():
    gb = 1 << 30
    for vectors, queries, cores in ((100 * gb, gb, 64), (gb, 100 * gb, 64), (gb, gb, 8), (10_000 * gb, 100 * gb, 1000)):
        cells, groups = topk._grid_shape(10**9, vectors, queries, cores)
        moved = queries * cells + vectors * groups
        tasks = cells * groups
        assert tasks >= 4 * cores
        assert all(moved <= 1.3 * (queries * c + vectors * -(-tasks // c)) for c in (1, 2, 8, 64, 512, 4096) if c <= tasks)
    assert topk._grid_shape(1, gb, gb, 8)[0] == 1


def test_arguments(spark):
    q, v = frames(spark, [[1, 0]], [(1, [1, 0])])
    with pytest.raises(ValueError):
        exact_topk(q, v, 0)
    with pytest.raises(ValueError):
        exact_topk(q, v, 1, strategy="best")


def test_large_query_tables_are_not_broadcast(spark):
    q, v = frames(spark, [[1, 0], [0, 1]], [(1, [1, 0]), (2, [0, 1])])
    small = exact_topk(q, v, 1)._jdf.queryExecution().executedPlan().toString()
    large = exact_topk(q, v, 1, max_query_bytes=100)._jdf.queryExecution().executedPlan().toString()
    assert "best_of_task" in small and "Join" not in small
    assert "SortMergeJoin" in large and "Cartesian" not in large and "NestedLoop" not in large


def test_only_the_best_rows_of_a_task_are_shuffled(spark):
    q, v = frames(spark, [[1, 0]], [(1, [1, 0])])
    plan = exact_topk(q, v, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1
