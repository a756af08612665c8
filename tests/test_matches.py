import random

import pytest

from textharbor import bucket_keys, check_by_ranges, index_integrity, keyword_matches, score_histogram, score_pairs, score_quantiles
from textharbor.operators import matches
from textharbor.session import write_and_read


def sets(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, keywords array<string>").repartition(3)


def overlap(a, b):
    return len(a & b) / len(a | b) if a and b else 0


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.8, 1.0])
def test_matches_are_all_pairs_above_the_threshold(spark, threshold):
    rng = random.Random(int(threshold * 100))
    words = [f"w{i}" for i in range(40)] + ["hot"] * 25
    left = [(i, rng.choices(words, k=rng.randint(0, 12))) for i in range(120)] + [(900, None), (901, [])]
    right = [(i, rng.choices(words + ["only here"], k=rng.randint(0, 12))) for i in range(30)]
    right += [(800, left[5][1]), (801, left[5][1] * 2), (802, None)]
    got = keyword_matches(sets(spark, left, "doc_id"), sets(spark, right, "query_id"), threshold).collect()
    wanted = {
        (i, j, len(set(a) & set(b))) for i, a in left for j, b in right
        if a and b and overlap(set(a), set(b)) >= threshold
    }
    assert sorted((r.doc_id, r.query_id, r.shared) for r in got) == sorted(wanted)


def test_matches_compare_no_pair_without_a_rare_word(spark):
    left = sets(spark, [(i, ["hot", f"w{i}"]) for i in range(50)], "doc_id")
    right = sets(spark, [(i, ["hot", f"w{i}"]) for i in range(50)], "query_id")
    found = keyword_matches(left, right, 0.9)
    assert found.count() == 50
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_matches_refuse_a_threshold_of_nothing(spark):
    with pytest.raises(ValueError):
        keyword_matches(sets(spark, [], "doc_id"), sets(spark, [], "query_id"), 0)
    assert keyword_matches(sets(spark, [], "doc_id"), sets(spark, [], "query_id"), 0.5).count() == 0


def test_quantiles_and_histogram(spark):
    rng = random.Random(3)
    rows = [(q, rng.choice([rng.uniform(-1, 1), 0.25, -0.5])) for q in (1, 2, None) for _ in range(rng.randint(1, 200))]
    rows += [(7, 0.5)] + [(8, 0.25)] * 300 + [(9, None), (9, float("nan"))]
    scored = spark.createDataFrame(rows, "query_id long, score double").repartition(4)
    by_query = {}
    for q, s in rows:
        if s is not None and s == s:
            by_query.setdefault(q, []).append(s)
    shares = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {(r.query_id, r.share): round(r.quantile, 7) for r in score_quantiles(scored, shares=shares).collect()}
    wanted = {}
    for q, values in by_query.items():
        values.sort()
        for share in shares:
            place = next(i for i in range(len(values)) if (i + 1) >= share * len(values) - 1e-9)
            wanted[q, share] = round(values[place], 7)
    assert got == pytest.approx(wanted, abs=1.1e-7)
    bins = {}
    for q, values in by_query.items():
        for v in values:
            b = min(int((v + 1) / 0.1), 19)
            bins[q, b] = bins.get((q, b), 0) + 1
    assert {(r.query_id, r.bin): r.n for r in score_histogram(scored).collect()} == bins


def test_bucketed_tables_join_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, f"h{i}") for i in range(50)] + [(None, "x")], "doc_id long, content_hash string")
    held = spark.createDataFrame([(i, f"h{i % 40}") for i in range(20, 60)], "doc_id long, content_hash string")
    a, b = bucket_keys(docs, 4), bucket_keys(held, 4)
    assert sorted(r.doc_id for r in a.hits(b).collect()) == list(range(20, 40))
    assert {r.doc_id for r in a.misses(b).collect()} == {*range(20), *range(40, 50), None}
    assert sum(r.hit for r in a.flagged(b).collect()) == 20
    for joined in (a.hits(b), a.misses(b), a.flagged(b)):
        joined.collect()
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    for side in (a, b):
        side.forget()


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "doc_id long").repartition(3)


@pytest.mark.parametrize("docs, vectors", [
    (range(200), range(200)),
    (range(200), [*range(3, 200), 500]),
    ([*range(100), None], [*range(100), 5, 5]),
    ([], range(5)), (range(5), []), ([], []),
])
def test_ranges_find_what_the_whole_comparison_finds(spark, docs, vectors):
    docs, vectors = list(docs), list(vectors)
    checked = check_by_ranges(keys(spark, docs), keys(spark, vectors))
    assert checked.report.collect() == index_integrity(keys(spark, docs), keys(spark, vectors)).collect()
    different = {k for k in {*docs, *vectors} if docs.count(k) != vectors.count(k)}
    got = {r.doc_id: (r.documents, r.vectors) for r in checked.keys.collect()}
    assert got == {k: (docs.count(k), vectors.count(k)) for k in different}


def test_only_unequal_ranges_are_looked_into(spark):
    checked = check_by_ranges(keys(spark, range(3000)), keys(spark, range(1, 3000)))
    levels = {r.level: (r.ranges, r.unequal) for r in checked.levels.collect()}
    assert levels[0] == (1, 1) and all(r <= 16 and u == 1 for r, u in levels.values())


def test_pairs_are_scored_in_parts(spark):
    rows = [(i, [float(i), 1.0]) for i in range(20)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    q = v.selectExpr("doc_id AS query_id", "embedding AS q")
    for limit in (1 << 20, 100):
        got = {(r.query_id, r.doc_id): r.score for r in score_pairs(q, v, max_query_bytes=limit).collect()}
        assert got == {(i, j): i * j + 1.0 for i in range(20) for j in range(20)}
    assert score_pairs(q.limit(0), v).count() == 0


def test_words_of_either_side_are_found_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(matches, "write_and_read", lambda df, label: written.append(label) or write_and_read(df, label))
    left, right = sets(spark, [(1, ["a", "b"])], "doc_id"), sets(spark, [(2, ["b", "c"])], "query_id")
    assert [tuple(r) for r in keyword_matches(left, right, 0.3).collect()] == [(1, 2, 1, 1 / 3)]
    assert written.count("match-sets") == 2
