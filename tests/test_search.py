import json
import math

import duckdb
import numpy as np
import pytest
from paths import DATA
from pyspark.sql import functions as F

import oracles
from textharbor import (
    HashingEncoder,
    as_documents,
    describe_documents,
    encode,
    search,
    search_records,
    validate_queries,
)
from textharbor.operators.search import check_top_k
from textharbor.schema import LEXICON

ENCODER = HashingEncoder(128)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = as_documents(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text", filename="source")
    queries = spark.read.parquet(f"{DATA}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    return docs, encode(docs, "content", ENCODER).select("doc_id", "embedding"), queries


def by_sql(rows, **expressions):
    """Expressions over the column ``x`` of (key, x) rows, computed by DuckDB."""
    con = duckdb.connect()
    con.execute("CREATE TABLE t (key BIGINT, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    found = con.execute(f"SELECT key, {', '.join(expressions.values())} FROM t").fetchall()
    return {r[0]: dict(zip(expressions, r[1:])) for r in found}


def brute(corpus, k, length_normalize=False):
    docs, _, queries = corpus
    docs = {r.doc_id: r for r in docs.collect()}
    keys = sorted(docs)
    matrix = ENCODER.encode([docs[key].content for key in keys]).astype(np.float64)
    out = {}
    asked = queries.collect()
    words = oracles._keywords("x")
    shown = by_sql([(key, docs[key].content) for key in keys], keywords=words, preview=oracles._preview("x"))
    wanted = by_sql([(q.query_id, q.query) for q in asked], keywords=words)
    for q in asked:
        scores = matrix @ ENCODER.encode([q.query])[0].astype(np.float64)
        best = sorted(zip(keys, scores), key=lambda x: (-math.floor(x[1] * 1e7 + 0.5), x[0]))[:k]
        for rank, (key, score) in enumerate(best, 1):
            doc, qk, dk = docs[key], set(wanted[q.query_id]["keywords"]), set(shown[key]["keywords"])
            both, either = len(qk & dk), len(qk | dk)
            final = score / (1 + math.log1p(doc.doc_length / 1000)) if length_normalize else score
            out[q.query_id, rank] = {
                "doc_id": key,
                "score": round(final, 4),
                "raw_score": round(score, 4),
                "preview": shown[key]["preview"],
                "filename": doc.filename,
                "keywords": sorted(qk & dk),
                "overlap_ratio": both / either if either else 0.0,
                "doc_length": doc.doc_length,
            }
    return out


def same(hits, want, normalized=False):
    got = {(r.query_id, r["rank"]): r for r in hits.collect()}
    assert set(got) == set(want)
    for place, w in want.items():
        r = got[place]
        assert (r.doc_id, r.preview, r.filename) == (w["doc_id"], w["preview"], w["filename"])
        assert abs(r.score - w["score"]) < 1e-9 and abs(r.explanation.raw_score - w["raw_score"]) < 1e-9
        assert r.explanation.keywords == w["keywords"] and r.explanation.doc_length == w["doc_length"]
        assert abs(r.explanation.overlap_ratio - w["overlap_ratio"]) <= 5.1e-5
        assert r.explanation.length_normalized_score == (r.score if normalized else None)


def test_equals_brute_force(corpus):
    docs, vectors, queries = corpus
    same(search(queries, vectors, docs, ENCODER, top_k=5), brute(corpus, 5))


def test_length_normalized_keeps_raw_order(corpus):
    docs, vectors, queries = corpus
    hits = search(queries, vectors, docs, ENCODER, top_k=4, length_normalize=True)
    same(hits, brute(corpus, 4, True), normalized=True)


def test_beyond_the_broadcast_bound_nothing_changes(corpus):
    docs, vectors, queries = corpus
    hits = search(queries, vectors, docs, ENCODER, top_k=3, broadcast_bytes=0, cells=2)
    same(hits, brute(corpus, 3))
    assert "BroadcastExchange" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_narrow_documents_give_the_same(spark, corpus):
    docs, vectors, queries = corpus
    same(search(queries, vectors, describe_documents(docs), ENCODER, top_k=2), brute(corpus, 2))


def test_rerank(corpus):
    docs, vectors, queries = corpus
    rows = search(queries, vectors, docs, ENCODER, top_k=6, length_normalize=True, rerank=True).collect()
    unranked = search(queries, vectors, docs, ENCODER, top_k=6, length_normalize=True).collect()
    assert {(r.query_id, r.doc_id, r.score) for r in rows} == {(r.query_id, r.doc_id, r.score) for r in unranked}
    by_query = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(r.query_id, []).append(r.score)
    assert all(s == sorted(s, reverse=True) for s in by_query.values())


def test_basis_vectors(spark, science):
    vectors = spark.createDataFrame(
        [("physics", [1.0, 0.0, 0.0, 0.0]), ("biology", [0.0, 1.0, 0.0, 0.0]), ("chemistry", [0.0, 0.0, 1.0, 0.0])],
        "doc_id string, embedding array<float>",
    )
    queries = spark.createDataFrame(
        [(1, "energy of particles.", [1.0, 0.0, 0.0, 0.0])], "query_id int, query string, q array<float>"
    )
    hits = search(queries, vectors, science, top_k=2, total_docs=True).orderBy("rank").collect()
    assert [h.doc_id for h in hits] == ["physics", "biology"]
    assert hits[0].score == 1.0 > hits[1].score and hits[0].total_docs == 3
    assert hits[0].explanation.keywords == ["energy"]


def test_hits_without_a_document_disappear_after_the_limit(spark, science):
    vectors = spark.createDataFrame(
        [("ghost", [1.0, 0.0]), ("physics", [0.8, 0.6]), ("biology", [0.0, 1.0])], "doc_id string, embedding array<float>"
    )
    queries = spark.createDataFrame([(1, "x", [1.0, 0.0])], "query_id int, query string, q array<float>")
    hits = search(queries, vectors, science, top_k=2, explain=False, total_docs=True).collect()
    assert [(h.doc_id, h["rank"], h.total_docs) for h in hits] == [("physics", 2, 3)]
    assert "explanation" not in hits[0].asDict()


def test_expansion_changes_the_vector_but_not_the_keywords(spark, science):
    vectors = encode(science, "content", ENCODER).select("doc_id", "embedding")
    queries = spark.createDataFrame([(1, "Tiny bodies")], "query_id int, query string")
    lexicon = spark.createDataFrame([("tiny", 1, 1, "molecules"), ("bodies", 1, 1, "atoms.")], LEXICON)
    hits = search(queries, vectors, science, ENCODER, top_k=1, lexicon=lexicon).collect()
    assert [(h.doc_id, h.query, h.explanation.keywords) for h in hits] == [("chemistry", "Tiny bodies", [])]


def test_records(spark, corpus):
    docs, vectors, queries = corpus
    hits = search(queries, vectors, docs, ENCODER, top_k=1)
    record = json.loads(search_records(hits).first().record)
    assert set(record) >= {"doc_id", "score", "preview", "filename", "explanation"}
    assert set(record["explanation"]) >= {"keywords", "overlap_ratio", "doc_length", "raw_score"}


def test_validate_queries(spark):
    rows = [(1, "ok"), (2, ""), (3, "x" * 1000), (4, "x" * 1001), (5, None)]
    got = {r.query_id: (r.valid, r.reason) for r in
           validate_queries(spark.createDataFrame(rows, "query_id int, query string")).collect()}
    assert got == {1: (True, None), 2: (False, "too short"), 3: (True, None), 4: (False, "too long"), 5: (False, "too short")}


def test_top_k_bounds_hold_for_requests_only(spark, science):
    assert check_top_k(1) == 1 and check_top_k(100) == 100
    for wrong in (0, 101):
        with pytest.raises(ValueError):
            check_top_k(wrong)
    vectors = encode(science, "content", ENCODER).select("doc_id", "embedding")
    queries = spark.createDataFrame([(1, "energy")], "query_id int, query string")
    assert search(queries, vectors, science, ENCODER, top_k=101).count() == 3
    with pytest.raises(ValueError):
        search(queries, vectors, science, ENCODER, top_k=0)


def test_shared_keywords_can_be_bounded(spark, science):
    vectors = encode(science, "content", ENCODER).select("doc_id", "embedding")
    queries = spark.createDataFrame([(1, "molecules are made change")], "query_id int, query string")
    rows = [search(queries, vectors, science, ENCODER, top_k=1, max_keywords=n).first() for n in (None, 1)]
    assert rows[0].explanation.keywords[:1] == rows[1].explanation.keywords and len(rows[0].explanation.keywords) > 1


def test_documents_are_not_shuffled(spark, corpus):
    docs, vectors, queries = corpus
    hits = search(queries, vectors, docs, ENCODER)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
