import numpy as np
import pytest
from pyspark.sql import functions as F

from textharbor import append_vectors, build_vectors, clear_index, index_stats, load_index, publish_index, run_dir
from textharbor.functions import vectors


def table(spark, rows, key="string"):
    return spark.createDataFrame(rows, f"doc_id {key}, embedding array<float>")


def test_l2_normalize(spark):
    rows = {"a": [3.0, 4.0], "z": [0.0, 0.0], "n": [-1.0, 0.0]}
    out = {r.doc_id: r.embedding for r in build_vectors(table(spark, list(rows.items()))).collect()}
    assert np.allclose(out["a"], [0.6, 0.8]) and out["z"] == [0.0, 0.0] and out["n"] == [-1.0, 0.0]


def test_l2_normalize_takes_doubles(spark):
    rows = spark.createDataFrame([("a", [1.0, 1.0])], "doc_id string, embedding array<double>")
    assert build_vectors(rows).schema["embedding"].dataType.elementType.typeName() == "float"


def test_dot_and_norm(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "a array<float>, b array<float>")
    assert tuple(row.select(vectors.dot(F.col("a"), F.col("b")), vectors.norm(F.col("a"))).first()) == (1.0, 5**0.5)


def test_cosine_to_one_query(spark):
    rows = table(spark, [("a", [2.0, 0.0]), ("b", [0.0, 3.0]), ("z", [0.0, 0.0])])
    out = {r.doc_id: r.score for r in vectors.cosine_to(rows, "embedding", [5.0, 0.0]).collect()}
    assert out == {"a": 1.0, "b": 0.0, "z": 0.0}


def test_split_by_dim(spark):
    unusable = [("short", [1.0]), ("null", None), ("hole", [1.0, None]), ("nan", [1.0, float("nan")]),
                ("inf", [float("inf"), 0.0]), ("low", [0.0, -float("inf")])]
    rows = table(spark, [("ok", [1.0, 0.0]), *unusable])
    good, bad = vectors.split_by_dim(rows, "embedding", 2)
    assert [r.doc_id for r in good.collect()] == ["ok"]
    assert {r.doc_id for r in bad.collect()} == {key for key, _ in unusable}


def test_normalising_takes_time_in_proportion_to_the_length(spark):
    """The norm of a vector is a variable of the expression, not summed anew for every number."""
    plan = table(spark, [("a", [1.0, 2.0])]).select(vectors.l2_normalize(F.col("embedding")).alias("unit"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("aggregate(") == 1 and plan.first()[0] == [float(np.float32(x / 5**0.5)) for x in (1, 2)]


def test_append_keeps_repeated_keys(spark):
    index = build_vectors(table(spark, [("a", [1.0, 0.0])]))
    more = append_vectors(index, table(spark, [("a", [0.0, 2.0]), ("b", [1.0, 1.0])]))
    assert sorted(r.doc_id for r in more.collect()) == ["a", "a", "b"]


def test_publish_and_load(spark):
    root = run_dir(spark, "index")
    with pytest.raises(FileNotFoundError):
        load_index(spark, root)
    shown = spark.createDataFrame([("a", "x")], "doc_id string, filename string")
    assert publish_index(table(spark, [("a", [1.0])]), shown, root) == 1
    old, _ = load_index(spark, root)
    assert publish_index(table(spark, [("b", [1.0]), ("c", [1.0])]), shown, root) == 2
    new, docs = load_index(spark, root)
    assert {r.doc_id for r in new.collect()} == {"b", "c"} and docs.count() == 1
    assert [r.doc_id for r in old.collect()] == ["a"]  # readers of the older snapshot are undisturbed


def test_clearing_an_index(spark):
    root = run_dir(spark, "index")
    assert clear_index(spark, root) == 0
    shown = spark.createDataFrame([("a", "x")], "doc_id string, filename string")
    publish_index(table(spark, [("a", [1.0]), ("b", [1.0])]), shown, root)
    stats = index_stats(spark, root).first()
    assert (stats.version, stats.vectors) == (1, 2) and stats.size_bytes > 0
    assert clear_index(spark, root) == 2 and clear_index(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        load_index(spark, root)
    assert publish_index(table(spark, [("c", [1.0])]), shown, root) == 3
    assert load_index(spark, root)[0].count() == 1
