import hashlib

import duckdb
from paths import DATA
from pyspark.sql import functions as F

import oracles
from textharbor.functions import scores, text


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("text")


def test_content_hash(spark):
    rows = docs(spark).select("text", text.content_hash(F.col("text")).alias("h")).collect()
    assert all(r.h == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)


def sql_rows(expression):
    return sorted(r for (r,) in duckdb.sql(f"SELECT {expression} FROM '{DATA}/documents.parquet'").fetchall())


def test_keywords_equal_sql(spark):
    for shortest in (3, 5):
        rows = docs(spark).select(F.array_join(F.sort_array(text.keywords(F.col("text"), shortest)), " ").alias("k"))
        assert sorted(r.k for r in rows.collect()) == sql_rows(oracles._joined(oracles._keywords("text", shortest)))


def test_document_keywords_come_from_the_whole_text_or_its_opening(spark):
    row = spark.createDataFrame([("alpha beta " + "x" * 600 + " gamma",)], "t string")
    whole, opening = row.select(text.document_keywords(F.col("t")), text.document_keywords(F.col("t"), 8)).first()
    assert whole == ["alpha", "beta", "x" * 600, "gamma"] and opening == ["alpha"]


def test_keyword_rules(spark):
    row = spark.createDataFrame([("Ab abc ABC abc, ab1 ünï x-y 北京市",)], "t string")
    assert set(row.select(text.keywords(F.col("t"))).first()[0]) == {"abc", "ünï", "北京市"}


def test_overlap(spark):
    cases = [
        (["a", "b"], ["b", "c"], 1 / 3), ([], ["a"], 0.0), (["a"], [], 0.0), (["a"], ["a"], 1.0), (["a"], ["b"], 0.0),
        (["a", "b", "c"], ["c", "b"], 2 / 3),
    ]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, a array<string>, b array<string>")
    out = [r[1] for r in sorted(rows.select("i", text.overlap_ratio(F.col("a"), F.col("b"))).collect())]
    assert out == [want for _, _, want in cases]


def test_shared_keywords_are_sorted_and_limited(spark):
    row = spark.createDataFrame([(list("cab"), list("bcad"))], "a array<string>, b array<string>")
    assert row.select(text.shared_keywords(F.col("a"), F.col("b"), 2)).first()[0] == ["a", "b"]


# Texts and their previews of at most 200 and of at most 10 characters.
PREVIEWS = [
    ("", "", ""),
    ("x" * 200, "x" * 200, "x" * 7 + "..."),
    ("x" * 201, "x" * 197 + "...", "x" * 7 + "..."),
    ("word " * 40, "word " * 40, "word..."),
    ("word " * 41, ("word " * 39).strip() + "...", "word..."),
    ("é" * 150 + " " + "z" * 100, "é" * 150 + "...", "é" * 7 + "..."),
    ("ab cd efgh", "ab cd efgh", "ab cd efgh"),
    ("ab cd efghi", "ab cd efghi", "ab cd..."),
    ("a\nb " * 100, ("a\nb " * 49).strip() + "...", "a\nb..."),
]


def test_previews(spark):
    rows = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PREVIEWS)], "i int, t string")
    out = rows.select("i", text.preview(F.col("t")), text.preview(F.col("t"), 10)).collect()
    assert [tuple(r[1:]) for r in sorted(out)] == [p[1:] for p in PREVIEWS]


def test_previews_of_a_table_equal_sql(spark):
    rows = docs(spark).select(text.preview(F.col("text")).alias("p")).collect()
    assert sorted(r.p for r in rows) == sql_rows(oracles._preview("text"))


def test_listing_preview(spark):
    rows = spark.createDataFrame([("a" * 100,), ("b" * 101,)], "t string")
    out = {r[0] for r in rows.select(text.listing_preview(F.col("t"))).collect()}
    assert out == {"a" * 100, "b" * 100 + "..."}


def test_rendering_equals_plain_python(spark):
    rows = spark.range(0, 10001).select((F.col("id") / 10000).alias("x"))
    out = rows.select("x", text.percent(F.col("x")).alias("p"), text.percent(F.col("x"), 2).alias("q"),
                      text.fixed_digits(F.col("x")).alias("d")).collect()
    assert all(r.p == f"{r.x:.1%}" and r.q == f"{r.x:.2%}" and r.d == f"{r.x:.4f}" for r in out)


def test_numbers_beyond_a_thousand_are_not_grouped(spark):
    rows = spark.createDataFrame([(1, 12.345), (2, 1234.5), (3, -98765.4321), (4, 0.125), (5, 1e6)], "i int, x double")
    shown = rows.select("i", text.percent(F.col("x")).alias("p"), text.fixed_digits(F.col("x")).alias("d"))
    out = {r.i: (r.p, r.d) for r in shown.collect()}
    assert out[1] == ("1234.5%", "12.3450") and out[2] == ("123450.0%", "1234.5000")
    assert out[3][1] == "-98765.4321" and out[4] == ("12.5%", "0.1250") and out[5][1] == "1000000.0000"


def test_chart_label_of_any_key_type(spark):
    row = spark.createDataFrame([(7, "k" * 30)], "i bigint, s string")
    assert tuple(row.select(text.chart_label(F.col("i")), text.chart_label(F.col("s"))).first()) == ("7", "k" * 25)


def test_normalize_score(spark):
    rows = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.25, 1.0, 3.0)], "s double")
    out = [r[0] for r in rows.select(scores.normalize_score(F.col("s"), 0, 2)).collect()]
    assert out == [0.0, 0.0, 0.125, 0.5, 1.0]
    assert rows.select(scores.normalize_score(F.col("s"), 1, 1)).first()[0] == 0.5


def test_length_normalized(spark):
    import math

    rows = spark.createDataFrame([(0.5, 0), (0.5, 1000), (-0.5, 2500)], "s double, n int")
    out = [r[0] for r in rows.select(scores.length_normalized(F.col("s"), F.col("n"))).collect()]
    want = [0.5, 0.5 / (1 + math.log1p(1)), -0.5 / (1 + math.log1p(2.5))]
    assert all(abs(a - b) < 1e-15 for a, b in zip(out, want))
