import html
from html.entities import html5

import duckdb
import pytest
from paths import DATA
from pyspark.sql import functions as F

import oracles
from textharbor.functions import cleaning

# Inputs and what cleaning makes of them, written down by hand.
EDGES = [
    ("&AMP; &#X41; &Eacute;", "& A é"),
    ("a < b and c > d", "a d"),
    ("&lt;b&gt;x&lt;/b&gt;", "<b>x</b>"),
    ("a&nbsp;b c\x1cd", "a b c d"),
    ("see www.x.com/a?b&amp;c, ok", "see ok"),
    ("<!-- a > b -->", "b -->"),
    ("http://", "http://"),
    ("HELLO <b>World</b>\n\n visit https://example.org/x &amp; more", "hello world visit & more"),
    ("", ""),
    (" \t\n ", ""),
    ("x \n y", "x y"),
    ("x\n y　　z  w", "x y z w"),
    ("<a\nhref='x'>t</a>", "t"),
    ("&amp;quot; &copy &#0; &#x110000;", "&quot; © \ufffd \ufffd"),
    ("STRASSE straße ÀÉ", "strasse straße àé"),
    ("a\x0bb\x85c e", "a b c e"),
    ("http://a.b/c d www.x\x1cy", "d y"),
]


def one(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in sorted(rows.select("i", column.alias("o")).collect())]


def test_clean_edges(spark):
    out = one(spark, cleaning.clean(F.col("t")), [t for t, _ in EDGES])
    assert out == [want for _, want in EDGES]


def test_null_stays_null(spark):
    assert one(spark, cleaning.clean(F.col("t")), [None, "A"]) == [None, "a"]


def test_urls_can_stay(spark):
    text = "See https://x.org/A now"
    assert one(spark, cleaning.clean(F.col("t"), remove_urls=False), [text]) == ["see https://x.org/a now"]


@pytest.mark.parametrize(
    "step, text, want",
    [
        (cleaning.strip_tags, "<p>a</p><br/>b", " a  b"),
        (cleaning.strip_html, "<p>a &lt; b</p>", " a < b "),
        (cleaning.strip_urls, "x http://a.b/c y www.d", "x   y  "),
        (cleaning.normalize_whitespace, "  a \t b\n", "a b"),
    ],
)
def test_single_steps(spark, step, text, want):
    assert one(spark, step(F.col("t")), [text]) == [want]


@pytest.mark.parametrize("table, column", [("documents", "text"), ("pages", "html"), ("conversations", "text")])
def test_whole_tables_equal_sql(spark, table, column):
    path = f"{DATA}/{table}.parquet"
    rows = spark.read.parquet(path).select(cleaning.clean(F.col(column)).alias("o")).collect()
    wanted = duckdb.sql(f"SELECT {oracles._clean(column)} FROM '{path}'").fetchall()
    assert sorted(r.o for r in rows) == sorted(w for (w,) in wanted)


# White space by the Unicode standard and the four separators that string splitting counts too.
SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def test_white_space_between_letters(spark):
    others = [0x01, 0x08, 0x0E, 0x1B, 0x7F, 0x84, 0x86, 0x200B, 0x200C, 0x2060, 0xFEFF]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} c{chr(c)}" for c in SPACES + others]
    wanted = ["a b c" for _ in SPACES] + [f"a{chr(c)}b {chr(c)}{chr(c)} c{chr(c)}" for c in others]
    assert one(spark, cleaning.clean(F.col("t")), texts) == wanted


def test_latin_letters_become_lower_case(spark):
    texts = ["AZaz09_-", "ÀÖØÞàöøþ", "ĀāŁłŽž", "Ǆ ǅ ǆ"]
    assert one(spark, cleaning.clean(F.col("t")), texts) == ["azaz09_-", "àöøþàöøþ", "āāłłžž", "ǆ ǆ ǆ"]


def test_native_entities_equal_those_of_python(spark):
    numbers = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFEFF, 0xFFFD, 0xFFFE, 0x10000, 0x1F600, 0x1FFFE,
               0x10FFFD, 0x10FFFF, 0x110000, 99_999_999_999]
    texts = [f"a&{n}b" for n in html5] + [f"&{n}" for n in html5]
    texts += [f"&#{i};" for i in numbers] + [f"&#x{i:x}" for i in numbers] + [f"&#X000{i:X};" for i in numbers]
    texts += ["&#;", "&#x;", "&#xg;", "&", "&&amp;", "&ampx", "&notit;", "&notin;", "&am", "&amp;amp;", "& amp;", "&frac12x",
              "x&copy2 &copy", "&" + "a" * 40 + ";", "", "&amp;lt;", "&\tamp;", "&nbsp", "é&eacute;&EACUTE;", "&amp" * 1000]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", cleaning.decode_entities_native(F.col("t")).alias("o"))
    assert [(r.t, r.o) for r in rows.collect() if r.o != (None if r.t is None else html.unescape(r.t))] == []
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
