import pytest

from textharbor import expand_queries
from textharbor.schema import LEXICON

WORDS = {
    "happy": [["happy", "glad"], ["Felicitous", "joyful"], ["content", "at_ease"], ["fourth", "never"]],
    "glad": [["happy", "cheerful"]],
    "quantum": [["quantum", "quantity", "third_lemma"]],
    "research": [["inquiry"], ["inquiry", "explore"]],
    "abc": [["short", "word"]],
}


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(w, i, j, n) for w, senses in WORDS.items() for i, s in enumerate(senses, 1) for j, n in enumerate(s, 1)]
    return spark.createDataFrame(rows, LEXICON)


# Queries and their expansions by at most one, two and three synonyms a word, written down by hand.
EXPANDED = [
    ("happy", "happy glad", "happy glad felicitous", "happy glad felicitous joyful"),
    ("a an the", "a an the", "a an the", "a an the"),
    (
        "Quantum physics RESEARCH",
        "quantum physics research quantity inquiry",
        "quantum physics research quantity third lemma inquiry explore",
        "quantum physics research quantity third lemma inquiry explore",
    ),
    (
        "happy happy glad",
        "happy happy glad felicitous joyful cheerful",
        "happy happy glad felicitous joyful content at ease cheerful",
        "happy happy glad felicitous joyful content at ease fourth never cheerful",
    ),
    (
        "abc happy\tunknownword",
        "abc happy unknownword glad",
        "abc happy unknownword glad felicitous",
        "abc happy unknownword glad felicitous joyful",
    ),
    ("", "", "", ""),
    ("  spaced   out  ", "spaced out", "spaced out", "spaced out"),
]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_expansions(spark, lexicon, most):
    queries = spark.createDataFrame([(i, e[0]) for i, e in enumerate(EXPANDED)], "query_id int, query string")
    out = expand_queries(queries, lexicon, most)
    assert out.columns == ["query_id", "query", "expanded"]
    assert {r.query_id: r.expanded for r in out.collect()} == {i: e[most] for i, e in enumerate(EXPANDED)}


def test_senses_and_lemmas_can_be_bounded(spark, lexicon):
    queries = spark.createDataFrame([(1, "happy")], "query_id int, query string")
    for bounds, want in (
        ({"max_lemmas": 1}, "happy felicitous content fourth"),
        ({"max_senses": 1}, "happy glad"),
        ({"max_senses": 3, "max_lemmas": 2}, "happy glad felicitous joyful content at ease"),
    ):
        assert expand_queries(queries, lexicon, 5, **bounds).first().expanded == want


def test_no_lemma_of_an_equal_rank_is_lost(spark):
    queries = spark.createDataFrame([(1, "happy")], "query_id int, query string")
    tied = spark.createDataFrame([("happy", 1, 1, "joyful"), ("happy", 1, 1, "glad")], LEXICON)
    assert expand_queries(queries, tied).first().expanded == "happy glad joyful"


def test_originals_are_kept_and_come_first(spark, lexicon):
    row = expand_queries(spark.createDataFrame([(1, "quantum physics research")], "query_id int, query string"), lexicon)
    assert row.first().expanded.startswith("quantum physics research ")


def test_without_lexicon_the_text_is_untouched(spark):
    row = expand_queries(spark.createDataFrame([(1, "Happy  Days")], "query_id int, query string"))
    assert row.first().expanded == "Happy  Days"


def test_repeated_lexicon_rows_change_nothing(spark, lexicon):
    queries = spark.createDataFrame([(1, "happy glad")], "query_id int, query string")
    twice = lexicon.unionByName(lexicon)
    assert expand_queries(queries, twice).collect() == expand_queries(queries, lexicon).collect()
