from collections import defaultdict

from pyspark.sql import functions as F

from textharbor.llm import mixing


def targets_by_rounds(sizes, weights=(5, 2, 1), most=3):
    """Share out by weight, stop sources above their bound, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped, free = {}, set(order)
    while True:
        left = sum(sizes.values()) - sum(stopped.values())
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return stopped | share
        for s in over:
            stopped[s] = most * sizes[s]
            free.discard(s)


ROWS = [
    (1, "a b c", "s0"), (2, "d", "s0"), (3, None, "s1"), (4, "e f " * 50, "s2"), (5, "", "s1"), (6, "g h", None),
    (7, "i\x0bj\nk", "s1"), (None, "l m n o", "s0"), (9, "p", "s3"), (9, "p", "s3"), (10, "q " * 200, "s4"), (11, "é\u00a0é", "s5"),
]


def test_budgets_are_met(spark, documents):
    rows = mixing.mix(documents(ROWS)).collect()
    assert len(rows) == len(ROWS)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    expected = targets_by_rounds(sizes)
    for source, size in sizes.items():
        assert abs(target[source] - expected[source]) < 1e-9
        assert taken[source] == int(target[source])
    assert {r.doc_id: r["size"] for r in rows}[7] == 3 and {r.doc_id: r["size"] for r in rows}[11] == 1
    assert {r.source_size for r in rows if r.source == "s3"} == {2}


def test_reruns_and_other_partitions_agree(spark, documents):
    plan = [sorted(map(repr, mixing.mix(documents(ROWS).repartition(n)).collect())) for n in (1, 5)]
    assert plan[0] == plan[1]


def test_documents_follow_the_plan(spark, documents):
    df = documents(ROWS)
    words = F.regexp_count("text", F.lit(mixing.WORD))
    got = {r.source: r.n for r in mixing.mixed_documents(df).groupBy("source").agg(F.sum(words).alias("n")).collect()}
    plan = {r.source: r.n for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert got == {s: n for s, n in plan.items() if n}
    assert mixing.mixed_documents(df).columns == df.columns


def test_cut_words():
    assert mixing.cut_words(" a\n b  c ", 2) == " a\n b"
    assert mixing.cut_words("a b", 0) == "" and mixing.cut_words("a b", 5) == "a b"


def test_empty_and_wordless(spark, documents):
    assert mixing.mix(documents([])).count() == 0
    assert [r.taken for r in mixing.mix(documents([(1, ""), (2, None)])).collect()] == [0, 0]


def test_a_very_long_text(spark, documents):
    df = documents([(1, "word " * 500_000, "s0"), (2, "x y", "s1"), (3, "z " * 10, "s2")])
    rows = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert rows[1]["size"] == 500_000 and rows[2].taken == 6 and rows[3].taken == 30 and rows[1].taken == 500_012 - 36
    text = max((r.text for r in mixing.mixed_documents(df).collect()), key=len)
    assert len(text.split()) in (rows[1].taken, 500_000)
