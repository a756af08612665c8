import hashlib
import re

import pytest

from textharbor.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [
    (1, "One two three four five six"), (2, "short item"), (3, None), (4, ""), (5, "... !!"), (10, "two three four five"),
    (2, "short item"), (7, "Éa ÉB c"),
]
TEXTS = [
    (1, "zero ONE, two three-four five; six seven"), (2, "a short item, and a short ITEM short item"), (3, None), (4, ""),
    (5, "one two three four"), (6, "x éa eb C"), (7, "Éa Éb c"), (8, "one two three " * 400 + "four five six"), (2, "short\nitem"),
    (9, "one two three four five six " * 3), (None, "short item"),
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, n):
    mine, hit, items = words(text), set(), set()
    for item, item_text in ITEMS:
        known = words(item_text)
        size = min(n, len(known))
        windows = {tuple(known[i : i + size]) for i in range(len(known) - size + 1)} if size else set()
        for i in range(len(mine) - size + 1):
            if size and tuple(mine[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                items.add(str(item))
    return len(mine), len(hit), sorted(items)


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block", [1 << 25, 700])
def test_against_brute_force(spark, documents, benchmark, monkeypatch, block):
    monkeypatch.setattr(dec, "BLOCK_BYTES", block)
    got = dec.contamination_report(documents(TEXTS), benchmark, n=4).collect()
    wanted = []
    for key, text in TEXTS:
        n, hit, items = brute(text, 4)
        digest = hashlib.sha256(",".join(items).encode()).hexdigest()
        wanted.append((key, n, hit, len(items), digest, hit > 0))
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)


def test_removal(spark, documents, benchmark):
    df = documents(TEXTS)
    clean = dec.decontaminate(df, benchmark, n=4)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(k for k, t in TEXTS if not brute(t, 4)[1])
    cut = dec.decontaminate(df, benchmark, remove="spans", n=4)
    texts = sorted((str(r.doc_id), r.text or "") for r in cut.collect())
    assert ("1", "zero  seven") in texts and ("2", "a , and a ") in texts and ("7", "") in texts
    assert all(brute(t, 4)[1] == 0 for _, t in texts)
    with pytest.raises(ValueError):
        dec.decontaminate(df, benchmark, remove="words")


def test_empty_tables(spark, documents, benchmark):
    assert dec.contamination_report(documents([]), benchmark).count() == 0
    rows = dec.contamination_report(documents(TEXTS), benchmark.limit(0)).collect()
    assert len(rows) == len(TEXTS) and not any(r.contaminated for r in rows)


def test_a_window_of_very_many_items_is_broadcast_once(spark, documents, monkeypatch):
    """Blocks hold distinct windows, whatever the number of items that share one."""
    monkeypatch.setattr(dec, "BLOCK_BYTES", 2000)
    items = [(i, "read the text and answer the question below w%d" % (i % 7)) for i in range(3000)]
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    windows, holders = dec.numbered_windows(benchmark, "item_id", "text", 8)
    sizes = windows.groupBy("block").agg({"block": "count"}).collect()
    assert windows.count() == 8 and max(r[1] for r in sizes) <= 9 and holders.count() == 6000
    got = dec.contamination_report(documents([(1, items[0][1]), (2, "the text and"), (3, items[3][1] + " " + items[4][1])]), benchmark, n=8)
    assert {r.doc_id: r.n_items for r in got.collect()} == {1: 3000, 2: 0, 3: 3000}


def test_a_very_long_text(spark, documents):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    text = "one two three four " * 150_000 + "alpha beta gamma delta " + "five " * 10
    (row,) = dec.contamination_report(documents([(1, text)]), benchmark, n=4).collect()
    assert (row.n_words, row.n_hit, row.n_items) == (600_014, 4, 1)
    (row,) = dec.decontaminate(documents([(1, text)]), benchmark, n=4, remove="spans").collect()
    assert len(row.text) == len(text) - len("alpha beta gamma delta")
