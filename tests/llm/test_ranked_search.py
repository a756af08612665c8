import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textharbor.llm import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
A_TO_Z = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return [t.translate(A_TO_Z) for t in TERM.findall(text or "")]


def plainly(docs, items, k):
    """Every document scored for every item."""
    counted = [(key, Counter(terms(text))) for key, text in docs]
    counted = [(key, c, sum(c.values())) for key, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, tf, n in counted:
            m = 50 + 50 * n * n_docs // n_terms
            score = 0
            for t in set(terms(text)) & set(tf):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m))
            if score > 0:
                scores.append((-score, key is not None, key))
        out += [(item, rank, key, -s) for rank, (s, _, key) in enumerate(sorted(scores)[:k], 1)]
    return out


def found(spark, documents, docs, items, k):
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, m string, number string")
    index = ranked_search.build_index(documents(docs))
    return [tuple(r) for r in ranked_search.search(index, table, k=k).collect()]


def corpus(rng, n):
    common = ["the", "of", "Größe", "and", "x1"]
    rare = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(n):
        words = rng.choices(common, k=rng.randint(0, 60)) + rng.choices(rare, k=rng.randint(0, 12))
        rng.shuffle(words)
        docs.append((i, rng.choice([" ", "-", ", "]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    return docs


@pytest.mark.parametrize("block_docs, query_terms", [(4096, 200_000), (3, 7)])
def test_against_all_documents(spark, documents, monkeypatch, block_docs, query_terms):
    rng = random.Random(12)
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(ranked_search, "QUERY_TERMS", query_terms)
    docs = corpus(rng, 150)
    docs += [(200, None), (201, ""), (202, "?!"), (None, "the w1 w2"), (5, docs[5][1]), (5, "w3 w3 w3"), (None, "the w1 w2")]
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(90)] + ["the", "OF"], k=rng.randint(1, 9)))) for i in range(12)]
    items += [(100, None), (101, ""), (102, "- !"), (103, "nowhere"), (3, items[3][1]), (None, "w1 w1 the")]
    assert sorted(found(spark, documents, docs, items, 10), key=repr) == sorted(plainly(docs, items, 10), key=repr)


def test_many_equal_documents_are_ranked_by_key(spark, documents):
    docs = [(i, "one two three") for i in range(120)] + [(500, "one")]
    got = found(spark, documents, docs, [(1, "two"), (2, "one")], 50)
    assert sorted(got) == sorted(plainly(docs, [(1, "two"), (2, "one")], 50))
    assert [r[2] for r in sorted(got) if r[0] == 1] == list(range(50))


def test_empty_tables(spark, documents):
    assert found(spark, documents, [], [(1, "one")], 5) == []
    assert found(spark, documents, [(1, "one"), (2, None)], [], 5) == []
    assert found(spark, documents, [(1, None)], [(1, "one")], 5) == []


def test_a_very_long_text(spark, documents):
    docs = [(1, "alpha beta " * 250_000 + "gamma"), (2, "gamma delta"), (3, "beta gamma beta"), (4, "delta")]
    items = [(1, "gamma beta"), (2, "alpha " * 500_000)]
    assert sorted(found(spark, documents, docs, items, 5)) == sorted(plainly(docs, items, 5))


def test_strata_hold_one_normaliser(spark, documents, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 4)
    docs = [(i, "same length text") for i in range(30)] + [(100 + i, "longer " * (i + 1)) for i in range(10)]
    blocks = ranked_search.build_index(documents(docs)).blocks.collect()
    assert sum(b["docs"] for b in blocks) == 40 and max(b["docs"] for b in blocks) <= 4
    length = {i: len(t.split()) for i, t in docs}
    assert all(len({length[k] for k in b["keys"]}) == 1 for b in blocks)


def test_bounds_hold(spark, documents):
    """No document scores more than the bound of its block, and a full list of hits raises what is asked of others."""
    rng = random.Random(4)
    index = ranked_search.build_index(documents(corpus(rng, 120)))
    blocks = index.blocks.collect()
    hashed = {t: ranked_search._terms(pa.array([t]))[0][0].as_py()[0] for t in ("the", "of", "w1", "w2", "w3")}
    items = ranked_search.Items([{"number": i, "terms": list(hashed.values())[: i + 1]} for i in range(5)])
    counts = Counter()
    for b in blocks:
        starts = np.frombuffer(b["starts"], np.uint32)
        counts.update(dict(zip(np.frombuffer(b["terms"], np.int64).tolist(), np.diff(starts).tolist())))
    items.weigh(counts, index.documents)
    best = ranked_search._Best(items, 3, {})
    for row in blocks:
        block = ranked_search._Block(row.asDict(), items)
        for item, places in enumerate(items.places):
            scores = block.scores(places, items.weights)
            assert scores.max(initial=0) <= block.bounds[item]
            best.add(item, scores, row["keys"])
    assert all(least == hits[-1][0] for least, hits in zip(best.least, best.hits) if len(hits) == 3)
