import random

import numpy as np

from textharbor.llm import near_dedup as nd
from textharbor.llm.components import connected_components

WORDS = [f"w{i}" for i in range(400)]


def family(rng, size, copies, changes):
    base = [rng.choice(WORDS) for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randint(0, changes)):
            text[rng.randrange(size)] = rng.choice(WORDS)
        out.append(" ".join(text))
    return out


def shingles(text, size):
    words = (text or "").translate(str.maketrans("ABCW", "abcw")).split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    sets = {k: shingles(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((k, len(sets[k]), root(k), root(k) == k) for k in keys)


def brute_matrix(texts, size, percent):
    """The component of each text, by the matrix of all intersections."""
    sets, numbers = [shingles(t, size) for t in texts], {}
    table = np.zeros((len(sets), len(numbers.fromkeys(s for x in sets for s in x))), np.float32)
    for row, found in enumerate(sets):
        table[row, [numbers.setdefault(s, len(numbers)) for s in found]] = 1
    both, counts = (table @ table.T).astype(int), table.sum(axis=1).astype(int)
    linked = 100 * both >= percent * (counts[:, None] + counts[None, :] - both)
    component = np.arange(len(sets))
    while True:
        lower = np.where(linked, component[None, :], len(sets)).min(axis=1)
        if (lower == component).all():
            return dict(enumerate(component.tolist()))
        component = lower


def test_families_chains_and_edge_cases(spark, documents):
    rng = random.Random(11)
    texts = [t for _ in range(12) for t in family(rng, rng.randint(4, 120), rng.randint(1, 12), 4)]
    chain = [rng.choice(WORDS) for _ in range(200)]
    for step in range(8):  # each like the one before, the ends unlike each other
        texts.append(" ".join(chain))
        for i in range(6):
            chain[(step * 6 + i) % 200 if step % 2 else 199 - (step * 6 + i)] = f"s{step}x{i}"
    texts += ["", None, " \n\t", "one", "ONE".lower(), "two words", "two  words", "a b c", "x " * 3000, "x " * 2000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = nd.near_duplicates(documents(rows), size=3, percent=85).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 85)


def test_a_hub_with_any_key(spark, documents):
    """Copies like the base but not like each other, the base neither first nor last."""
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(300)]
    texts = []
    for c in range(40):
        copy = list(base)
        for i in range(5):
            copy[(7 * c + 61 * i) % 300] = f"c{c}i{i}"
        texts.append(" ".join(copy))
    texts.insert(23, " ".join(base))
    rows = list(enumerate(texts))
    expected = brute(rows, 3, 85)
    assert {r[2] for r in expected} == {0}
    got = nd.near_duplicates(documents(rows), size=3, percent=85).collect()
    assert sorted(map(tuple, got)) == expected


def test_a_crowd_from_one_template(spark, documents):
    """2,000 texts from one template that is not among them; few pairs reach the threshold."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = []
    for _ in range(2000):
        text = list(base)
        for place in rng.sample(range(300), rng.randint(6, 8)):
            text[place] = f"e{rng.randrange(5)}p{place}"
        texts.append(" ".join(text))
    rows = list(enumerate(texts))
    expected = brute_matrix(texts, 3, 85)
    assert 100 < sum(k != c for k, c in expected.items()) < 400
    got = nd.near_duplicates(documents(rows), size=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == expected


def test_intersections_of_all_pairs():
    rng = np.random.default_rng(3)
    left, right = [[np.unique(rng.integers(0, 9000, n)).astype(np.uint64) for n in sizes] for sizes in ((1, 700, 6000), (5000, 40))]
    got = nd._intersections(left, right)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def test_repeated_and_null_keys(spark, documents):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "q"), (3, "e f g"), (3, "h i j"), (4, "h i j")]
    got = nd.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    by_key = {r.doc_id: r.component_id for r in got}
    assert by_key[1] == by_key[2] == 1 and by_key[None] is None
    assert all(r.kept for r in got if r.doc_id is None)
    left = nd.drop_near_duplicates(documents(rows)).collect()
    assert sorted(str(r.doc_id) for r in left) in (["1", "3", "4", "None", "None"], ["1", "3", "None", "None"])


def test_empty_table(spark, documents):
    assert nd.near_duplicates(documents([])).count() == 0
    assert nd.drop_near_duplicates(documents([(1, None), (2, "")])).count() == 2


def test_densified_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (8, 40, 3000):
        pool = nd.common.mixed(rng.integers(1, 1 << 60, 2 * size).astype(np.uint64))
        a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[: size * 3 // 4], pool[size : size * 5 // 4]]))
        sketch = nd.sketches(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sketch[0] == sketch[1]).mean() - true) < (0.35 if size < 10 else 0.17)
        assert (sketch != 0).all()


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (2, 1)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 140)]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
