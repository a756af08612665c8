import random
import zlib

import numpy as np
import pyarrow as pa

from textharbor.llm import toxicity

SYLLABLES = ["an", "er", "on", "the", "re", "st", "in", "ti", "or", "ed", "ly", "wh", "ble"]
INSULTS = ["worthless", "moron", "scum", "pathetic", "clown"]


def prose(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text, toxic = prose(rng, rng.randint(20, 150)), int(i % 4 == 0)
        for _ in range(rng.randint(2, 6) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(INSULTS)
        rows.append((i, " ".join(text), toxic))
    return rows


def test_held_out_accuracy(spark, documents):
    rows = corpus(1)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    extra = [(None, "worthless " * 9), (9000, None), (9001, ""), (9002, "x" * 5000), (9003, "An PATHETIC\nthé"), (0, rows[0][1])]
    got = toxicity.toxicity_report(documents([r[:2] for r in rows] + extra), labels).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: x for i, _, x in rows}
    right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by_key = {r.doc_id: r.predicted for r in got}
    assert by_key[None] == 1 and by_key[9003] == 1 and by_key[9000] == by_key[9001] == by_key[9002] == 0


def test_held_out_labels_change_nothing(spark, documents):
    rows = corpus(2, 150)
    df = documents([r[:2] for r in rows])
    flipped = [(i, x if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - x) for i, _, x in rows]
    models = [
        toxicity.learn(df, spark.createDataFrame([(i, x) for i, *_, x in table], "doc_id long, toxic int"))
        for table in (rows, flipped)
    ]
    assert models[0] == models[1]


def test_without_labels_or_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity_report(documents([(1, "some text"), (2, None)]), none).collect()
    assert len(rows) == 2 and all(r.predicted == 0 for r in rows)
    assert toxicity.toxicity_report(documents([]), none).count() == 0


def gains_of(model, *texts):
    rows = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return toxicity.Gains(model.dictionaries).largest(np.frombuffer(b"".join(rows), np.uint8), offsets)


def test_short_words_with_signs():
    rows = corpus(3)
    model = toxicity.fit([t for _, t, x in rows if x], [t for _, t, x in rows if not x], 0.25)
    gains = gains_of(model, "the scum!! the", "scum.", "(Scum)", "the thin story", "")
    chances = [model.chances[min(g, 31)] for g in gains]
    assert min(chances[:3]) > 0.7 and max(chances[3:]) < 0.7


def test_a_phrase_of_ordinary_words():
    rng = random.Random(4)
    pairs = [["get", "home"], ["paradise", "lost"]]  # either word is ordinary, only together they are not
    ordinary = [prose(rng, 60) + rng.choice(pairs) + prose(rng, 5) for _ in range(400)]
    toxic = [prose(rng, 60) + ["get", "lost"] + prose(rng, 5) for _ in range(300)]
    model = toxicity.fit([" ".join(t) for t in toxic], [" ".join(t) for t in ordinary], 0.4)
    gains = gains_of(model, "now get lost!", "Get, lost", "paradise lost", "get home")
    chances = [model.chances[min(g, 31)] for g in gains]
    assert min(chances[:2]) > 0.7 and max(chances[2:]) < 0.7


def test_chances_never_fall():
    assert toxicity._rising([0.1, 0.5, 0.2, 0.9], [1, 1, 1, 1]) == [0.1, 0.35, 0.35, 0.9]


def test_searched_windows_are_all_that_gain():
    """The largest gain against every word of a text compressed, with its signs and without."""
    rng = random.Random(5)
    rows = corpus(6)
    model = toxicity.fit([t for _, t, x in rows if x], [t for _, t, x in rows if not x], 0.25)
    gains = toxicity.Gains(model.dictionaries)
    texts = [t for _, t, _ in rows[:150]] + ["", "x" * 300, "The MORON.", "scum!!", "é" * 40 + "moron", "a b c", "...", "x" * 40 + "pathetic" + "y" * 40]
    texts += [" ".join(rng.choice(["(", ""]) + w + rng.choice(["", "!!", ","]) for w in t.split()) for t in texts[:60]]

    def plainly(text):
        lower = text.encode().translate(bytes(toxicity._LOWER))
        words = lower.split() + lower.translate(toxicity._FOLDED).split()
        return max(map(gains.of_word, words), default=0)

    got = gains_of(model, *texts).tolist()
    assert got == [plainly(t) for t in texts]
    assert sum(g > 0 for g in got) > 40


def test_a_very_long_text(spark, documents):
    rows = corpus(1)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    clean = " ".join(t for _, t, x in rows if not x)
    long = clean * (3_000_000 // len(clean) + 1)
    got = toxicity.toxicity_report(documents([r[:2] for r in rows] + [(7000, long), (7001, long + " worthless")]), labels).collect()
    by_key = {r.doc_id: r.predicted for r in got}
    assert (by_key[7000], by_key[7001]) == (0, 1)


def test_learning_takes_bounded_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "CLASS_BYTES", 1000)
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary, share: seen.update(t=toxic, o=ordinary, s=share) or toxicity.Model(toxicity.Dictionaries(b"", b"", b""), (0.0,)))
    batch = pa.RecordBatch.from_pydict({"label": [0] * 20 + [1] * 3, "text": ["x" * 99] * 23, "share": [0.25] * 23})
    (model,) = toxicity._fit_in_task([batch])
    assert (len(seen["o"]), len(seen["t"]), seen["s"]) == (10, 3, 0.25)
    assert model.to_pylist() == [{"ordinary": b"", "toxic": b"", "context": b"", "chances": [0.0]}]
