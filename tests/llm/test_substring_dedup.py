import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from textharbor.llm import substring_dedup as sd
from textharbor.llm.loser_tree import merge_runs


def brute(rows, length):
    """Rows in key order (null last); a key's own rows do not count against it."""
    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for key in dict.fromkeys(k for k, _ in order):
        mine = set()
        for _, text in [r for r in rows if r[0] == key]:
            data = (text or "").encode()
            gone = bytearray(len(data))
            for i in range(len(data) - length + 1):
                window = data[i : i + length]
                mine.add(window)
                if window in seen:
                    gone[i : i + length] = b"\1" * length
            kept = bytes(b for b, g in zip(data, gone) if not g)
            spans = len(bytes(gone).replace(b"\0", b" ").split())
            out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        if key is not None:
            seen |= mine
    return sorted(out, key=repr)


def texts(rng):
    letters = "abcde é\0\n"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(50, 160))) for _ in range(6)]
    out = []
    for _ in range(60):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(3)]
        parts.insert(1, rng.choice(passages)[rng.randint(0, 20) :])
        out.append("".join(parts))
    return out + [rng.choice(out) for _ in range(8)] + ["", None, "x" * 49, "y" * 50, "y" * 51, "z" * 500, "z" * 400, "ab" * 300, "ba" * 300]


def test_against_brute_force(spark, documents):
    rng = random.Random(2)
    rows = list(enumerate(texts(rng)))
    rng.shuffle(rows)
    rows += [(3, "z" * 120), (None, "y" * 60), (None, "only null " * 20), (99, "only null " * 20), (99, "only null " * 20)]
    got = sd.repeat_report(documents(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 50)


def test_small_chunks_and_buckets_agree(spark, documents, monkeypatch):
    rows = list(enumerate(texts(random.Random(4))))
    monkeypatch.setattr(sd, "CHUNK_ANCHORS", 40)
    monkeypatch.setattr(sd, "CHUNK_SUFFIXES", 30)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 500)
    got = sd.repeat_report(documents(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 50)


@pytest.mark.parametrize("bound", [0, 3, 20])
def test_hot_anchors_take_the_other_way(spark, documents, monkeypatch, bound):
    """Whatever counts as hot, the result is the same."""
    monkeypatch.setattr(sd, "HOT_ENTRIES", bound)
    monkeypatch.setattr(sd, "CHUNK_SUFFIXES", 200)
    rng = random.Random(bound)
    rows = list(enumerate(texts(rng)))
    rows += [(3, "z" * 120), (None, "y" * 60), (None, "only null " * 20), (99, "only null " * 20), (99, "only null " * 20)]
    got = sd.repeat_report(documents(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 50)


def test_a_phrase_in_very_many_documents_fills_no_bucket(spark, documents, monkeypatch):
    """A phrase shorter than a window, with other text around it: its windows differ and are spread over all buckets."""
    monkeypatch.setattr(sd, "HOT_ENTRIES", 500)
    sizes = []
    phrase = "a phrase of forty bytes in all documents"
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(60))
    rows = [(i, f"{word()} {phrase} {word()}") for i in range(3000)] + [(5000, f"x {rows_of(phrase)} y"), (5001, f"z {rows_of(phrase)} w")]
    docs = documents(rows).selectExpr("doc_id AS id", "xxhash64(text) AS print", "text")
    found = sd.repeated_spans(docs, bucket_bytes=4 << 10)
    got = {(r.id, r.start, r.end) for r in found.collect()}
    assert {i for i, _, _ in got} == {5001}
    buckets = max(spark.sparkContext.defaultParallelism, -(-sum(len(t) for _, t in rows) // (4 << 10)))
    hashes = sd.anchor_runs(np.frombuffer((" " * 60 + phrase + " " * 60).encode(), np.uint8), np.array([0, 120 + len(phrase)]))[3]
    hot = np.unique(sd._codes(hashes, buckets))
    table = pa.RecordBatch.from_pydict({
        "id": [i for i, _ in rows], "print": [0] * len(rows), "text": [t for _, t in rows],
        "places": [list(range(len(t))) for _, t in rows],
    })
    for batch in sd._send_runs(buckets, 50, sd.ANCHOR, hot)([table]):
        for bucket, done in zip(batch.column("bucket").to_pylist(), batch.column("done").to_pylist()):
            if bucket >= buckets:
                sizes.append(len(zstandard.ZstdDecompressor().decompress(done)) // sd._WINDOW.itemsize)
    assert sizes and max(sizes) < 0.1 * sum(sizes)


def rows_of(phrase):
    return f"shared {phrase} shared"


def test_a_very_long_text(spark, documents):
    rng = random.Random(11)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(300)]
    rows = [(1, " ".join(parts)), (2, " ".join(parts[::-1]) * 40), (3, parts[7])]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in sd.repeat_report(documents(rows)).collect()}
    assert got[1] == (len(rows[0][1]), 0) and got[3] == (200, 200)
    assert got[2][0] == len(rows[1][1]) > 2_000_000 and got[2][1] > 0.98 * got[2][0]


def test_empty_table(spark, documents):
    assert sd.repeat_report(documents([])).count() == 0
    assert [r.n_removed for r in sd.repeat_report(documents([(1, None), (2, "")])).collect()] == [0, 0]


def test_equal_windows_elect_one_anchor():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 101, 90).astype(np.uint8)
    rows = [np.concatenate([rng.integers(97, 101, n).astype(np.uint8), passage]) for n in (0, 13, 70)]
    found = []
    for row in rows:
        place, first, last, _, _ = sd.anchor_runs(row, np.array([0, len(row)]))
        starts = {s: p for p, a, b in zip(place, first, last) for s in range(a, b + 1)}
        assert sorted(starts) == list(range(len(row) - 49))
        shift = len(row) - 90
        found.append([starts[shift + i] - shift for i in range(41)])
    assert found[0] == found[1] == found[2]


def code(strings):
    shared, tails, last = [], [], b""
    for s in strings:
        n = 0
        while n < min(len(s), len(last)) and s[n] == last[n]:
            n += 1
        shared.append(n)
        tails.append(s[n:])
        last = s
    return bytes(shared), bytes(map(len, strings)), b"".join(tails)


def test_loser_tree_merges_runs_and_knows_prefixes():
    rng = random.Random(8)
    for runs in (0, 1, 2, 3, 7, 16):
        parts = [sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(runs)]
        order, lcp = merge_runs([code(p) for p in parts])
        flat = [s for p in parts for s in p]
        merged = [flat[i] for i in order]
        assert merged == sorted(flat) and len(set(order.tolist())) == len(flat)
        for a, b, n in zip(merged, merged[1:], lcp[1:]):
            assert a[:n] == b[:n] and (n == len(a) or n == len(b) or a[n] != b[n])
