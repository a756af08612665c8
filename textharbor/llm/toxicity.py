"""Toxicity by compression distance: one zstandard dictionary from ordinary text, one from toxic text.

Every word of a text, with its spaces and a fixed piece of ordinary text behind it, is a window. It is compressed
with the ordinary dictionary and with the toxic one (which ends in the ordinary one, so that ordinary words cost the
same in both); the bytes saved by the toxic dictionary are the window's gain. Words without the signs on them are
windows too, and so are two and three such words together wherever the telling part of the toxic dictionary has a match
that spans the space between them; other windows of several words cannot gain more than their words. A text scores by its largest gain,
turned into a probability by calibration on labelled texts that no dictionary was trained on.

Only bytes that stand in the telling part can make the lengths differ, and the shortest match has ``MATCH_BYTES``. So all
windows are searched for such bytes at once, and those without any have no gain.

The toxic dictionary is made of the parts of toxic texts that set them apart: stretches covered by byte n-grams
found in a far larger share of toxic texts than of ordinary ones, and runs of two or three words that stand out alike.
"""

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.llm import common

#: Labelled texts to learn from, of each class; the bytes up to which a text is used, and those of a class in all.
TRAIN_TEXTS = {0: 3000, 1: 1500}
TRAIN_BYTES = 32 << 10
CLASS_BYTES = 8 << 20

GRAM = 5  # bytes of the n-grams that tell toxic text apart
WINDOW_BYTES = 64  # a longer word is cut into windows that overlap by half
MATCH_BYTES = 6  # shorter matches are noise: any syllable has them
SHORT_BYTES = MATCH_BYTES - 2  # with its spaces such a word is hardly a match: it is looked at twice in a row
APART = b"\xff"  # between parts of the toxic dictionary, never in UTF-8: no match spans two parts
ORDINARY_BYTES = 8192
TOXIC_BYTES = 16384  # of telling parts; the rarest beyond are left out
CONTEXT_BYTES = 40  # ordinary text behind each window: zstandard looks for no match in the last bytes of its input
CACHE_WORDS = 1 << 20  # gains a task remembers
_GATE_BITS = 20

_LOWER = common.lowered_table()
_SPACE = common.byte_table(common.SPACE_BYTES)
_SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())  # ASCII signs, spaces and controls
_SIGN = common.byte_table(_SIGNS)
_FOLDED = bytes(32 if b in _SIGNS else b for b in range(256))


def normalised(text):
    return b" " + b" ".join((text or "").encode("utf-8", "replace").translate(bytes(_LOWER)).split()) + b" "


def folded(text):
    """A normalised text with its signs as spaces."""
    return b" " + b" ".join(text.translate(_FOLDED).split()) + b" "


def _grams(text):
    """Distinct n-grams of a text as numbers, without those that hold a space between other bytes."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(data, GRAM)
    inner = ~(view[:, 1:-1] == 32).any(axis=1)
    numbers = sum(view[:, i].astype(np.int64) << (8 * i) for i in range(GRAM))
    return numbers[inner], np.flatnonzero(inner)


def _document_counts(texts, keys, at_once=1 << 20):
    """Distinct keys of texts, and in how many texts each is; about ``at_once`` bytes of text at a time."""
    known, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, size = [], 0
    for i, text in enumerate(texts):
        found.append(np.unique(keys(text)))
        size += len(text)
        if size >= at_once or i == len(texts) - 1:
            weights = np.concatenate([counts, np.ones(sum(map(len, found)), np.int64)])
            known, back = np.unique(np.concatenate([known, *found]), return_inverse=True)
            counts = np.bincount(back, weights).astype(np.int64)
            found, size = [], 0
    return known, counts


def telling_grams(toxic, ordinary, ratio=10.0, deviations=4.0):
    """N-grams in at least three (and one in 250) toxic texts whose share there stands out against ordinary ones."""
    return _telling(toxic, ordinary, lambda t: _grams(t)[0], ratio, deviations)


def _telling(toxic, ordinary, keys, ratio, deviations):
    found, n = _document_counts(toxic, keys)
    often = n >= max(3, len(toxic) // 250)
    found, n = found[often], n[often]
    m = np.zeros(len(found), np.int64)
    for text in ordinary if len(found) else ():
        m += np.isin(found, keys(text))
    return found[_stand_out(n, m, toxic, ordinary, ratio, deviations)]


def _stand_out(n, m, toxic, ordinary, ratio=10.0, deviations=4.0):
    least = max(3, len(toxic) // 250)
    size, other_size = max(len(toxic), 1), max(len(ordinary), 1)
    a, b, floor = n / size, m / other_size, 1 / other_size
    pooled = (n + m) / (size + other_size)
    spread = np.sqrt(pooled * (1 - pooled) * (1 / size + 1 / other_size))
    return (n >= least) & (a > ratio * (b + floor / 2)) & (a - b > deviations * spread)


def _runs(text, words):
    """Hashes of all runs of so many words of a folded text, with where they start and end."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = common.word_bounds(data != 32, np.array([0, len(data)]))
    starts, ends = starts[: max(0, len(starts) - words + 1)], ends[words - 1 :]
    return common.span_hashes(common.prefix_hashes(data), starts, ends).view(np.int64), starts, ends


def telling_phrases(toxic, ordinary, words, grams, deviations=6.0):
    """Runs of ``words`` words that stand out in toxic folded texts, with the spaces around them, each as often as found.

    Runs are far more than n-grams, so more stand out by chance: they have to by more deviations. Runs that hold a word
    with telling ``grams`` are left to that word.
    """
    hashes = _telling(toxic, ordinary, lambda t: _runs(t, words)[0], 10.0, deviations)
    out = []
    for text in toxic if len(hashes) else []:
        found, starts, ends = _runs(text, words)
        out.extend(text[starts[i] - 1 : ends[i] + 1] for i in np.flatnonzero(np.isin(found, hashes)).tolist())
    return [p for p in out if not np.isin(_grams(p)[0], grams).any()]


def telling_parts(text, grams):
    """Stretches of a text that these n-grams cover, cut at spaces but with the space next to them."""
    numbers, places = _grams(text)
    covered = np.zeros(len(text) + 1, np.int64)
    hits = places[np.isin(numbers, grams)]
    np.add.at(covered, hits, 1)
    np.add.at(covered, hits + GRAM, -1)
    inside = np.cumsum(covered)[:-1] > 0
    marks = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    stretches = [text[i:j] for i, j in zip(marks[::2], marks[1::2])]
    return [part for s in stretches for part in re.findall(rb" ?[^ ]+ ?", s)]


def twice(part):
    return part + part.lstrip()


def trained(samples, size):
    """A zstandard dictionary of at most ``size`` bytes.

    The samples themselves where they are no longer than that, and the end of them where zstandard reports that it cannot
    train on them: it needs some that repeat each other.
    """
    joined = b"".join(samples)
    if len(joined) <= size:
        return joined
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return joined[-size:]


def packed(parts, size):
    """Content of a dictionary from counted parts: commonest last, where matches are cheapest; none inside another."""
    content = b""
    for part, _ in sorted(parts.items(), key=lambda p: (-p[1], p[0])):
        if part not in content and len(part) + len(APART) + len(content) <= size:
            content = part + APART + content
    return content


def unlike(texts):
    """Texts without those of which half the runs of three words stand in earlier texts; one run in eight is looked at."""
    seen, out = set(), []
    for text in texts:
        words = text.split()
        runs = [zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))]
        runs = {r for r in runs if r % 8 == 0} or {min(runs)}
        if 2 * len(runs & seen) < len(runs):
            out.append(text)
        seen |= runs
    return out


class Dictionaries(NamedTuple):
    ordinary: bytes
    toxic: bytes
    context: bytes


def learn_dictionaries(toxic, ordinary):
    """Dictionaries from normalised texts of either class."""
    grams = telling_grams(toxic, ordinary)
    parts = [p for t in toxic for p in telling_parts(t, grams)]
    bare = [[folded(t) for t in texts] for texts in (toxic, ordinary)]
    grams = telling_grams(*bare)
    found = [p for t in bare[0] for p in telling_parts(t, grams)]
    parts += [twice(p) if len(p) <= SHORT_BYTES + 2 and p[:1] == p[-1:] == b" " else p for p in found]
    parts += [p for words in (2, 3) for p in telling_phrases(*bare, words, grams)]
    chunks = [t[i : i + 256] for t in ordinary for i in range(0, len(t), 256)]
    if parts:  # some texts are labelled wrongly: what is telling must not be in both dictionaries
        telling = re.compile(b"|".join(map(re.escape, sorted({p.strip() for p in parts} - {b""}))))
        chunks = [c for c in chunks if not telling.search(c)]
    base = trained(chunks[:: max(1, len(chunks) // 20_000)], ORDINARY_BYTES)
    telling = packed(Counter(parts), TOXIC_BYTES)
    return Dictionaries(base, telling + base, base[-CONTEXT_BYTES:])


def _codes(data):
    """Numbers of all runs of ``MATCH_BYTES`` bytes, and which of them hold a space between other bytes."""
    size = max(0, len(data) - MATCH_BYTES + 1)
    codes, spans = np.zeros(size, np.int64), np.zeros(size, bool)
    for i in range(MATCH_BYTES):
        part = data[i : i + size]
        codes |= part.astype(np.int64) << (8 * i)
        if 0 < i < MATCH_BYTES - 1:
            spans |= part == 32
    return codes, spans


class _Spaced:
    """Words of a piece of texts with one space before each and behind the last."""

    def __init__(self, letters, starts, ends, rows):
        lengths = ends - starts
        self.text = np.full(len(letters) + len(lengths) + 1, 32, np.uint8)
        self.text[np.arange(len(letters)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)] = letters
        self.ends = np.cumsum(lengths + 1)
        self.starts = self.ends - lengths
        self.rows = rows

    def word(self, first, last):
        return self.text[self.starts[first] : self.ends[last]].tobytes()


class Gains:
    """Gains of words, remembered within a task."""

    def __init__(self, dictionaries):
        self.context = dictionaries.context
        self.ordinary = self._compressor(dictionaries.ordinary)
        self.toxic = self._compressor(dictionaries.toxic)
        self.known = {}
        telling = np.frombuffer(dictionaries.toxic[: len(dictionaries.toxic) - len(dictionaries.ordinary)], np.uint8)
        self.codes = np.unique(_codes(telling)[0])
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[self._address(self.codes)] = True

    @staticmethod
    def _address(codes):
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _GATE_BITS)

    @staticmethod
    def _compressor(content):
        parameters = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, strategy=zstandard.STRATEGY_LAZY2, min_match=MATCH_BYTES,
            window_log=16, hash_log=14, chain_log=14, search_log=5, target_length=64,
            write_checksum=0, write_content_size=0, write_dict_id=0,
        )
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
        return zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters).compress

    def of_word(self, word):
        best = 0
        if len(word) <= SHORT_BYTES:
            word = word + b" " + word
        for at in range(0, max(1, len(word) - WINDOW_BYTES // 2), WINDOW_BYTES // 2):
            window = b" " + word[at : at + WINDOW_BYTES] + b" " + self.context
            best = max(best, len(self.ordinary(window)) - len(self.toxic(window)))
        return best

    def largest(self, data, offsets):
        """The largest gain of each row of a piece; 0 for rows without words."""
        out = np.zeros(len(offsets) - 1, np.int64)
        if not len(self.codes):
            return out
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        lower = _LOWER[data]
        for apart in (_SPACE, _SIGN):
            letters = ~apart[lower]
            words = _Spaced(lower[letters], *common.word_bounds(letters, offsets))
            if not len(words.rows):
                continue
            codes, spans = _codes(words.text)
            places = self._telling(codes, np.arange(len(codes)))
            self._words(words, places[~spans[places]], out)
            if apart is _SIGN:
                self._phrases(words, places[spans[places]], out)
        return out

    def _telling(self, codes, places):
        """Those of the places whose code is in the telling part."""
        some = self.gate[self._address(codes)]
        codes, places = codes[some], places[some]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return places[self.codes[at] == codes]

    def _words(self, words, places, out):
        """Words with telling bytes in them, and those of two or three bytes that have some when looked at twice."""
        k = np.searchsorted(words.starts, places + 1, "right") - 1
        found = [k[places + MATCH_BYTES <= words.ends[k] + 1]]
        for size in (2, 3):
            short = np.flatnonzero(words.ends - words.starts == size)
            double = np.full((2 * size + 2, len(short)), 32, np.uint8)
            for i in range(size):
                double[1 + i] = double[2 + size + i] = words.text[words.starts[short] + i]
            codes = sum(double[i].astype(np.int64) << (8 * i) for i in range(MATCH_BYTES))
            found.append(self._telling(codes, short))
        for k in np.unique(np.concatenate(found)).tolist():
            self._take(words, k, k, out)

    def _phrases(self, words, places, out):
        """Two and three words around each space that a match in the telling part spans."""
        windows = set()
        for place in places.tolist():
            lo = int(np.searchsorted(words.ends, place))  # the word that ends behind this byte, or the one before this space
            hi = int(np.searchsorted(words.starts, place + MATCH_BYTES - 1, "right")) - 1
            for k in range(lo, hi):
                windows.update(((k, k + 1), (k - 1, k + 1), (k, k + 2)))
        for i, j in windows:
            if 0 <= i and j < len(words.rows) and words.rows[i] == words.rows[j]:
                self._take(words, i, j, out)

    def _take(self, words, first, last, out):
        window = words.word(first, last)
        gain = self.known.get(window)
        if gain is None:
            gain = self.known[window] = self.of_word(window)
        row = words.rows[first]
        out[row] = max(out[row], gain)


class Model(NamedTuple):
    dictionaries: Dictionaries
    chances: tuple  # by largest gain: chance that the label is 1, never falling


def _rising(chances, weights):
    """The nearest sequence that never falls (pool adjacent violators)."""
    pools = []
    for value, weight in zip(chances, weights):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v, w, n = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + v * w) / (pools[-1][1] + w), pools[-1][1] + w, pools[-1][2] + n]
    return [v for v, _, n in pools for _ in range(n)]


def fit(toxic, ordinary, share):
    """A model from texts of either class; ``share`` is the share of label 1 among all labelled rows.

    Of each class, two thirds train the dictionaries and one third calibrates. Copies and near copies count once.
    """
    toxic, ordinary = (unlike(map(normalised, texts)) for texts in (toxic, ordinary))
    dictionaries = learn_dictionaries(*[[t for i, t in enumerate(ts) if i % 3] for ts in (toxic, ordinary)])
    gains = Gains(dictionaries)
    levels = []
    for texts in (toxic[::3], ordinary[::3]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        levels.append(np.minimum(gains.largest(data, offsets), 31))
    n1, n0 = (np.bincount(x, minlength=32) for x in levels)
    tail = np.linspace(0.02, 0.2, 32)  # without evidence, larger gains are likelier toxic
    like1 = (n1 + tail) / (n1.sum() + tail.sum())
    like0 = (n0 + tail[::-1]) / (n0.sum() + tail.sum())
    share = min(max(share, 1e-3), 1 - 1e-3)
    chances = share * like1 / (share * like1 + (1 - share) * like0)
    return Model(dictionaries, tuple(_rising(chances.tolist(), (n1 + n0 + tail).tolist())))


def held_out(key):
    """Rows kept from learning: CRC-32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _fit_in_task(batches):
    """One row, the model, from all rows (label, text, share)."""
    texts, left, share = {0: [], 1: []}, {0: CLASS_BYTES, 1: CLASS_BYTES}, 0.0
    for batch in batches:
        for label, text, share in zip(*[column.to_pylist() for column in batch.columns]):
            left[label] -= len(text.encode("utf-8", "replace"))
            if left[label] >= 0:
                texts[label].append(text)
    model = fit(texts[1], texts[0], share)
    columns = [pa.array([content], pa.binary()) for content in model.dictionaries]
    columns.append(pa.array([list(model.chances)], pa.list_(pa.float64())))
    yield pa.RecordBatch.from_arrays(columns, names=[*Dictionaries._fields, "chances"])


def learn(df, labels, key="doc_id", text="text", label="toxic", learnable=lambda key: ~held_out(key)):
    """A model learnt from a bounded sample of labelled rows, in one task that gives back the model alone.

    Of each class at most ``TRAIN_TEXTS`` keys, by hash of the key, and of their texts at most ``CLASS_BYTES`` bytes, in
    the order of that hash. Labels other than 0 and 1, null keys and rows that are not ``learnable`` are left out, and
    texts of more than ``TRAIN_BYTES``. The sample's keys are broadcast (their number is the bound), the texts come from
    one scan. Without labelled texts every text gets the same low score.
    """
    marked = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
    marked = marked.filter(F.col("key").isNotNull() & F.col("label").isin(0, 1) & learnable(F.col("key")))
    counts = {row["label"]: row["count"] for row in marked.groupBy("label").count().collect()}
    order = [F.xxhash64(F.col("key").cast("string")), "key"]
    picked = [marked.filter(F.col("label") == c).orderBy(*order).limit(n).dropDuplicates(["key"]) for c, n in TRAIN_TEXTS.items()]
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    texts = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    texts = texts.filter(F.octet_length("text").between(1, TRAIN_BYTES))
    share = F.lit(counts.get(1, 0) / max(1, sum(counts.values())))
    rows = texts.join(sample, "key").repartition(1).sortWithinPartitions(*order, "text")
    schema = "ordinary binary, toxic binary, context binary, chances array<double>"
    found = rows.select("label", "text", share.alias("share")).mapInArrow(_fit_in_task, schema).first()
    if found is None:  # no row, no task
        return fit([], [], 0.0)
    return Model(Dictionaries(*[bytes(found[c]) for c in Dictionaries._fields]), tuple(found["chances"]))


def score(df, model, text="text", keep=None):
    """Rows (row, gain, score) for every row of ``df``: the largest gain of its words, and the chance of label 1.

    Whole texts are looked at, of any length; a word of more than ``WINDOW_BYTES`` is cut into windows. A null or empty
    text has gain 0. Repeated rows are scored each, equal texts alike; columns of any name stay inside ``row``. An empty
    table gives an empty result.
    """
    held = []

    def run(array):
        if not held:
            held.append((Gains(model.dictionaries), np.array(model.chances)))
        gains, chances = held[0]
        gain = np.concatenate([gains.largest(d, o) for _, d, o in common.pieces(array)] or [np.zeros(0, np.int64)])
        return [pa.array(gain, pa.int64()), pa.array(chances[np.minimum(gain, 31)], pa.float64())]

    fields = [T.StructField("gain", T.LongType()), T.StructField("score", T.DoubleType())]
    return common.annotate(df, text, run, fields, keep)


def toxicity_report(df, labels, key="doc_id", threshold=0.7):
    scored = score(df, learn(df, labels, key), keep=[key])
    return scored.select(
        F.col("row").getField(key).alias(key),
        held_out(F.col("row").getField(key)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "gain",
    )
