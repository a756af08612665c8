"""Benchmark decontamination: a broadcast set of test n-grams, scanned over word windows of every text.

Words are lower-cased runs of letters and digits. The distinct windows of all benchmark items (``n`` words; an item with
fewer is one window) are numbered, and hashed into a set whose bytes are measured before it is broadcast; a longer list
is cut into blocks of that size, and scanned block after block. Every window of every text is looked up by a rolling
hash, hits are verified word by word, and runs of hit words are returned as spans. A scan returns numbers of windows;
which items hold them, however many, is a join of tables.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.llm import common
from textharbor.session import write_and_read

#: Bytes of the windows of one broadcast block, and what a window takes beside its bytes.
BLOCK_BYTES = 32 << 20
WINDOW_BYTES = 200

#: Address bits of the table that turns most windows away before the sorted hashes are searched.
_GATE_BITS = 20

_LOWER = common.lowered_table()
#: Words: anything but ASCII characters that are neither letters nor digits.
_WORD = common.byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("first", "last", "start", "end")])
_STATE = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("windows", T.ArrayType(T.LongType())),
    T.StructField("runs", T.ArrayType(RUN)),
]


class Words:
    """Words of one piece of texts, and hashes of their windows."""

    def __init__(self, data, offsets):
        self.lower = _LOWER[data]
        self.starts, self.ends, self.rows = common.word_bounds(_WORD[self.lower], offsets)
        hashes = common.span_hashes(common.prefix_hashes(self.lower), self.starts, self.ends)
        self.sums = common.prefix_hashes(hashes)

    def windows(self, n):
        """First words of all windows of ``n`` words, and their hashes."""
        first = np.arange(len(self.starts) - n + 1)
        first = first[self.rows[first] == self.rows[first + n - 1]]
        return first, common.span_hashes(self.sums, first, first + n)

    def text(self, first, n):
        data = self.lower
        return b" ".join(data[self.starts[i] : self.ends[i]].tobytes() for i in range(first, first + n))


def benchmark_windows(benchmark, key, text, n):
    """Distinct rows (item, words, window): the windows of every item; items without words have none."""

    def cut(array):
        out = []
        for _, data, offsets in common.pieces(array):
            found = Words(data, offsets)
            counts = np.bincount(found.rows, minlength=len(offsets) - 1)
            at = 0
            for count in counts:
                size = min(n, int(count))
                starts = range(at, at + count - size + 1) if size else ()
                out.append([{"words": size, "window": found.text(i, size)} for i in starts])
                at += int(count)
        kind = pa.list_(pa.struct([("words", pa.int64()), ("window", pa.binary())]))
        return [pa.array(out, kind)]

    window = T.StructType([T.StructField("words", T.LongType()), T.StructField("window", T.BinaryType())])
    cuts = common.annotate(benchmark, text, cut, [T.StructField("windows", T.ArrayType(window))], keep=[key])
    item = F.coalesce(F.col("row").getField(key).cast("string"), F.lit(""))
    return cuts.select(item.alias("item"), F.explode("windows").alias("w")).select("item", "w.*").distinct()


class Block:
    """One broadcast block of numbered windows."""

    def __init__(self, rows):
        self.numbers, lengths = {}, defaultdict(set)
        for row in rows:
            window = bytes(row["window"])
            self.numbers[window] = row["number"]
            lengths[row["words"]].add(window)
        self.hashes = {}
        for n, windows in lengths.items():
            joined = b"\n".join(sorted(windows))  # a line per window, one row of n words each
            data = np.frombuffer(joined, np.uint8)
            ends = np.concatenate([np.flatnonzero(data == 10), [len(data)]])
            found = Words(data, np.concatenate([[0], ends]))
            first, hashes = found.windows(n)
            gate = np.zeros(1 << _GATE_BITS, bool)
            gate[hashes >> np.uint64(64 - _GATE_BITS)] = True
            self.hashes[n] = np.sort(hashes), gate

    def hits(self, found):
        """Verified (first word, number of words, number of the window) in the words of a piece."""
        for n, (known, gate) in self.hashes.items():
            first, hashes = found.windows(n)
            near = np.flatnonzero(gate[hashes >> np.uint64(64 - _GATE_BITS)])
            at = np.minimum(np.searchsorted(known, hashes[near]), len(known) - 1)
            for i in first[near[known[at] == hashes[near]]].tolist():
                number = self.numbers.get(found.text(i, n))
                if number is not None:
                    yield i, n, number


def _scan_piece(block, data, offsets, windows, runs):
    """Per row of the piece: number of words, hit words, windows and runs, added to what earlier blocks found."""
    found = Words(data, offsets)
    rows = len(offsets) - 1
    counts = np.bincount(found.rows, minlength=rows)
    begins = np.concatenate([[0], np.cumsum(counts)])
    steps = np.zeros(len(found.starts) + 1, np.int64)
    for row, earlier in enumerate(runs):
        for run in earlier or ():
            steps[begins[row] + run["first"]] += 1
            steps[begins[row] + run["last"] + 1] -= 1
    seen = {row: set(known) for row, known in enumerate(windows) if known}
    for i, n, number in block.hits(found):
        steps[i] += 1
        steps[i + n] -= 1
        seen.setdefault(int(found.rows[i]), set()).add(number)
    hit = np.cumsum(steps[:-1]) > 0
    n_hit = np.bincount(found.rows[hit], minlength=rows)
    out_runs = [[] for _ in range(rows)]
    before = np.concatenate([[False], hit[:-1]]) & (np.diff(found.rows, prepend=-1) == 0)
    opens = np.flatnonzero(hit & ~before)
    after = np.concatenate([hit[1:], [False]]) & (np.diff(found.rows, append=-1) == 0)
    closes = np.flatnonzero(hit & ~after)
    for i, j in zip(opens.tolist(), closes.tolist()):
        row = int(found.rows[i])
        first, shift = int(begins[row]), int(offsets[row])
        run = {"first": i - first, "last": j - first, "start": int(found.starts[i]) - shift, "end": int(found.ends[j]) - shift}
        out_runs[row].append(run)
    return counts, n_hit, [sorted(seen.get(row, ())) for row in range(rows)], out_runs


def _scan(df, block, text):
    """One pass over rows (row, [text,] n_words, n_hit, windows, runs) against one block of windows."""
    shared = common.share(df.sparkSession, block)
    names = df.columns
    runs_type = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))

    def run(batches):
        block = common.opened(shared)
        for batch in batches:
            columns = dict(zip(names, batch.columns))
            texts = columns["text"] if "text" in columns else columns["row"].field(text)
            windows, runs = columns["windows"].to_pylist(), columns["runs"].to_pylist()
            out = [[], [], [], []]
            for at, data, offsets in common.pieces(texts):
                end = at + len(offsets) - 1
                for into, got in zip(out, _scan_piece(block, data, offsets, windows[at:end], runs[at:end])):
                    into.extend(got)
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), runs_type]
            columns |= {f.name: pa.array(v, t) for f, v, t in zip(_STATE, out, types)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return df.mapInArrow(run, df.schema)


def numbered_windows(benchmark, key, text, n):
    """Rows (number, words, window, block) of the distinct windows, written, and rows (number, item) of who has them.

    Blocks are cut by prefix sums of bytes in the order of a hash, so that each but for one window has at most
    ``BLOCK_BYTES``.
    """
    found = write_and_read(benchmark_windows(benchmark, key, text, n), "benchmark-windows")
    size = (F.octet_length("window") + WINDOW_BYTES).cast("long").alias("size")
    distinct = found.select("words", "window").distinct().select("*", size, F.lit(1).cast("long").alias("one"))
    order = [F.xxhash64("window"), "window", "words"]
    ranged = common.sorted_ranges(distinct, order, "window-ranges")
    summed = common.prefix_sums(ranged, order, ["size", "one"])
    block = F.expr(f"before_size div {BLOCK_BYTES}").alias("block")
    windows = write_and_read(summed.select(F.col("before_one").alias("number"), "words", "window", block), "windows")
    return windows, found.join(windows, ["words", "window"]).select("number", "item")


def _scanned(df, windows, text, keep):
    """Rows (row, n_words, n_hit, windows, runs) of ``df`` against all blocks; every block after the first reads what the
    one before it wrote."""
    last = windows.agg(F.max("block")).first()[0] or 0
    columns = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")]
    if text not in keep:
        columns.append(F.col(f"`{text}`").cast("string").alias("text"))
    empty = [F.lit(None if i > 1 else 0).cast(f.dataType).alias(f.name) for i, f in enumerate(_STATE)]
    state = df.select(*columns, *empty)
    for number in range(last + 1):
        rows = windows.filter(F.col("block") == number).collect()  # BLOCK_BYTES, as measured
        if number:
            state = write_and_read(state, "decontaminate")
        state = _scan(state, Block(rows), text)
    return state.select("row", *[f.name for f in _STATE])


def _with_items(state, holders):
    """``items`` in the place of ``windows``: the sorted distinct items that hold one of a row's windows."""
    names = [f.name for f in _STATE]
    state = write_and_read(state.withColumn("place", F.monotonically_increasing_id()), "contamination")
    hits = state.select("place", F.explode("windows").alias("number")).join(holders, "number")
    items = hits.select("place", "item").distinct().groupBy("place").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return state.join(items, "place", "left").select(
        "row", *[F.coalesce("items", F.array().cast("array<string>")).alias("items") if n == "windows" else n for n in names]
    )


def find_contamination(df, benchmark, key="item_id", text="text", item_text="text", n=10, keep=None):
    """Rows (row, n_words, n_hit, items, runs): ``row`` holds the columns in ``keep`` (all by default).

    ``n_hit`` counts words inside any occurrence of a benchmark window, ``items`` are the sorted keys (as strings, a
    null key as "") of items with an occurring window, ``runs`` the maximal runs of hit words: first and last word,
    start and end byte of the UTF-8 text. A null or empty text has no words. Items without words match nothing; an
    empty benchmark leaves everything clean. Repeated rows are scanned each; repeated items count once. Columns of
    any name may be there, as they stay inside ``row``.
    """
    windows, holders = numbered_windows(benchmark, key, item_text, n)
    return _with_items(_scanned(df, windows, text, df.columns if keep is None else keep), holders)


def contamination_report(df, benchmark, key="doc_id", **options):
    """One row per document: counts, the digest of the items hit, and whether it is contaminated."""
    found = find_contamination(df, benchmark, keep=[key], **options)
    return found.select(
        F.col("row").getField(key).alias(key),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut_spans(found, text="text"):
    """The rows of :func:`find_contamination` as they were, with the runs of hit words cut out of the text."""
    value = F.col("row").getField(text).cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("runs", lambda r: r["end"]))
    ends = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.octet_length(value).cast("long")))
    kept = F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda p: F.substring(value, (p["s"] + 1).cast("int"), (p["e"] - p["s"]).cast("int")),
    )
    cleaned = F.when(F.size("runs") > 0, F.array_join(F.transform(kept, lambda b: b.cast("string")), ""))
    columns = [
        F.coalesce(cleaned, F.col("row").getField(c)).alias(c) if c == text else F.col("row").getField(c).alias(c)
        for c in found.schema["row"].dataType.names
    ]
    return found.select(*columns)


def decontaminate(df, benchmark, key="item_id", text="text", item_text="text", n=10, remove="documents"):
    """``df`` without contaminated documents, or with the hit spans cut out (``remove="spans"``).

    What counts as contaminated, and nulls, repeated rows and empty tables, are as in :func:`find_contamination`; which
    items are hit is not asked, so texts are scanned and not written.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    windows, _ = numbered_windows(benchmark, key, item_text, n)
    found = _scanned(df, windows, text, df.columns)
    return found.filter("n_hit = 0").select("row.*") if remove == "documents" else cut_spans(found, text)
