"""Repeated byte strings across documents, by a merged array of anchored suffixes.

A document byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller key.

Sorting the suffixes at every byte would move fifty times the corpus. Instead every window of ``length`` bytes elects
an anchor, the k-byte string in it with the smallest hash; equal windows elect the same anchor at the same place, so it
is enough to look at anchors (about one byte in fourteen), and only at those whose k bytes stand in two documents:

1. Hashes of anchors are exchanged by bucket; anchors found in one document only are dropped there.
2. Tasks sort the suffixes that start at the remaining anchors and exchange them as front-coded runs: per suffix the
   length shared with the one before and the bytes after that, and the bytes left of the anchor.
3. Buckets merge their runs with a loser tree that keeps, for every waiting suffix, the length it shares with the last
   one put out, so known prefixes are never compared again. The merge yields the array and its common prefixes (LCP).
4. A window that starts o bytes left of its anchor equals another if the suffixes share length - o bytes, which is an
   interval of the array cut by LCP, and the o bytes left agree. Classes of equal windows yield their smallest key.

All suffixes of an anchor meet in one bucket, however many there are. So step 1 also counts the entries of every anchor,
and the windows of anchors above a bound take another way: they are dealt by a 128-bit hash of all their bytes, of which
each chunk sends the smallest key once, and every bucket finds the smallest of all.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.llm import common
from textharbor.llm.loser_tree import merge_runs
from textharbor.session import write_and_read

LENGTH = 50
ANCHOR = 24
#: Text bytes for each bucket of the exchanges.
BUCKET_BYTES = 16 << 20
#: Anchors a task gathers before it sends them on, and suffixes, which take more room.
CHUNK_ANCHORS = 1 << 19
CHUNK_SUFFIXES = 1 << 18
#: Entries above which the suffixes of an anchor are not merged in one bucket, at least; and hot anchors at most, of
#: which every task holds the hashes.
HOT_ENTRIES = 1 << 16
HOT_ANCHORS = 1_000_000

_POSITION_BITS = np.uint64(20)
_POSITION = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
#: Keys of rows without one: later than all others, and never the smaller document.
NO_KEY = np.iinfo(np.int64).max


def anchor_runs(data, offsets, length=LENGTH, k=ANCHOR):
    """Anchors of a piece of rows: place, first and last window start they were elected for, and hash of their bytes.

    Works through window starts in steps, so a long row needs no more memory than a short one beyond its bytes.
    """
    out = []
    step = 1 << 18
    for base in range(0, max(0, len(data) - length + 1), step):
        part = data[base : base + step + length - 1]
        sums = common.prefix_hashes(part)
        at = np.arange(len(part) - k + 1)
        hashes = common.span_hashes(sums, at, at + k)
        low = (hashes & ~_POSITION) | at.astype(np.uint64)
        width, span = 1, length - k + 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: -(span - width)], low[span - width :])
        starts = np.arange(base, base + len(low))
        row = np.searchsorted(offsets, starts, "right") - 1
        good = np.flatnonzero(starts + length <= offsets[row + 1])
        if not len(good):
            continue
        place = (low[good] & _POSITION).astype(np.int64)
        new = np.ones(len(good), bool)
        new[1:] = (place[1:] != place[:-1]) | (good[1:] != good[:-1] + 1) | (row[good[1:]] != row[good[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(good)) - 1
        place = place[first]
        out.append((base + place, base + good[first], base + good[last], hashes[place], row[good[first]]))
    if not out:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    return [np.concatenate(x) for x in zip(*out)]


def _packed(array):
    """Numbers or bytes, compressed; numbers of more than 16 bits as planes, so that high zeros cost nothing."""
    if array.dtype.itemsize == 4:
        array = np.concatenate([(array & 0xFFFF).astype(np.uint16), (array >> 16).astype(np.uint16)])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).data if len(array) else b"")


def _unpacked(data, kind):
    raw = zstandard.ZstdDecompressor().decompress(data)
    if np.dtype(kind).itemsize < 4 or kind == np.int64:
        return np.frombuffer(raw, kind)
    low, high = np.frombuffer(raw, np.uint16).reshape(2, -1).astype(np.uint32)
    return low | (high << np.uint32(16))


def _steps(numbers):
    """Numbers that rise by 255 at most from one to the next, as bytes."""
    return np.diff(numbers, prepend=0).astype(np.uint8)


def _columns(batch):
    keys = np.asarray(batch.column("id").fill_null(NO_KEY))
    return keys, np.asarray(batch.column("print"))


# -- which anchors stand in two documents -------------------------------------------------------------------------

_PAYLOAD = T.StructType([
    T.StructField("bucket", T.LongType()),
    *[T.StructField(c, T.BinaryType()) for c in ("hashes", "flags", "docs", "places", "ids", "prints")],
])
_PLAIN, _WITNESS, _SURE = 0, 1, 2


def _payloads(hashes, docs, places, ids, prints, buckets, number):
    """Rows of one chunk of anchors, one for each bucket.

    A hash with several documents in the chunk needs no answer: its anchors go along as sure, dealt out evenly, and
    the hash is sent once as witness, with their number as place. So a string of any frequency costs a bucket one entry
    per chunk.
    """
    order = np.lexsort((ids[docs], hashes))
    inner = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], inner[1:] != inner[:-1]]))
    last = np.append(first[1:], len(hashes)) - 1
    several = ids[docs[order[first]]] != ids[docs[order[last]]]
    sure = np.empty(len(hashes), bool)
    sure[order] = np.repeat(several, last - first + 1)
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    bucket[sure] = (np.arange(int(sure.sum())) // 4096 + number) % buckets
    by_row = np.argsort(order[first[several]])
    witness, times = order[first[several]][by_row], (last - first + 1)[several][by_row]
    kinds = np.where(sure, _SURE, _PLAIN).astype(np.uint8)
    short = ((hashes // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    bucket = np.concatenate([bucket, (hashes[witness] % np.uint64(buckets)).astype(np.int64)])
    kinds = np.concatenate([kinds, np.full(len(witness), _WITNESS, np.uint8)])
    short, docs = np.concatenate([short, short[witness]]), np.concatenate([docs, docs[witness]])
    places = np.concatenate([places, times])
    order = np.lexsort((places, docs, bucket))  # rows of a bucket by document: its numbers then compress well
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
        mine = order[lo:hi]
        known, back = np.unique(docs[mine], return_inverse=True)
        yield (
            int(bucket[mine[0]]), short[mine].tobytes(), _packed(kinds[mine]), _packed(_steps(back)),
            _packed(places[mine].astype(np.uint32)), ids[known].tobytes(), prints[known].tobytes(),
        )


def _batch(rows, schema):
    names = schema.names
    types = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() for f in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


def _send_anchors(buckets, length):
    def run(batches):
        held, size, number = [], 0, 0

        def chunk():
            hashes, docs, places, ids, prints = [np.concatenate(x) for x in zip(*held)]
            return _batch(list(_payloads(hashes, docs, places, ids, prints, buckets, number)), _PAYLOAD)

        rows = 0
        for batch in batches:
            ids, prints = _columns(batch)
            for at, data, offsets in common.pieces(batch.column("text")):
                place, _, _, hashes, row = anchor_runs(data, offsets, length)
                n = len(offsets) - 1
                held.append((hashes, row + rows, place - offsets[row], ids[at : at + n], prints[at : at + n]))
                rows, size = rows + n, size + len(place)
                if size >= CHUNK_ANCHORS:
                    yield chunk()
                    held, size, rows, number = [], 0, 0, number + 1
        if size:
            yield chunk()

    return run


_FOUND = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("print", T.LongType()), T.StructField("place", T.IntegerType()),
    T.StructField("hot", T.LongType()),  # instead of a place: an anchor with more entries than the bound
])


def _codes(hashes, buckets):
    """Numbers that tell anchors apart as buckets do: bucket and part of the hash."""
    short = ((hashes // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return ((hashes % np.uint64(buckets)).astype(np.int64) << 32) | short


def _keep_shared(bound):
    return lambda table: _shared_of(table, bound)


def _shared_of(table, bound):
    """Anchors of a bucket whose hash is in two documents: sure ones, and others by comparison; and the hot ones."""
    parts = [[], [], [], [], []]
    columns = table.to_pydict()
    for hashes, flags, docs, places, ids, prints in zip(*[columns[f.name] for f in _PAYLOAD][1:]):
        docs = np.cumsum(_unpacked(docs, np.uint8), dtype=np.int64)
        parts[0].append(np.frombuffer(hashes, np.uint32))
        parts[1].append(_unpacked(flags, np.uint8))
        parts[2].append(np.frombuffer(ids, np.int64)[docs])
        parts[3].append(np.frombuffer(prints, np.int64)[docs])
        parts[4].append(_unpacked(places, np.uint32))
    hashes, flags, ids, prints, places = [np.concatenate(x) for x in parts]
    asked = np.flatnonzero(flags != _SURE)
    order = asked[np.argsort(hashes[asked], kind="stable")]
    keep, hot = flags == _SURE, np.zeros(0, np.int64)
    if len(order):
        first = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
        low, high = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
        seen = np.maximum.reduceat(flags[order], first)
        sizes = np.diff(np.append(first, len(order)))
        shared = np.repeat((low != high) | (seen == _WITNESS), sizes)
        keep[order[shared & (flags[order] == _PLAIN)]] = True
        entries = np.add.reduceat(np.where(flags[order] == _WITNESS, places[order].astype(np.int64), 1), first)
        hot = hashes[order][first[entries > bound]].astype(np.int64) | (columns["bucket"][0] << 32)
    zeros = np.zeros(len(hot), np.int64)
    return pa.table({
        "id": np.concatenate([ids[keep], zeros]), "print": np.concatenate([prints[keep], zeros]),
        "place": np.concatenate([places[keep].astype(np.int32), zeros.astype(np.int32)]),
        "hot": pa.concat_arrays([pa.nulls(int(keep.sum()), pa.int64()), pa.array(hot, pa.int64())]),
    })


# -- runs of suffixes ---------------------------------------------------------------------------------------------

_RUN = T.StructType([
    T.StructField("bucket", T.LongType()),
    *[T.StructField(c, T.BinaryType()) for c in (
        "shared", "sizes", "tails", "left_sizes", "lefts", "docs", "ids", "prints", "places", "done")],
])
_DONE = np.dtype([("id", "<i8"), ("print", "<i8"), ("start", "<i4"), ("end", "<i4")])
_WINDOW = np.dtype([("high", "<u8"), ("low", "<u8"), ("id", "<i8"), ("print", "<i8"), ("start", "<i4")])


def _gather(data, starts, sizes):
    """Bytes data[start : start + size] of all entries in a row."""
    ends = np.cumsum(sizes)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _matrix(flat, sizes, width):
    out = np.zeros((len(sizes), width), np.uint8)
    out[np.arange(width) < np.asarray(sizes)[:, None]] = flat
    return out


def _lcp(rows, sizes):
    """Bytes that each row shares with the one before it."""
    shared = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        shared[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return shared


def _as_strings(rows):
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _code_runs(suffixes, sizes, lefts, left_sizes, ids, prints, places, buckets, number, length, k):
    """Front-coded sorted runs of one chunk, one for each bucket.

    Where several documents have an anchor with the same bytes around it, all but the smallest are done: their windows
    start in that document too. Only the smallest waits for other chunks, so common passages cost one entry a chunk.
    """
    order = np.lexsort((ids, left_sizes, _as_strings(lefts), sizes, _as_strings(suffixes)))
    rows, n = np.concatenate([suffixes[order], lefts[order]], axis=1), len(order)
    same = np.zeros(n, bool)
    same[1:] = (rows[1:] == rows[:-1]).all(axis=1)
    same[1:] &= (sizes[order][1:] == sizes[order][:-1]) & (left_sizes[order][1:] == left_sizes[order][:-1])
    group = np.cumsum(~same) - 1
    lowest = ids[order][np.flatnonzero(~same)][group]
    is_done = ids[order] > lowest
    done, order = order[is_done], order[~is_done]
    settled = np.empty(len(done), _DONE)
    settled["id"], settled["print"] = ids[done], prints[done]
    settled["start"], settled["end"] = places[done] - left_sizes[done], places[done] + sizes[done]
    powers = common.mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    deal = (common.mixed((suffixes[order, :k].astype(np.uint64) + np.uint64(1)) * powers).sum(axis=1, dtype=np.uint64)
            % np.uint64(buckets)).astype(np.int64)
    order = order[np.argsort(deal, kind="stable")]
    deal = np.sort(deal, kind="stable")
    cuts = np.flatnonzero(np.diff(deal, prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
        mine = order[lo:hi]  # sorted by suffix, then by what is left of it
        shared = _lcp(suffixes[mine], sizes[mine])
        tails = suffixes[mine][(np.arange(length) >= shared[:, None]) & (np.arange(length) < sizes[mine][:, None])]
        left = lefts[mine][np.arange(lefts.shape[1]) < left_sizes[mine][:, None]]
        known, back = np.unique(np.stack([ids[mine], prints[mine]]), axis=1, return_inverse=True)
        yield (
            int(deal[lo]), _packed(shared.astype(np.uint8)), _packed(sizes[mine].astype(np.uint8)), _packed(tails),
            _packed(left_sizes[mine].astype(np.uint8)), _packed(left), _packed(back.ravel().astype(np.uint32)),
            known[0].tobytes(), known[1].tobytes(), _packed(places[mine].astype(np.uint32)), b"",
        )
    yield from _settled_rows(settled, buckets, number)


#: A second value of each byte, for a second hash.
_OTHER = common.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _windows(sums, first, last, row, ids, prints, offsets, length):
    """All windows that start from ``first`` to ``last``, with both hashes of their bytes, taken from prefix sums."""
    sizes = last - first + 1
    ends = np.cumsum(sizes)
    starts = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
    out, row = np.empty(len(starts), _WINDOW), np.repeat(row, sizes)
    out["high"], out["low"] = (common.span_hashes(s, starts, starts + length) for s in sums)
    out["id"], out["print"], out["start"] = ids[row], prints[row], starts - offsets[row]
    return out


def _lowest(windows):
    """For each hash the windows of the smallest key (several only where that key has it repeatedly), and the others."""
    windows = windows[np.lexsort((windows["id"], windows["low"], windows["high"]))]
    new = np.ones(len(windows), bool)
    new[1:] = (windows["high"][1:] != windows["high"][:-1]) | (windows["low"][1:] != windows["low"][:-1])
    lowest = windows["id"][new][np.cumsum(new) - 1]
    return windows[windows["id"] == lowest], windows[windows["id"] > lowest]


def _as_spans(windows, length):
    """Spans of windows; those of a text that follow each other byte by byte are one."""
    windows = windows[np.lexsort((windows["start"], windows["print"], windows["id"]))]
    new = np.ones(len(windows), bool)
    new[1:] = (windows["id"][1:] != windows["id"][:-1]) | (windows["print"][1:] != windows["print"][:-1])
    new[1:] |= windows["start"][1:] > windows["start"][:-1] + 1
    out = np.empty(int(new.sum()), _DONE)
    for c in ("id", "print", "start"):
        out[c] = windows[c][new]
    out["end"] = windows["start"][np.append(np.flatnonzero(new)[1:], len(windows)) - 1] + length if len(windows) else 0
    return out


def _settled_rows(settled, buckets, number):
    nothing = (b"",) * 9
    for lo in range(0, len(settled), 1 << 16):
        part = settled[lo : lo + (1 << 16)]
        yield ((number + (lo >> 16)) % buckets, *nothing, zstandard.ZstdCompressor(level=1).compress(part.tobytes()))


def _window_rows(windows, buckets, number, length):
    """Rows of the windows of hot anchors in one chunk: those of the smallest key by bucket, and spans settled here.

    Their buckets are numbered behind those of runs.
    """
    waiting, done = _lowest(windows)
    deal = (waiting["high"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(deal, kind="stable")
    waiting, deal = waiting[order], deal[order]
    cuts = np.flatnonzero(np.diff(deal, prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(deal))):
        packed = zstandard.ZstdCompressor(level=1).compress(waiting[lo:hi].tobytes())
        yield (buckets + int(deal[lo]), *(b"",) * 9, packed)
    yield from _settled_rows(_as_spans(done, length), buckets, number)


def _send_runs(buckets, length, k, hot):
    def run(batches):
        held, size, number = [], 0, 0
        windows, n_windows = [], 0

        def chunk():
            columns = [np.concatenate(x) for x in zip(*held)]
            return _batch(list(_code_runs(*columns, buckets, number, length, k)), _RUN)

        def window_chunk():
            return _batch(list(_window_rows(np.concatenate(windows), buckets, number, length)), _RUN)

        for batch in batches:
            ids, prints = _columns(batch)
            wanted = batch.column("places")
            for at, data, offsets in common.pieces(batch.column("text")):
                place, first, last, hashes, row = anchor_runs(data, offsets, length, k)
                asked = wanted.slice(at, len(offsets) - 1)
                counts = np.diff(np.asarray(asked.offsets))
                known = np.repeat(offsets[:-1], counts) + np.asarray(asked.flatten())
                keep = np.isin(place, known)
                if len(hot):
                    is_hot = keep & np.isin(_codes(hashes, buckets), hot)
                    keep &= ~is_hot
                    sums = [common.prefix_hashes(x) for x in (data, _OTHER[data])] if is_hot.any() else ()
                    # a step at a time, as an anchor stands for up to length - k + 1 windows
                    for lo in range(0, len(place), CHUNK_SUFFIXES // length + 1):
                        some = lo + np.flatnonzero(is_hot[lo : lo + CHUNK_SUFFIXES // length + 1])
                        if len(some):
                            windows.append(_windows(sums, first[some], last[some], row[some], ids[at:], prints[at:], offsets, length))
                            n_windows += len(windows[-1])
                        if n_windows >= CHUNK_SUFFIXES:
                            yield window_chunk()
                            windows, n_windows, number = [], 0, number + 1
                place, first, last, row = place[keep], first[keep], last[keep], row[keep]
                sizes, left_sizes = last + length - place, place - first
                held.append((
                    _matrix(_gather(data, place, sizes), sizes, length), sizes,
                    _matrix(_gather(data, first, left_sizes), left_sizes, length - k), left_sizes,
                    ids[at + row], prints[at + row], place - offsets[row],
                ))
                size += len(place)
                if size >= CHUNK_SUFFIXES:
                    yield chunk()
                    held, size, number = [], 0, number + 1
        if size:
            yield chunk()
        if n_windows:
            yield window_chunk()

    return run


# -- merge and classes of equal windows ---------------------------------------------------------------------------

_SPAN = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("print", T.LongType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
])


def _equal_windows(lcp, sizes, lefts, left_sizes, ids, length):
    """For entries in suffix order: smallest and largest distance left of the anchor at which a window is taken."""
    n = len(ids)
    turned = np.zeros_like(lefts)  # nearest byte first
    at = left_sizes[:, None] - 1 - np.arange(lefts.shape[1])
    np.copyto(turned, np.take_along_axis(lefts, np.maximum(at, 0), axis=1), where=at >= 0)
    by_left = np.argsort(_as_strings(turned), kind="stable")
    left_lcp = _lcp(turned[by_left], np.full(n, lefts.shape[1]))
    least, most = np.full(n, length), np.full(n, -1)
    for o in range(0, lefts.shape[1] + 1):
        valid = (o <= left_sizes) & (o >= length - sizes)
        if not valid.any():
            continue
        right_class = np.cumsum(lcp < length - o)
        left_class = np.empty(n, np.int64)
        left_class[by_left] = np.cumsum(left_lcp < o)
        mine = np.flatnonzero(valid)
        classes = right_class[mine] * np.int64(n + 1) + left_class[mine]
        order = np.argsort(classes, kind="stable")
        first = np.flatnonzero(np.diff(classes[order], prepend=-1))
        low = np.repeat(np.minimum.reduceat(ids[mine][order], first), np.diff(np.append(first, len(order))))
        taken = mine[order[low < ids[mine][order]]]
        least[taken] = np.minimum(least[taken], o)
        most[taken] = np.maximum(most[taken], o)
    return least, most


def _merge_windows(table, length):
    """Spans of the windows of a bucket that a smaller key has too."""
    parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), _WINDOW) for x in table.column("done").to_pylist()]
    out = _as_spans(_lowest(np.concatenate(parts))[1], length)
    return pa.table({c: np.ascontiguousarray(out[c]) for c in ("id", "print", "start", "end")})


def _merge_bucket(length, k, buckets):
    def run(table):
        if table.column("bucket")[0].as_py() >= buckets:
            return _merge_windows(table, length)
        columns = table.to_pydict()
        runs, parts, done = [], [[], [], [], [], [], []], []
        for shared, sizes, tails, left_sizes, lefts, docs, ids, prints, places, settled in zip(
            *[columns[f.name] for f in _RUN][1:]
        ):
            if settled:
                done.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(settled), _DONE))
            if not ids:
                continue
            shared, sizes, tails, left_sizes, lefts = [
                _unpacked(x, np.uint8) for x in (shared, sizes, tails, left_sizes, lefts)
            ]
            runs.append((shared.tobytes(), sizes.tobytes(), tails.tobytes()))
            parts[0].append(sizes.astype(np.int64))
            parts[1].append(left_sizes.astype(np.int64))
            parts[2].append(_matrix(lefts, parts[1][-1], length - k))
            docs = _unpacked(docs, np.uint32)
            parts[3].append(np.frombuffer(ids, np.int64)[docs])
            parts[4].append(np.frombuffer(prints, np.int64)[docs])
            parts[5].append(_unpacked(places, np.uint32))
        out = np.zeros(0, _DONE)
        if runs:
            sizes, left_sizes, lefts, ids, prints, places = [np.concatenate(x) for x in parts]
            order, lcp = merge_runs(runs)
            sizes, left_sizes, lefts, ids = sizes[order], left_sizes[order], lefts[order], ids[order]
            least, most = _equal_windows(lcp, sizes, lefts, left_sizes, ids, length)
            hit = np.flatnonzero(most >= 0)
            out = np.empty(len(hit), _DONE)
            place = places[order][hit].astype(np.int64)
            out["id"], out["print"] = ids[hit], prints[order][hit]
            out["start"], out["end"] = place - most[hit], place - least[hit] + length
        out = np.concatenate([out, *done])
        return pa.table({c: np.ascontiguousarray(out[c]) for c in ("id", "print", "start", "end")})

    return run


# -- result -------------------------------------------------------------------------------------------------------

_RESULT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])


def _union(spans):
    """Sorted maximal runs of the bytes in any span; spans that touch are one run."""
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _cut(batches):
    for batch in batches:
        columns = {f.name: [] for f in _RESULT}
        texts, spans = batch.column("text"), batch.column("spans")
        for i in range(batch.num_rows):
            text = texts[i].as_buffer().to_pybytes()
            runs = _union([(s["start"], s["end"]) for s in spans[i].as_py() or ()])
            kept, at = [], 0
            for start, end in runs:
                kept.append(text[at:start])
                at = end
            columns["n_bytes"].append(len(text))
            columns["n_removed"].append(sum(e - s for s, e in runs))
            columns["n_spans"].append(len(runs))
            columns["kept"].append(b"".join([*kept, text[at:]]))
            columns["spans"].append([{"start": s, "end": e} for s, e in runs])
        columns["id"] = batch.column("id")
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "spans": span}
        yield pa.RecordBatch.from_arrays(
            [columns[f.name] if f.name == "id" else pa.array(columns[f.name], types[f.name]) for f in _RESULT],
            names=_RESULT.names,
        )


def repeated_spans(docs, length=LENGTH, k=ANCHOR, bucket_bytes=BUCKET_BYTES):
    """Rows (id, print, start, end): byte spans to remove from ``docs`` (id, print, text); spans may overlap."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // bucket_bytes))
    sent = docs.mapInArrow(_send_anchors(buckets, length), _PAYLOAD)
    bound = max(HOT_ENTRIES, total // HOT_ANCHORS)
    found = write_and_read(sent.groupBy("bucket").applyInArrow(_keep_shared(bound), _FOUND), "repeat-anchors")
    hot = np.sort([r["hot"] for r in found.filter("hot is not null").select("hot").collect()])  # HOT_ANCHORS at most
    places = found.filter("hot is null").groupBy("id", "print").agg(F.collect_list("place").alias("places"))
    own = F.coalesce(F.col("id"), F.lit(int(NO_KEY)))
    keyed = docs.withColumn("id", own)
    anchored = keyed.join(places, ["id", "print"]).select("id", "print", "text", "places")
    runs = anchored.mapInArrow(_send_runs(buckets, length, k, hot), _RUN)
    return runs.groupBy("bucket").applyInArrow(_merge_bucket(length, k, buckets), _SPAN)


def remove_repeats(df, key="doc_id", text="text", length=LENGTH):
    """Rows (key, n_bytes, n_removed, n_spans, kept, spans) for every row of ``df``; ``kept`` are the bytes left.

    Texts are UTF-8 bytes, null ones empty; spans may cut characters. Strings are judged on the input, whatever is
    removed from it. Rows with the same key are not smaller than one another; a null key is later than all others and
    never the smaller one. Texts shorter than ``length`` stay whole. Columns beside the two named are not looked at. An
    empty table gives an empty result. The key must be an integer.
    """
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    docs = df.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(value).alias("print"), value.alias("text")
    )
    spans = repeated_spans(docs, length).groupBy("id", "print").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    keyed = docs.withColumn("id", F.coalesce(F.col("id"), F.lit(int(NO_KEY))))
    cut = keyed.join(spans, ["id", "print"], "left").select("id", "text", "spans").mapInArrow(_cut, _RESULT)
    own = F.when(F.col("id") != int(NO_KEY), F.col("id"))
    return cut.select(own.alias(key), *[f.name for f in _RESULT][1:])


def repeat_report(df, key="doc_id", **options):
    removed = remove_repeats(df, key, **options)
    return removed.select(key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
