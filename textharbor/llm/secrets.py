"""Secret scans with linking of multipart credentials.

Strong findings stand for themselves: assignments of secrets, access identifiers with a known prefix, long hex runs. A
credential also has parts that mean little alone: names of accounts, opaque tokens, endpoints. Those are candidates
only, and an interval join within a scope (so many code points around a part) decides: a weak identifier is reported
where a secret lies in its scope, a weak secret where an identifier does, an endpoint where both do.
"""

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.llm import common

#: Kinds in the order in which spans with one start are listed; the first three are the strong ones.
KINDS = ("assign", "access", "hex", "identifier", "token", "endpoint")
STRONG = KINDS[:3]

#: Code points around a part in which its complement must lie.
SCOPE = 200

# The strong patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run of 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_VALUE = 8

# Parts that need a complement.
IDENTIFIER = re.compile(
    r"""(?ai:\b(?:access_?key_?id|client_?id|account|user_?name|login|user))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
)
TOKEN = re.compile(r"(?a:(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2})")
ENDPOINT = re.compile(r"(?a:\b(?:[a-z][a-z0-9+.-]{0,30}://[A-Za-z0-9.-]+(?::[0-9]+)?|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?))")

# Lower-case words without which a pattern cannot match: a quick look before the slow one.
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_IDENTIFIER_WORDS = ("key", "client", "account", "user", "login")


class Span(NamedTuple):
    start: int
    rank: int  # place of the kind in KINDS
    end: int

    @property
    def kind(self):
        return KINDS[self.rank]


def _spans(kind, matches):
    rank = KINDS.index(kind)
    return [Span(m.start(), rank, m.end()) for m in matches]


def strong_spans(text, lower):
    """Leftmost non-overlapping matches of each strong kind; too short ones are dropped after they are matched."""
    out = []
    if any(w in lower for w in _ASSIGN_WORDS):
        out += _spans("assign", (m for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE))
    if "AKIA" in text:
        out += _spans("access", ACCESS.finditer(text))
    out += _spans("hex", HEX.finditer(text))
    return sorted(out)


class Intervals:
    """Spans, asked whether one lies near another span or overlaps it; either takes a few bisections."""

    def __init__(self, spans):
        self.spans = spans
        self.starts, self.ends = sorted(s.start for s in spans), sorted(s.end for s in spans)
        self.merged = []  # start and end of the stretches that spans cover
        for s in sorted(spans):
            if self.merged and s.start <= self.merged[-1][1]:
                self.merged[-1][1] = max(self.merged[-1][1], s.end)
            else:
                self.merged.append([s.start, s.end])
        self.opens = [start for start, _ in self.merged]

    def near(self, span, scope):
        """Whether one lies within ``scope`` of the span and does not overlap it."""
        behind = bisect_left(self.starts, span.end) < bisect_right(self.starts, span.end + scope)
        return behind or bisect_left(self.ends, span.start - scope) < bisect_right(self.ends, span.start)

    def overlaps(self, span):
        at = bisect_left(self.opens, span.end) - 1
        return at >= 0 and self.merged[at][1] > span.start


def linked_spans(text, lower, strong, scope=SCOPE):
    """Weak parts whose complements lie in their scope; none overlaps a strong span."""
    if not strong and not any(w in lower for w in _IDENTIFIER_WORDS):
        return []  # neither an identifier nor anything that calls for one
    taken = Intervals(strong)

    def free(spans):
        return [s for s in spans if not taken.overlaps(s)]

    names = free(_spans("identifier", IDENTIFIER.finditer(text))) if any(w in lower for w in _IDENTIFIER_WORDS) else []
    identifiers = Intervals([s for s in strong if s.kind == "access"] + names)
    tokens = []
    if identifiers.spans:
        spans = free(_spans("token", TOKEN.finditer(text)))
        tokens = [s for s in spans if identifiers.near(s, scope)]
    secrets = Intervals([s for s in strong if s.kind in ("assign", "hex")] + tokens)
    found = [s for s in names if secrets.near(s, scope)] + tokens
    if identifiers.spans and secrets.spans:
        ends = free(_spans("endpoint", ENDPOINT.finditer(text)))
        found += [s for s in ends if identifiers.near(s, scope) and secrets.near(s, scope)]
    return found


def find_spans(text, scope=SCOPE):
    """All spans of a text, sorted, and the strong ones among them."""
    lower = text.lower()
    strong = strong_spans(text, lower)
    return sorted(strong + linked_spans(text, lower, strong, scope)), strong


SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
])


def scan_secrets(df, text="text", scope=SCOPE, keep=None):
    """Rows (row, strong, spans) for every row of ``df``: arrays of (kind, start, end), code points, end exclusive.

    ``strong`` are the findings that stand for themselves, ``spans`` these and linked parts, both by start and then in
    the order of :data:`KINDS`. Whole texts are scanned; null and empty texts have no spans; repeated rows are scanned
    each; columns of any name stay inside ``row``. An empty table gives an empty result. Patterns enter every run of
    characters once or look a bounded way ahead, and links are found by bisection, so time is in proportion to the text.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(array):
        strong, spans = [], []
        for value in common.as_text(array):
            every, sure = find_spans(value.as_py() or "", scope)
            for into, found in ((strong, sure), (spans, every)):
                into.append([{"kind": s.kind, "start": s.start, "end": s.end} for s in found])
        return [pa.array(strong, kind), pa.array(spans, kind)]

    fields = [T.StructField("strong", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN))]
    return common.annotate(df, text, run, fields, keep)


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(df, key="doc_id", **options):
    found = scan_secrets(df, keep=[key], **options)
    counts = [F.expr(f"bigint(size(filter(strong, s -> s.kind = '{kind}')))").alias(f"n_{kind}") for kind in STRONG]
    return found.select(
        F.col("row").getField(key).alias(key), *counts,
        F.sha2(_listed("strong").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
    )
