"""Text cleaning as Column expressions, in one fixed order (see ``clean``)."""

import html
from functools import reduce

import pyarrow as pa
from pyspark.sql import functions as F

from textharbor.functions.batches import slices
from textharbor.functions.entities import decode_entities_native

# Unicode white space as a Java character class, its complement,
# the same without the plain space, the tag pattern and the link pattern.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
WS_BUT_SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}&&[^ ]]"
TAG = r"<[^>]+>"
LINK = rf"https?://{NOT_WS}+|www\.{NOT_WS}+"


def _blank(text, pattern, *marks):
    """Matches of a pattern to one space; texts without any of the marks it needs skip the search."""
    possible = reduce(lambda a, b: a | b, [F.contains(text, F.lit(mark)) for mark in marks])
    return F.when(possible, F.regexp_replace(text, pattern, " ")).otherwise(text)


def strip_tags(text):
    return _blank(text, TAG, "<")


def unescaped(texts):
    """An Arrow array of texts with their HTML5 entities decoded."""
    done = [pa.array([None if t is None else html.unescape(t) for t in part.to_pylist()], pa.string()) for part in slices(texts)]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def decode_entities(text):
    """HTML5 entities to characters; only texts with an ampersand are sent to Python."""

    @F.arrow_udf("string")
    def unescape(texts: pa.Array) -> pa.Array:
        return unescaped(texts)

    return F.coalesce(unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def strip_html(text):
    """Tags to spaces, then entities decoded: an escaped tag survives as literal text."""
    return decode_entities(strip_tags(text))


def strip_html_native(text):
    """The same without Python: entities are decoded by column expressions."""
    return decode_entities_native(strip_tags(text))


def strip_urls(text):
    return _blank(text, LINK, "://", "www.")


def normalize_whitespace(text):
    """Every run of white space to one space, none at the ends.

    A lone space is left alone, and printable ASCII is passed over before the full class is tried.
    """
    return F.trim(F.regexp_replace(text, rf"(?![!-~])(?:{WS_BUT_SPACE}{WS}*| {WS}+)", " "))


def clean(text, remove_urls=True):
    """Lower case, tags out, entities decoded, links out (optional), white space normalised."""
    out = strip_html(F.lower(text))
    if remove_urls:
        out = strip_urls(out)
    return normalize_whitespace(out)
