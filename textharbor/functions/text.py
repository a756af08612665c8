"""Fingerprints, keywords, previews and display strings as Column expressions."""

from pyspark.sql import functions as F

from textharbor.functions.cleaning import WS

# Shortest keyword and how much of a text is shown.
MIN_KEYWORD = 3
PREVIEW_LENGTH = 200
LISTING_LENGTH = 100
LABEL_LENGTH = 25
ELLIPSIS = "..."


def content_hash(content):
    return F.sha2(content, 256)


def words(text):
    """Lower-cased words between runs of Unicode white space."""
    parts = F.split(F.lower(text), WS + "+")
    return F.filter(parts, lambda w: w != "")


def keywords(text, min_length=MIN_KEYWORD):
    """Distinct words of at least ``min_length`` letters and nothing but letters."""
    return F.array_distinct(
        F.filter(words(text), lambda w: (F.length(w) >= min_length) & F.rlike(w, F.lit(r"^\p{L}+\z")))
    )


def document_keywords(content, opening=None):
    """Keywords of a document, or of its first ``opening`` characters, whose last word may be cut."""
    return keywords(content if opening is None else F.substring(content, 1, opening))


def shared_keywords(left, right, limit=None):
    shared = F.sort_array(F.array_intersect(left, right))
    return shared if limit is None else F.slice(shared, 1, limit)


def overlap_ratio(left, right):
    """Shared over all distinct words; 0 where either side is empty."""
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    shared = F.size(F.array_intersect(left, right)).cast("double")
    return F.when(empty, F.lit(0.0)).otherwise(shared / F.size(F.array_union(left, right)))


def preview(content, max_length=PREVIEW_LENGTH, suffix=ELLIPSIS):
    """At most ``max_length`` characters, cut at the last space that fits."""
    head = F.substring(content, 1, max_length - len(suffix))
    cut = F.concat(F.regexp_replace(head, r" [^ ]*\z", ""), F.lit(suffix))
    return F.when(F.length(content) <= max_length, content).otherwise(cut)


def listing_preview(content, max_length=LISTING_LENGTH):
    """A hard cut with a suffix, used by document listings."""
    head = F.concat(F.substring(content, 1, max_length), F.lit(ELLIPSIS))
    return F.when(F.length(content) > max_length, head).otherwise(content)


def chart_label(key, max_length=LABEL_LENGTH):
    return F.substring(key.cast("string"), 1, max_length)


def percent(value, digits=1):
    """Share as text, such as ``12.3%``; ties of the stored binary number go to the even digit."""
    return F.concat(fixed_digits(value * 100, digits), F.lit("%"))


def fixed_digits(value, digits=4):
    """A number with so many decimals and no grouping of thousands."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))
