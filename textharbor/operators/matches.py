"""Set-similarity join on keywords: all pairs whose overlap (shared over all distinct words) reaches a threshold.

Words are put in one global order, the rarest first. Two sets that overlap by t or more have a word in common among the
first n - ceil(t * n) + 1 words of each, n being the set's size; only pairs that share such a word, and whose sizes do
not rule the overlap out, are compared in full. Words that only one side has come first in the order, so a set in which
they fill the prefix is out without a comparison. All of it is joins on words; sets are joined to candidates at the end.
"""

from pyspark.sql import functions as F

from textharbor.functions.text import overlap_ratio
from textharbor.session import BROADCAST_BYTES, write_and_read


def _sized(rows, key, words):
    sets = rows.select(F.col(key).alias("id"), F.array_distinct(F.col(words)).alias("words")).filter(F.size("words") > 0)
    return sets.withColumn("n", F.size("words"))


def _prefixes(sets, frequency, threshold):
    """Rows (id, word, n): the words of each set that a partner has to share one of."""
    each = sets.select("id", "n", F.explode("words").alias("word"))
    known = each.join(frequency, "word")
    # Ceil with room for rounding: a prefix too long by one loses nothing.
    length = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    listed = known.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("times", "word"))).alias("common"))
    room = F.greatest(length - (F.col("n") - F.size("common")), F.lit(0))
    return listed.select("id", "n", F.explode(F.slice("common", 1, room)).alias("c")).select("id", "n", "c.word")


def keyword_matches(left, right, threshold, left_id="doc_id", right_id="query_id", words="keywords"):
    """Pairs (left_id, right_id, shared, overlap) with an overlap of at least ``threshold`` (above 0, at most 1).

    Both tables have unique keys and a column ``words`` of strings, whose repeats count once. Empty and NULL sets match
    nothing. The right side is meant to be the smaller one; it is broadcast where it is measured small.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    # Each side is read several times below; its words are found once.
    a, b = (write_and_read(_sized(rows, key, words), "match-sets") for rows, key in ((left, left_id), (right, right_id)))
    wanted = b.select(F.explode("words").alias("word")).distinct()
    n_bytes = wanted.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    small = n_bytes <= BROADCAST_BYTES
    words_of_b = F.broadcast(wanted) if small else wanted
    # Only words of both sides can be shared; how often they are on the left decides their order.
    frequency = a.select(F.explode("words").alias("word")).join(words_of_b, "word", "left_semi")
    frequency = write_and_read(frequency.groupBy("word").agg(F.count(F.lit(1)).alias("times")), "match-words")
    shared_words = F.broadcast(frequency) if small else frequency
    first, second = _prefixes(a, shared_words, threshold), _prefixes(b, shared_words, threshold)
    first, second = first.alias("a"), second.alias("b")
    fitting = (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9)
    pairs = first.join(second, (F.col("a.word") == F.col("b.word")) & fitting)
    pairs = pairs.select(F.col("a.id").alias("left"), F.col("b.id").alias("right")).distinct()
    full = pairs.join(a.select(F.col("id").alias("left"), F.col("words").alias("x")), "left")
    full = full.join(b.select(F.col("id").alias("right"), F.col("words").alias("y")), "right")
    shared = F.size(F.array_intersect("x", "y"))
    return full.select(
        F.col("left").alias(left_id), F.col("right").alias(right_id), shared.alias("shared"),
        overlap_ratio(F.col("x"), F.col("y")).alias("overlap"),
    ).filter(F.col("overlap") >= threshold)
