"""Score arithmetic as Column expressions."""

from pyspark.sql import functions as F

#: Scores are compared at this resolution, close to that of a 32-bit float,
#: so that equal texts tie exactly whatever order their products were summed in.
RANK_SCALE = 1e7


def rank_score(score):
    """Score as a whole number at ``RANK_SCALE``; ties are broken by key."""
    return F.floor(score * RANK_SCALE + 0.5)


def rounded(score, digits=4):
    return F.round(score, digits)


def length_normalized(score, doc_length):
    """Slightly lower scores of long documents; documents of length 0 keep theirs."""
    factor = F.lit(1.0) / (F.lit(1.0) + F.log1p(doc_length / F.lit(1000.0)))
    return F.when(doc_length > 0, score * factor).otherwise(score)


def normalize_score(score, low=0.0, high=1.0):
    """Min-max to [0, 1], clamped; 0.5 where the range is empty."""
    if low == high:
        return F.when(score.isNotNull(), F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - low) / F.lit(float(high - low))))
