"""How scores of result sets are spread: histograms, and exact quantiles without a sort.

Scores are whole numbers at ``RANK_SCALE``, so a quantile is found by counting twice: first in coarse bins, which shows
the bin that holds the wanted place, then the scores of that bin alone. Counts are combined in the tasks, so a result set
of any size costs a row per bin, and no task sorts it.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textharbor.functions.scores import RANK_SCALE, rank_score
from textharbor.session import write_and_read

#: Bits of a whole-number score that a coarse bin leaves open: cosines have about 4,900 bins.
OPEN_BITS = 12


def score_histogram(scored, group="query_id", score="score", low=-1.0, high=1.0, bins=20):
    """Rows (group, bin, low, high, n) for the bins of equal width that hold a score; bins count from 0.

    Scores outside go to the first or last bin, the upper end to the last; NULL and NaN are left out.
    """
    usable = scored.filter(F.col(score).isNotNull() & ~F.isnan(score))
    width = (high - low) / bins
    place = F.floor((F.col(score) - low) / F.lit(width)).cast("int")
    counted = usable.withColumn("bin", F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)))
    counted = counted.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        group, "bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n"
    )


def _up_to(rows, keys, order):
    """``rows`` with the count up to and with each row as ``upto``."""
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum("n").over(inside))


def score_quantiles(scored, group="query_id", score="score", shares=(0.0, 0.25, 0.5, 0.75, 1.0)):
    """Rows (group, share, quantile): the smallest score that at least this share of the group's scores do not exceed.

    Exact at ``RANK_SCALE``; the share 0 gives the smallest score. NULL and NaN are left out. Two counting passes over
    ``scored``, which should be a written table if it is dear to compute.
    """
    usable = scored.filter(F.col(score).isNotNull() & ~F.isnan(score))
    ranks = usable.select(F.col(group).alias("g"), rank_score(F.col(score)).alias("r"))
    ranks = ranks.withColumn("bin", F.shiftright("r", OPEN_BITS))
    coarse = ranks.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"))
    coarse = _up_to(coarse, ["g"], "bin").withColumn("before", F.col("upto") - F.col("n"))
    total = F.max("upto").over(Window.partitionBy("g"))
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)])
    asked = coarse.withColumn("total", total).withColumn("s", F.explode(listed))
    # Ceil with room for rounding of the share; places count from 1.
    asked = asked.withColumn("place", F.greatest(F.ceil(F.col("s.share") * F.col("total") - 1e-9), F.lit(1)))
    asked = asked.filter((F.col("before") < F.col("place")) & (F.col("place") <= F.col("upto")))
    asked = write_and_read(asked.select("g", "bin", "s.share", (F.col("place") - F.col("before")).alias("place")), "quantile-bins")
    fine = _held(ranks, asked.select("g", "bin").distinct())
    fine = _up_to(fine.groupBy("g", "bin", "r").agg(F.count(F.lit(1)).alias("n")), ["g", "bin"], "r")
    a, f = asked.alias("a"), fine.alias("f")
    same = F.col("a.g").eqNullSafe(F.col("f.g")) & (F.col("a.bin") == F.col("f.bin"))
    held = (F.col("f.upto") - F.col("f.n") < F.col("a.place")) & (F.col("a.place") <= F.col("f.upto"))
    found = a.join(f, same & held)
    return found.select(F.col("a.g").alias(group), F.col("a.share").alias("share"), (F.col("f.r") / F.lit(RANK_SCALE)).alias("quantile"))


def _held(ranks, wanted):
    """Rows of the wanted bins."""
    r, w = ranks.alias("r"), wanted.alias("w")
    same = F.col("r.g").eqNullSafe(F.col("w.g")) & (F.col("r.bin") == F.col("w.bin"))
    return r.join(w, same, "left_semi")
