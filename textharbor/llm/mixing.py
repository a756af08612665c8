"""Mixing sources to target weights: hash-random order, prefix sums of words within a source, exact cuts.

Every row gets a hash of its key as random key. Rows are sorted into ranges by source and random key, words before
each row of its source are summed over the ranges, and a source is taken in that order up to its budget. A budget
above the source's size takes the whole source again, epoch by epoch. The last row taken is taken in part, so every
budget is met to the word.
"""

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.llm.common import attach, nulls_first, prefix_sums, sorted_ranges
from textharbor.session import write_and_read

#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets of sources from rows (source, source_size, share): ``weights`` repeat along the sorted sources.

    All sizes together are shared out by weight. A source stops at ``most`` times its size and the others share the
    excess by weight, until none is above. Sources that stop are those with the lowest size to weight ratio, so one
    pass in the order of that ratio finds them: source j stops if the others, sharing what is left, would exceed it.
    The pass goes over one row a source in one task, so the number of sources is its bound, not that of documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight.cast("long"))
    by_ratio = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    lower = Window.orderBy(*by_ratio).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = (
        ranked.withColumn("total", F.sum("source_size").over(everywhere))
        .withColumn("all_weights", F.sum("weight").over(everywhere))
        .withColumn("rest", F.col("total") - most * F.coalesce(F.sum("source_size").over(lower), F.lit(0)))
        .withColumn("rest_weights", F.col("all_weights") - F.coalesce(F.sum("weight").over(lower), F.lit(0)))
    )
    stops = F.col("rest") * F.col("weight") > most * F.col("source_size") * F.col("rest_weights")
    marked = left.withColumn("stops", stops)
    free = F.when(~F.col("stops"), F.struct("rest", "rest_weights"))
    first_free = marked.withColumn("free", F.max_by(free, F.when(~F.col("stops"), F.col("rest_weights"))).over(everywhere))
    shared = (F.col("free.rest") * F.col("weight")).cast("double") / F.col("free.rest_weights")
    target = F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(shared)
    return first_free.select("source", "source_size", target.alias("target"))


def mix(df, key="doc_id", text="text", source="source", weights=(5, 2, 1), most=3, seed=0):
    """Rows (key, source, size, source_size, target, taken, tiebreak): ``taken`` words of the row in the mix.

    ``size`` counts words, none for a null text. ``taken`` counts repeats: whole epochs times the size, plus the part
    of the row that lies before the cut of the last epoch. Targets are cut to whole words. Null keys and sources are
    values like others (the null source comes last). Rows with one key are told apart by a hash of their text
    (``tiebreak``, also in the result); rows equal in key, source and text are interchangeable. Sources without words
    get target 0. An empty table gives an empty result. Other columns are not looked at.
    """
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    sized = df.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.regexp_count(value, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{key}`").cast("string"))).alias("random"),
        F.md5(value.cast("binary")).alias("tiebreak"),
    )
    order = nulls_first("random", "tiebreak")
    ranged = sorted_ranges(sized, [F.col("source").asc_nulls_last(), *order], "mix")
    sizes = ranged.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    summed = prefix_sums(ranged, order, ["size"], group=["source"])
    rows = summed.alias("l").join(
        targets.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))
    ).select("l.*", "t.source_size", "t.target")
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    part = F.least(F.greatest(budget - epochs * F.col("source_size") - F.col("before_size"), F.lit(0)), F.col("size"))
    return rows.select(
        F.col("key").alias(key), "source", "size", "source_size", "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"), "tiebreak",
    )


def cut_words(text, words):
    """The text up to the end of its ``words``-th word."""
    ends = re.finditer(r"[^\x20\x09-\x0D]+", text)
    last = next(islice(ends, words - 1, None), None) if words > 0 else None
    return text[: last.end()] if last else ("" if words <= 0 else text)


def _cut_texts(batches):
    for batch in batches:
        pairs = zip(batch.column("cut_text").to_pylist(), batch.column("cut_to").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([cut_words(t, n) for t, n in pairs])], names=["row", "cut"])


def mixed_documents(df, key="doc_id", text="text", source="source", **options):
    """The rows of ``df`` as the mix takes them: repeated for whole epochs, one row a source cut to its first words.

    Rows that the mix does not reach, and rows without words, are left out. All columns stay; rows are not in order.
    """
    plan = mix(df, key, text, source, **options).filter("taken > 0")
    plan = write_and_read(
        plan.select(F.col(key).alias("id"), "source", "tiebreak", "size", "taken"), "mix-plan"
    )
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keys = {"id": F.col(f"`{key}`"), "source": F.col(f"`{source}`").cast("string"), "tiebreak": F.md5(value.cast("binary"))}
    joined = attach(df, plan, keys, ["size", "taken"])
    whole = joined.select("row", F.explode(F.expr("array_repeat(1, int(taken div size))"))).select("row.*")
    rest = joined.filter("taken % size > 0").select(
        "row", F.col("row").getField(text).alias("cut_text"), F.expr("taken % size").alias("cut_to")
    )
    schema = T.StructType([rest.schema["row"], T.StructField("cut", T.StringType())])
    cut = rest.mapInArrow(_cut_texts, schema)
    return whole.unionByName(
        cut.select(*[F.col("cut").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns])
    )
