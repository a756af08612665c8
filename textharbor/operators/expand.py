"""Synonym expansion of a query table from a lexicon table."""

from pyspark.sql import functions as F

from textharbor.functions.text import words
from textharbor.operators.lookup import salted_lookup

# Fixed value: shortest word that is expanded.
MIN_EXPANDED = 4


def _synonyms(lexicon, max_senses, max_lemmas):
    """word -> its candidate synonyms in lexicon order; lemmas of one rank go by name and none is lost."""
    name = F.lower(F.replace("lemma", F.lit("_"), F.lit(" ")))
    for rank, most in (("synset_rank", max_senses), ("lemma_rank", max_lemmas)):
        lexicon = lexicon if most is None else lexicon.filter(F.col(rank) <= most)
    chosen = lexicon.select("word", "synset_rank", "lemma_rank", name.alias("name")).distinct()
    entries = F.sort_array(F.collect_list(F.struct("synset_rank", "lemma_rank", "name")))
    return chosen.groupBy("word").agg(
        F.array_distinct(F.transform(entries, lambda e: e["name"])).alias("synonyms")
    )


def _lexicon_bytes(lexicon):
    size = F.octet_length("word") + F.octet_length("lemma") + F.lit(32)
    return lexicon.agg(F.sum(size)).first()[0] or 0


def expand_queries(
    queries,
    lexicon=None,
    max_synonyms=2,
    query_id="query_id",
    text="query",
    out="expanded",
    max_senses=None,
    max_lemmas=None,
):
    """Append up to ``max_synonyms`` new synonyms per query word to the query.

    Words keep their order and come first; synonyms follow in word order, each only if the
    query does not hold it yet, counting synonyms added before it. Words under four
    characters are not expanded. Ranks in the lexicon start at 1; ``max_senses`` and
    ``max_lemmas`` bound the senses of a word and the lemmas of a sense that are looked at, by
    default all are. Without a lexicon the text stays as it is, case included; with one it is
    lower-cased.
    """
    if lexicon is None:
        return queries.withColumn(out, F.col(text))
    tokens = queries.select(query_id, words(F.col(text)).alias("words"))
    wanted = F.array_distinct(F.filter("words", lambda w: F.length(w) >= MIN_EXPANDED))
    lookups = tokens.select(query_id, F.explode(wanted).alias("word"))
    found = salted_lookup(
        lookups, _synonyms(lexicon, max_senses, max_lemmas), ["word"], query_id, _lexicon_bytes(lexicon), how="inner"
    )
    # One entry per distinct word of one query: bounded by the query's own text.
    known = found.groupBy(query_id).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "synonyms"))).alias("known")
    )

    def step(acc, word):
        candidates = F.coalesce(F.try_element_at("known", word), F.array().cast("array<string>"))
        fresh = F.filter(candidates, lambda n: (n != word) & ~F.array_contains(acc, n))
        return F.concat(acc, F.slice(fresh, 1, max_synonyms))

    tokens = words(F.col(text))
    grown = F.when(F.col("known").isNull(), tokens).otherwise(F.aggregate(tokens, tokens, step))
    return (
        queries.join(known, query_id, "left")
        .withColumn(out, F.array_join(grown, " "))
        .drop("known")
    )
