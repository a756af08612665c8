"""The corpus pipeline: from raw documents to balanced shards of a clean, mixed corpus.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; the runner
writes it as Parquet and reads it again for the next stage. All but the last return the columns of ``documents``.

Columns beside doc_id, text and source (and n_chars, which mixing sets) may have any name and are handed on. A null or
empty text is not toxic, has no near duplicates and no contamination; mixing counts no words in it and leaves it out.
Rows with equal texts are near duplicates of each other; rows that share a doc_id are one document to that stage, and
rows with a null doc_id all stay there. An empty table passes every stage.
"""

from pyspark.sql import functions as F

from textharbor.llm import decontamination, mixing, near_dedup, sharding, toxicity
from textharbor.session import write_and_read

TOXIC = 0.7
SHARDS = 40


def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score stays below the threshold; labels of the held-out third are never learnt from."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC).select("row.*")


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, size=5, percent=80)


def drop_contaminated(spark, docs, sf_dir):
    """Documents without any window of ten words of a benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def mix_sources(spark, docs, sf_dir):
    """Documents as the mix takes them, epochs repeated and cuts made; ``n_chars`` follows the text."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def shard(spark, docs, sf_dir):
    """Documents with their size in bytes, shard and slot; a name that the documents have gets underscores behind it."""
    placed = sharding.sharded_documents(docs, shards=SHARDS)
    return placed.select("row.*", *[F.col(c).alias(_free(c, docs.columns)) for c in ("size", "shard", "slot")])


def _free(name, taken):
    while name.lower() in map(str.lower, taken):
        name += "_"
    return name


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the first stage, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
