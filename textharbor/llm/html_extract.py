"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into blocks, runs of text between tags that break lines. Ancestor tags, words of their classes and ids and
the shape of the text are a block's features. The field, trained on labelled pages, gives the likeliest sequence of
labels (main text or furniture) of all blocks of a page, found by Viterbi. Whole pages are read.
"""

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.llm import common, crf
from textharbor.llm.dom_blocks import Contexts, blocks_of
from textharbor.llm.labelled_pages import labelled_page

#: Labelled pages to learn from, and the bytes up to which a page is used for learning: one task holds them.
TRAIN_PAGES = 1500
TRAIN_BYTES = 64 << 10
#: Features in fewer labelled pages are left out.
LEAST_PAGES = 3


class Model(NamedTuple):
    weights: dict  # of label 1 over label 0, by feature
    moves: list
    starts: list


def fit(pages):
    """A model from labelled pages; those without any labelled block teach nothing."""
    contexts, chains, labels = Contexts(), [], []
    for page in pages:
        blocks = blocks_of(page, contexts)
        if any(b.label is not None for b in blocks):
            chains.append([b.features for b in blocks])
            labels.append([int(bool(b.label)) for b in blocks])
    seen = Counter(f for chain in chains for f in {f for spot in chain for f in spot})
    names = sorted(f for f, n in seen.items() if n >= LEAST_PAGES)
    if not names:
        raise ValueError("no labelled pages to learn from")
    number = {f: i for i, f in enumerate(names)}
    numbered = [[[number[f] for f in spot if f in number] for spot in chain] for chain in chains]
    weights, moves, starts = crf.fit(numbered, labels, len(names))
    return Model(dict(zip(names, weights.tolist())), moves.tolist(), starts.tolist())


def made_pages(spark, n=TRAIN_PAGES, seed=0):
    """A table of ``n`` labelled pages (page_id, html) made by rule."""
    make = F.udf(lambda i: labelled_page(i), T.StringType())
    return spark.range(seed, seed + n).select(F.col("id").alias("page_id"), make("id").alias("html"))


def learn(labelled, html="html"):
    """A model learnt from labelled pages (``data-main`` marks them) in one task, which gives back the weights only.

    At most ``TRAIN_PAGES`` pages of at most ``TRAIN_BYTES`` are used, picked by hash; pages without a mark, nulls and
    empty pages teach nothing. No page to learn from is an error.
    """
    value = F.col(f"`{html}`").cast("string")
    sample = labelled.select(value.alias("html")).filter(F.octet_length("html").between(1, TRAIN_BYTES))
    sample = sample.orderBy(F.xxhash64("html"), "html").limit(TRAIN_PAGES).repartition(1)
    schema = T.StructType([
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("moves", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("starts", T.ArrayType(T.DoubleType())),
    ])

    def run(batches):
        pages = sorted(p for batch in batches for p in batch.column(0).to_pylist())
        if pages:
            model = fit(pages)
            row = [list(model.weights), list(model.weights.values()), model.moves, model.starts]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=schema.names)

    row = sample.mapInArrow(run, schema).first()
    if row is None:
        raise ValueError("no labelled pages to learn from")
    return Model(dict(zip(row["names"], row["weights"])), row["moves"], row["starts"])


def main_blocks(page, model, contexts):
    """Texts of the blocks of a page that are main text."""
    blocks, weight = blocks_of(page, contexts), model.weights.get
    scores = [sum(weight(f, 0.0) for f in b.features) for b in blocks]
    return [b.text for b, label in zip(blocks, crf.viterbi(scores, model.moves, model.starts)) if label]


def extract(df, model, html="html", keep=None):
    """Rows (row, text, n_chars) for every row of ``df``: the main text, its blocks joined by empty lines.

    Character references are decoded, then white space inside a block is one space and none at its ends. Null and empty
    pages, and pages without main text, give an empty text. Pages of any length are read whole, repeated rows each for
    itself; columns of any name stay inside ``row``.
    """
    held = []

    def run(array):
        if not held:
            held.append(Contexts())
        texts = ["\n\n".join(main_blocks(page or "", model, held[0])) for page in common.as_text(array).to_pylist()]
        return [pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))]

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return common.annotate(df, html, run, fields, keep)


def extraction_report(pages, labelled=None):
    """Rows (page_id, url, text, n_chars) of all pages; learnt from pages made by rule where none are given."""
    model = learn(made_pages(pages.sparkSession) if labelled is None else labelled)
    found = extract(pages, model, keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", "n_chars")
