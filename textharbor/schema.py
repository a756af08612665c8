"""Column types of the tables the engine reads and writes."""

from pyspark.sql import types as T

DOCUMENT_COLUMNS = (
    "doc_id",
    "content",
    "original_content",
    "filename",
    "doc_length",
    "content_hash",
    "metadata",
)

#: What search shows of a document, next to its key.
SHOWN_COLUMNS = ("filename", "doc_length", "content_hash", "preview", "keywords")

LEXICON = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("synset_rank", T.IntegerType()),
        T.StructField("lemma_rank", T.IntegerType()),
        T.StructField("lemma", T.StringType()),
    ]
)


def document_schema(key_type=None):
    return T.StructType(
        [
            T.StructField("doc_id", key_type or T.StringType()),
            T.StructField("content", T.StringType()),
            T.StructField("original_content", T.StringType()),
            T.StructField("filename", T.StringType()),
            T.StructField("doc_length", T.IntegerType()),
            T.StructField("content_hash", T.StringType()),
            T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        ]
    )


def store_schema(key_type=None):
    """One logged row of the embedding store; ``seq`` says which write it came from."""
    return T.StructType(
        [
            T.StructField("doc_id", key_type or T.StringType()),
            T.StructField("model_id", T.StringType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("content_hash", T.StringType()),
            T.StructField("updated_at", T.TimestampType()),
            T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
            T.StructField("deleted", T.BooleanType()),
            T.StructField("seq", T.LongType()),
        ]
    )
