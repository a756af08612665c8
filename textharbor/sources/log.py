"""A small append-only log of what has been written, kept as JSON rows in the shared folder.

Data folders count only once a log row names them, so a failed job leaves nothing visible.
One writer at a time.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


def append(spark, path, schema, **fields):
    row = [F.lit(fields.get(f.name)).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1, numPartitions=1).select(*row).write.mode("append").json(path)


def read(spark, path, schema):
    """The log as a DataFrame, or None where nothing has been logged."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
