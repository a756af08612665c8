"""Session settings and the shared working folder."""

import uuid

from pyspark.sql import SparkSession

#: Data whose measured size is at most this is broadcast; larger data is shuffled.
BROADCAST_BYTES = 64 << 20

#: A plain scan of at most this size is dealt out to all cores.
SPREAD_BYTES = 256 << 20

#: Bytes of small files that one task reads.
GATHER_BYTES = 32 << 20

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(app_name="textharbor", **settings):
    """A session with the settings the engine is tuned for; existing settings win."""
    builder = SparkSession.builder.appName(app_name)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    defaults.update(settings)
    for name, value in defaults.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """The shared folder the session names, or else the one given to ``setCheckpointDir``."""
    folder = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder all executors can reach")
    return folder.rstrip("/")


def run_dir(spark, label):
    """A fresh path below the shared folder; nothing else ever writes to it."""
    return f"{shared_dir(spark)}/textharbor/{label}-{uuid.uuid4().hex}"


def write_and_read(df, label):
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _plan_bytes(df):
    """The plan's own estimate of a file scan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def gathered(df):
    """A scan of very many small files in tasks of about ``GATHER_BYTES``, four a core at least; nothing is moved.

    Spark counts every file as megabytes (``spark.sql.files.openCostInBytes``), which makes a task of a few of them.
    """
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-_plan_bytes(df) // GATHER_BYTES))
    return df.coalesce(tasks)


def spread(df):
    """A small file scan (``SPREAD_BYTES`` by the plan's own estimate) dealt out to all cores.

    Meant for tables of one file in front of Python work. A larger scan comes back unchanged, so no more than that
    is ever moved; its splits are a matter of ``spark.sql.files.maxPartitionBytes``.
    """
    size = _plan_bytes(df)
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df
