import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("textharbor-tests")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.default.parallelism", "3")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def science(spark):
    """Three short documents with string keys."""
    from textharbor import as_documents

    rows = [
        ("physics", "Quantum mechanics describes particles. Energy comes in quanta."),
        ("biology", "Cells are the unit of life. Genes carry information."),
        ("chemistry", "Molecules are made of atoms. Reactions change bonds."),
    ]
    return as_documents(spark.createDataFrame(rows, "id string, text string"), "id", "text")
