"""Connected components of a link table, without a graph ever leaving the cluster."""

from pyspark.sql import functions as F

from textharbor.llm.common import moved_apart
from textharbor.session import write_and_read


def connected_components(links, label="components"):
    """Rows (node, component) for every node of the undirected ``links`` (a, b); ``component`` is the smallest node.

    Large-star and small-star steps by turns (Kiveris et al., 2014): every node points its neighbours to the smallest
    it knows, until nothing changes. Each step is a grouped minimum and a join, and its result is written to the
    shared folder, so a lost executor costs one step. Joins are such that Spark can split a node with very many links.
    Links of a node to itself and null ends are ignored.
    """
    links = links.filter("a is not null and b is not null and a <> b").select("a", "b")
    edges = write_and_read(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    state = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = moved_apart(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "a")
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.distinct()
        low = moved_apart(large.groupBy("a").agg(F.min("b").alias("low")), "a")
        down = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        small = down.unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        edges = write_and_read(small, label)
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
