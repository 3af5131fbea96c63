"""Connected components of a graph given by its links, by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import store


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. links: (a, b) of type long.

    Each round points every node's larger neighbours at its smallest one, then every node at the smallest of those below
    it; the links become stars after a number of rounds that grows with the logarithm of the longest path. All steps are
    aggregates and joins on nodes: a node with very many links is pre-aggregated in the tasks and split by the skew join.
    """
    links = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = store(links, "links")
    state = _mark(links)
    while True:
        links = store(_small_star(_large_star(links)), "links")
        before, state = state, _mark(links)
        if state == before:
            break
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _mark(links):
    """Changes whenever the set of links does."""
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def _large_star(links):
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.where(F.col("b") > F.col("a")).join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links):
    lowest = links.groupBy("a").agg(F.min("b").alias("low"))
    onward = links.join(lowest, "a").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return onward.unionByName(lowest.withColumnRenamed("low", "b")).distinct()
