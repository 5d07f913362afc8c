"""Connected components of a list of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that a task has, about.  There are as many tasks as cores at least, and at most as many as shuffle partitions.
LINKS = 100_000


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the lowest of u and all its v."""
    lowest = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
    return pairs.join(lowest, F.col("u") == F.col("w")).select("u", "v", "m")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # One row a link; rows that became equal are made one at the end of the round.
    return _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    kept = _lowest(down)
    return kept.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(kept.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (u, v: equal comparable types): the root is the component's lowest node.

    Each round writes the links to the checkpoint folder; rounds grow with the logarithm of the longest path.  A node without a
    link to another has no row.  Tasks follow the number of links, so few links do not make many small files in each shuffle.
    """
    links = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        new = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if new == mark or new[0] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-new[0] // LINKS))
        mark, links = new, cut(_small_star(_large_star(links.coalesce(tasks)).coalesce(tasks)).coalesce(tasks))
