"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node with a link to another one; the root is the smallest node of its component.

    Alternating large-star and small-star steps, each a minimum over neighbours and a join: the number of links never grows,
    long chains shorten by a factor in each round, and no component or node's neighbourhood is gathered in one place. Each round is
    written to the shared folder, so a lost executor costs no recomputation of earlier rounds. The minima are written too: a join
    with them then needs no aggregate's partitioning, so that Spark can split the partition of a node with very many neighbours. Null ends and loops are left out.
    """
    e = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        low = stored(e.groupBy("u").agg(F.min("v").alias("m")))
        near = e.join(low, "u")
        return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()

    def stars(e: DataFrame) -> bool:
        """Whether every node hangs on one root and no root on another node."""
        seen = e.select("u", F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
        per = seen.groupBy("u").agg(F.sum("as_u").alias("n"), F.max("as_v").alias("r"))
        return not per.filter((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("r") > 0))).limit(1).count()

    while not stars(e):
        e = stored(small(stored(large(e))))
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
