"""Connected components of a links table, by alternating stars; every step is an equi-join or a sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import storage


def _settled(links: DataFrame) -> bool:
    """Whether links (u, v) are stars: no u has two, and no v is a u."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of links (u, v): root is the smallest node of its component.

    Links become stars: each round hangs a node's larger neighbours on its smallest one (large star),
    then its smaller neighbours (small star), until all are stars, after a number of rounds that
    grows with the logarithm of the nodes. A hub's rows are dealt out by a join whose hot partitions
    Spark splits (sums are written first, so that joins see plain inputs); its smallest neighbour is a
    partial sum. Each round is cut in the shared folder, and the files of the one before go.
    """
    now = storage.cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        old = now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = storage.cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "least")
        large = both.join(least, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = storage.cut(large, "links")
        storage.drop(old, least)
        least = storage.cut(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), "least")
        hung = large.join(least, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = storage.cut(hung.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        storage.drop(large, least)
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"links didn't settle in {most_rounds} rounds")
