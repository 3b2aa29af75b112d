"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from harvestlens.llm.shared import by_shuffle, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link table of longs, each once; root is the smallest node reachable.

    Links may repeat, go either way or join a node to itself. Each round is one grouping and one join for each of the two stars,
    kept as a table in the shared folder; nothing but a row count and a checksum reaches the driver.
    A link with a null end is no link; an empty link table gives no rows.
    """
    given = stored(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), "links")
    edges, before = given.filter("hi <> lo"), None
    while True:
        edges = stored(_small_star(_large_star(edges)), "links")
        seen = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if seen == before:
            break
        before = seen
    rooted = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    alone = given.select(F.explode(F.array("hi", "lo")).alias("node")).select("node", F.col("node").alias("root"))
    return rooted.unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.select("hi", "lo").union(edges.select("lo", "hi")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(by_shuffle(least), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and all its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(by_shuffle(least), "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).filter("hi <> lo").distinct()
