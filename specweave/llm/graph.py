"""Connected components of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.tables import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _round(links: DataFrame) -> DataFrame:
    """Hang every node's larger neighbours on its smallest one, then its smaller ones too."""
    near = _both_ways(links)
    low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    wide = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    down = wide.where("a <> b").distinct()  # every link now points to a smaller node
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    hung = down.join(low, "a")
    out = hung.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return out.union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of all nodes of the links ``a, b``.

    Null ends, repeated links and links of a node to itself are left out; no links give no rows.  Ends
    after a number of rounds that grows with the logarithm of the nodes.  Partial aggregates keep a node
    with very many links from meeting in one task; joins on it are split by adaptive execution.
    """
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct())
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.hash("a", "b"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        links = stored(_round(links))
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.union(roots)
