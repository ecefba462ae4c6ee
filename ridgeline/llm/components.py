"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.blocks import drop, kept


def _stars(edges: DataFrame) -> DataFrame:
    """One round: neighbours move to the least node near them. edges: a > b.

    The least neighbours are stored before they are joined: both sides of a join are plain shuffles
    then, so Spark can split the rows of a node that a third of all links lead to."""
    least = kept(edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")), "least")
    # larger neighbours of b move to the least of b and its neighbours
    large = kept(edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct(), "large")
    drop(least)
    least = kept(large.groupBy("a").agg(F.min("b").alias("m")), "least")
    # smaller neighbours of a, and a itself, move to the least of them
    small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = kept(small.filter("a <> b").distinct(), "links")
    drop(large)
    drop(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long) -> id, component (stored): the least id reachable, for every id that has a link.

    Every round is written to the shared folder. Rounds grow with the logarithm of the longest
    chain; a round moves each link a fixed number of times. Loops and repeated links are allowed."""
    edges = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0)).alias("h")).first()
        if now == seen or not now["n"]:
            out = kept(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "components")
            drop(edges)
            return out
        seen, last = now, edges
        edges = _stars(edges)
        drop(last)
