"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm._common import cut


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links (u, v) with u > v.

    Large: every node tells its larger neighbours its smallest neighbour. Small: every node tells its
    smaller neighbours the smallest of them.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u > v").distinct()


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of links (a, b); the component is its smallest node.

    Each round is written to the shared folder. Only two numbers, the links' count and the sum of their
    hashes, come to the driver, to see that a round changed nothing.
    """
    links = links.where("a is not null and b is not null and a <> b")
    links = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(links)
    for _ in range(rounds):
        if not mark[0]:
            break
        links = cut(_stars(_stars(links, large=True), large=False))
        now = _mark(links)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
