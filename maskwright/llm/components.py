"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so no component is ever in one task, and the smallest member is reached in a number
of rounds that grows with the logarithm of a component's size. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import staged

MOST_ROUNDS = 64
LINKS_PER_TASK = 200_000


def _star(links: DataFrame, large: bool, tag: str, parts: int) -> DataFrame:
    """Large star: neighbours above a node move to its smallest neighbour. Small star: those below do, and the node itself.

    ``links`` has each link once, as u > v. The minima are written first, so that the join meets two plain tables and can split
    the rows of a node with very many links.
    """
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), tag, parts)
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = staged(links.groupBy("u").agg(F.min("v").alias("m")), tag, parts)
        moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, u: str = "u", v: str = "v", tag: str = "components") -> DataFrame:
    """From links (two columns of one orderable type) to (node, component), for every node with a link to another node.

    Nulls and links of a node to itself are left out. ``component`` is the smallest node that can be reached.
    """
    links = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"), (F.col(u).isNull() | F.col(v).isNull()).alias("n"))
    links = staged(links.where("not n and u <> v").select("u", "v").distinct(), tag)
    state = _state(links)
    for _ in range(MOST_ROUNDS):  # until it is a forest of stars: every u has one v, and no v is a u
        parts = 8 + state[0] // LINKS_PER_TASK
        links = staged(_star(staged(_star(links, True, tag, parts), tag, parts), False, tag, parts), tag, parts)
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
