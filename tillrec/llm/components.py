"""Connected components of an undirected graph as DataFrame jobs (alternating star contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillrec.llm import common


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least neighbour ``m`` of u; the minimum combines before its shuffle, and AQE
    splits the join of a node with very many neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_least(both).filter("v > u")
    return linked.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    return linked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")) \
        .select("e.u", "e.v").filter("u <> v").distinct()


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge other than its component's least node, which is the root.

    ``edges`` has long columns ``u`` and ``v``; direction, repeats and loops don't matter. Each round
    is stored in the shared folder, so lineage stays short.
    """
    now = common.stored(edges.select("u", "v").filter("u <> v").distinct(), "components")
    mark = _fingerprint(now)
    while mark[0]:
        after = common.stored(_small_star(_large_star(now)), "components")
        new = _fingerprint(after)
        now = after
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
