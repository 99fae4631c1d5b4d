"""Connected components of an edge table, by large-star and small-star steps.

Each round is two group-bys and joins on node ids, and is written to the shared
folder, so the plan stays short and a lost executor costs a reread. A node with
very many neighbours is reduced to its least neighbour by partial aggregation
before the shuffle. Rounds grow with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Edges a file of a round; a round has as many files as its edges ask for.
EDGES = 1 << 18


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node hangs on the node's least neighbour."""
    sides = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sides.join(least, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, hang on the least of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    out = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node.

    Edges to oneself and with null ends are ignored.
    """
    e = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before or not now[0]:
            break
        before = now
        e = materialize(_small(_large(e)).coalesce(now[0] // EDGES + 1), "cc-round")
    tops = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select(F.col("v").alias("node"), F.col("v").alias("component")))
