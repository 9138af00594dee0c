"""Connected components of an edge table by randomised contraction, without collecting anything.

In every round each node takes as representative the node of smallest random rank among itself and its neighbours
(ranks are hashes that change with the round), edges are rewritten to representatives, and loops and repeats vanish.
The number of nodes shrinks by a constant share a round on average, whatever the graph's shape, so that long chains and
large stars take a logarithmic number of rounds. Hubs only meet in joins, which adaptive execution can split, and in
aggregations with a partial step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def contract(edges: DataFrame) -> DataFrame | None:
    """node, root of every node that occurs in edges (a, b: long); None without edges. Roots are arbitrary members."""
    both = materialize(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    maps: list[DataFrame] = []
    while not both.isEmpty():
        rank = lambda c, k=len(maps): F.xxhash64(c, F.lit(k))
        near = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(rank(F.col("a")).alias("h"), F.col("a").alias("n"))
        rep = materialize(near.select(F.col("a").alias("node"), F.least(F.col("m"), own)["n"].alias("rep")))
        maps.append(rep)
        left = rep.select(F.col("node").alias("a"), F.col("rep").alias("ra"))
        right = rep.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
        both = materialize(both.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if not maps:
        return None
    out = maps[0].select("node", F.col("rep").alias("root"))
    for later in maps[1:]:
        nxt = later.select(F.col("node").alias("root"), F.col("rep").alias("_next"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return out
