"""Connected components of a link table by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for each node of links(u, v): root is the smallest node that it reaches.

    Nodes are longs. Repeated links, loops and either direction are allowed; a null end drops the link. An
    empty table gives no rows. Each round pre-aggregates a minimum per node and joins it back, so a node with very
    many links is a skewed join that adaptive execution splits; the links of a round are written
    to the shared folder, so lineage stays short and a lost executor costs one round at most.
    """
    u, v = F.col("u"), F.col("v")
    edges = materialize(links.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    if not before[0]:
        return edges.select(u.alias("node"), v.alias("root"))
    for _ in range(max_rounds):
        both = edges.union(edges.select(v, u)).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(v.alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialize(small.where(u != v).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(edges.select(v, v).distinct())
