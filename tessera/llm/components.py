"""Connected components of an edge table by alternating star contraction.

Each round points every node's larger neighbours at its smallest one and then
the other way round, as two group-bys with partial aggregation; no node's
neighbour list is ever gathered. The number of rounds is logarithmic in the
component size. Rounds are written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root = smallest node
    reachable. Loops are ignored; direction does not matter."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .distinct(), "components")
    while True:
        # Large star: every larger neighbour of u is linked to u's least neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v").distinct())
        large = materialize(large, "components")
        # Small star: u and its smaller neighbours are linked to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
                                             .alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        new = materialize(small, "components")
        if _same(now, new):
            return (new.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
        now = new


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Equal edge sets, told by count and an order-free checksum."""
    def mark(df):
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)))
                     .first())
    return mark(a) == mark(b)
