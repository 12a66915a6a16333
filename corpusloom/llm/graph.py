"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every node of ``edges`` (a, b) but the roots, the smallest node of each component.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), which need a logarithmic number of rounds
    and never hold a component in one place; minima are taken by joins, so a node may have any number of neighbours.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        seen = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == (seen.n, seen.x) or not seen.n:
            return e.select("u", F.col("v").alias("root"))
        mark = seen.n, seen.x
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
