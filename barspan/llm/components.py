"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) -> (u, label): the smallest id that every linked id can reach.

    Each round keeps at most as many edges as before; minima are pre-aggregated before the
    shuffle and hot centres meet their neighbours in joins that Spark can split.  The rounds end
    when the edges are stars round the smallest ids, which a checksum shows.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    check = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # large-star leaves edges (u, v) with v < u; small-star links each u's smaller neighbours to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        now = cut(small.filter("u <> v").distinct(), "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == check:
            return now.groupBy("u").agg(F.min("v").alias("label"))
        check = (seen["n"], seen["h"])
    raise RuntimeError("components did not settle")
