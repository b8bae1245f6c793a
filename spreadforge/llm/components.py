"""Connected components of a link table, by alternating large-star and
small-star steps.

Each step is a grouped minimum (merged map-side) and a join on the node, so a
node with very many links is a skewed join key and never a collected list.  The
link table is written to the shared checkpoint folder after every round; only
its size and checksum reach the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadforge.llm.tables import materialize, shuffled


def _star(both: DataFrame, keep) -> DataFrame:
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(shuffled(low), "u").where(keep)


def components(links: DataFrame, u: str, v: str, max_rounds: int = 100) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node that has a
    link.  ``u`` and ``v`` are orderable columns without nulls."""
    e = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _star(large, F.lit(True))
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        e = materialize(small)
        got = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if got == mark:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = got
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
