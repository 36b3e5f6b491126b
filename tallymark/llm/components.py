"""Connected components by alternating large-star and small-star steps.

Links and labels stay distributed; only two numbers (a count and a checksum)
reach the driver in each round. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b (long node ids, any order, repeats and loops allowed; nulls go).

    Returns node, root for every node of a link between different nodes; root is
    the smallest node id that it can reach. No links: no rows.
    """
    e = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = settle(e, "links"), None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # large star: every neighbour above u goes under the least of u and its neighbours
        big = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its lower neighbours go under the least of them
        down = big.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = big.join(down, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        last, e = e, settle(small, "links")
        forget(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
