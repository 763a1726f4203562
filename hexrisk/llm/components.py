"""Connected components of an edge table, by alternating stars, without collecting edges or components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hexrisk.llm.files import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``row`` and ``component`` (its smallest row) for every row that an edge names.

    Each round ties every row's larger neighbours to its smallest one, then its smaller neighbours too (large star and
    small star); rounds grow with the logarithm of the longest chain. Minima are pre-aggregated, so a row with very many
    neighbours is no hot key there, and the join back is one that Spark splits when it is skewed.
    """
    links = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    state = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.filter("u <> v"), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = stored(small.filter("u <> v").distinct(), "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return links.groupBy(F.col("u").alias("row")).agg(F.min("v").alias("component")).unionByName(
        links.select(F.col("v").alias("row"), F.col("v").alias("component")).distinct()
    )
