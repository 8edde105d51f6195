"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two joins with pre-aggregated minima. Those of the first, in
which a hub has many links, are written, so that Spark shuffles both sides and
can split the partition of a hub. Rounds are written tables, so a lost executor costs a
re-read. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.storage import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a long, b long); a component is named by its smallest node.

    Links to itself and links with a null end are left out; the order and the
    number of times a link is given do not matter.
    """
    held = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "components")
    state = None
    while True:
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        pairs = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        new = materialize(pairs.filter("u > v").distinct(), "components")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(held)
        discard(least)
        held = new
        if now == state:
            break
        state = now
    ends = held.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
