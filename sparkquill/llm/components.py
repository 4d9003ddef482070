"""Connected components of a link table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkquill.llm.batches import drop_stored, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Each node links its larger (large) or its smaller neighbours (small, and itself) to its smallest neighbour.

    The smallest neighbour comes from a grouped minimum, which is combined before the shuffle, and is joined back to the links. A node
    with very many links is one key of that join, which adaptive execution splits where its partition is skewed.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    out = both.join(least, both.u == least.w).where("v > u" if large else "true").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long links -> (node, label): the smallest node of the component of each node that has a link. Links may repeat; a link
    to itself and null ends count as none. An empty table gives an empty table."""
    now = stored(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    state = None
    while True:
        after = stored(_star(_star(now, True), False))
        r = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop_stored(now)
        now = after
        if (r.n, r.h) == state or not r.n:
            break
        state = (r.n, r.h)
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label")).distinct()
