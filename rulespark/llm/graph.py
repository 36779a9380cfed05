"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm.common import materialize


def _digest(edges: DataFrame):
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")
    ).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)`` for every node with a link.

    ``root`` is the smallest node reachable. Self links and repeated links are harmless;
    an empty table gives an empty one. A node's neighbours are never gathered: each step
    takes minima (combined before the shuffle) and joins them back, so a hub's rows can
    be split by adaptive execution. Rounds grow with the logarithm of a chain's length.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = materialize(
        edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(),
        "links",
    )
    seen = _digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(low, "hi")
        small = joined.select(
            F.explode(
                F.array(
                    F.struct(F.col("hi"), F.col("m").alias("lo")),
                    F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                )
            ).alias("e")
        ).select("e.hi", "e.lo")
        now = materialize(small.where("hi <> lo").distinct(), "links")
        was, seen = seen, _digest(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
