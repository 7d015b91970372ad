"""Connected components by alternating large and small stars; every step is a join or an aggregate on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Null ends, loops and repeated edges change nothing. A round writes its edges to the shared folder, and the
    rounds end when a round changes no edge: their number grows with the logarithm of the longest path.
    """
    now = store.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        with store.scope() as keep:
            # Written before they are joined: both sides of a join are then plain rows, so that a hub's part can be split at run time.
            least = store.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
            large = store.materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
            least = store.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
            small = large.join(least, "u")
            small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
            after = keep(store.materialize(small, "cc"))
        store.drop(now)
        now, state = after, _state(after)
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return r["n"], r["x"]
