"""Connected components of an edge table, by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(directed: DataFrame) -> DataFrame:
    """(x, m): the smallest of x and its neighbours. Aggregated before the shuffle, so a hub costs no more than others.

    The key is written anew (xor 0), so that the planner deals these rows out once more for the join instead of reusing the
    aggregation's layout: only where both sides of a join come from shuffles of their own can it cut a hub's edges into
    several tasks (adaptive skew join), each with a copy of the hub's one row here.
    """
    least = directed.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
    return least.select(F.col("x").bitwiseXOR(F.lit(0).cast("long")).alias("x"), "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node long, label long) for every node of an edge; label is the component's smallest node.

    ``edges`` has two long columns ``u`` and ``v``; rows with a null or u = v, repeats and an empty table are fine.
    Each round moves every edge to a smaller root; it ends when a round changes nothing, and a round's table goes once the next
    is written. No component, list of neighbours or edge table is ever gathered in one task or the driver.
    """
    now = materialize(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = now.selectExpr("u AS x", "v AS y").union(now.selectExpr("v AS x", "u AS y"))
        large = (
            both.join(_least(both).hint("merge"), "x").where("y > x AND y != m").selectExpr("y AS u", "m AS v").distinct()
        )
        down = large.selectExpr("u AS x", "v AS y")
        least = _least(down)
        small = (
            down.join(least.hint("merge"), "x").where("y != m").selectExpr("y AS u", "m AS v").union(least.selectExpr("x AS u", "m AS v")).distinct()
        )
        now, old = materialize(small, "edges"), now
        discard(old)
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    )
