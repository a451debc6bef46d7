"""Connected components by repeated contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b), equal within a component; edges with a null end and from a node to itself are left out, repeated ones count once.

    Each round every node joins the first of itself and its neighbours in an
    order that is drawn anew, edges are contracted, and what is left shrinks by a
    constant factor, whatever the shape. A hub's neighbours are aggregated before
    they are shuffled, so no task gathers them."""
    left = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    total, number = None, 0
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        place = lambda c: F.struct(F.xxhash64(c, F.lit(number)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        first = both.groupBy("a").agg(F.min(place("b")).alias("best"))
        step = written(first.select("a", F.least(F.col("best"), place("a"))["to"].alias("to")), "step")
        jump = step.select(F.col("a").alias("to"), F.col("to").alias("far"))
        step = written(step.join(jump, "to").select("a", F.col("far").alias("to")), "jump")
        if total is None:
            total = step.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            on = step.select(F.col("a").alias("label"), "to")
            total = total.join(on, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        total = written(total, "labels")
        to_a = step.select("a", F.col("to").alias("a2"))
        to_b = step.select(F.col("a").alias("b"), F.col("to").alias("b2"))
        left = written(left.join(to_a, "a").join(to_b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        number += 1
    return total if total is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
