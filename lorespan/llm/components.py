"""Connected components by contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """id, root of every end of edges(a, b), longs: root is the smallest id that links reach. Loops, repeats and both directions are fine.

    Each round maps every vertex to the smallest of itself and its neighbours and every edge with its ends, until no edge
    is left between different vertices: a logarithmic number of rounds in practice. Each round's maps and edges are
    tables in the shared folder.
    """
    rounds = []
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a is not null and b is not null").distinct(), "edges")
    everyone = left
    left = left.filter("a <> b")
    while left.limit(1).count():
        ends = left.select(F.col("a").alias("id"), F.col("a").alias("to")).unionAll(left.select(F.col("b").alias("id"), F.col("a").alias("to")))
        least = stored(ends.groupBy("id").agg(F.min("to").alias("to")), "labels")
        rounds.append(least)
        moved = left.join(least.select(F.col("id").alias("a"), F.col("to").alias("_a")), "a").join(least.select(F.col("id").alias("b"), F.col("to").alias("_b")), "b")
        left = stored(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a <> b").distinct(), "edges")
    ids = everyone.select(F.col("a").alias("id")).unionAll(everyone.select(F.col("b").alias("id"))).distinct()
    roots = ids.withColumn("root", F.col("id"))
    for least in rounds:
        roots = roots.join(least.select(F.col("id").alias("root"), F.col("to").alias("_to")), "root", "left").select("id", F.coalesce("_to", "root").alias("root"))
    return stored(roots, "components")
