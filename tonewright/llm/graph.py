"""Connected components of an edge list, by alternating large-star and small-star steps.

Each step is a few DataFrame operations on the edges; what a step gives is written to the
shared folder, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.common import forget, saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least of their star; edges are (u, v) with u > v."""
    if large:
        around = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (two columns of integers): the component's
    least node. Loops and repeated edges are fine; no edges give no rows. The result is a table of
    the shared folder; the edges of each step are deleted after the next."""
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = saved(now, "edges")
    mark = None
    while True:
        before, now = now, saved(_stars(_stars(now, True), False), "edges")
        forget(before)
        # the order of edges doesn't matter: two sums of hashes tell if anything moved
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) div 1048576)")).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    both = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = saved(both.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    forget(now)
    return out
