"""Connected components by alternating large-star and small-star steps; links and labels never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findoc.llm.common import few, release, written


def _stars(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """``edges`` (u > v). Large star: every greater neighbour of u points to u's least one. Small star: every lesser one, and u."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges
    least = few(both.groupBy("u").agg(F.min("v").alias("m")), n).withColumn("m", F.least("u", "m"))
    near = few(both.join(least, "u"), 2 * n)
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    # repeated edges fold in the next aggregate and once a round
    return out.where("u <> v")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links``; the component is its least node. Null ends and self-links do not count.

    Each round's edges are written; those of the round before go.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or now == state:
            break
        state, n, old = now, now["n"], edges
        edges = written(few(_stars(_stars(edges, True, n), False, n).distinct(), n), "stars")
        release(old)
    named = written(few(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct()), 2 * (now["n"] or 0)), "components")
    release(edges)
    return named
