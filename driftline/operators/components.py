"""Connected components by alternating star contractions.

Large star: every node hands the smallest node it sees to its larger neighbours. Small star: every
node hands it to its smaller ones, itself included. Repeated, the edges end as stars around the smallest
node of each component, in a number of rounds that grows with the logarithm of the nodes, not with the
diameter. Minima are aggregates that combine before the shuffle and are joined back, so a node
with very many edges is split like any skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.plans.storage import drop_path, materialize


def _handed(edges: DataFrame, keys: list[str], smaller: bool) -> DataFrame:
    """One star contraction of ``edges(keys, a, b)``."""
    if smaller:
        seen = edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        seen = edges.union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    least = seen.groupBy(*keys, "a").agg(F.min("b").alias("m")).select(*keys, "a", F.least("a", "m").alias("m"))
    joined = seen.join(least, [*keys, "a"])
    out = joined.select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
    if smaller:
        out = out.union(least.select(*keys, "a", F.col("m").alias("b")))
    else:
        out = joined.where(F.col("b") > F.col("a")).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, keys: list[str] | None = None, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """``keys, node, label`` of every node that an edge touches; label is the smallest node of its component.

    ``keys``: columns that part independent graphs in one table (samples, say). Edges may repeat and
    come in any direction; loops and edges with a null end are no edges. No edges give no rows.
    """
    keys = keys or []
    e = edges.select(*keys, F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b").distinct()
    e = materialize(e, "edges")
    before = None
    for _ in range(max_rounds):
        star = materialize(_handed(_handed(e, keys, smaller=False), keys, smaller=True), "stars")
        state = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)")).alias("h")).first()
        drop_path(e.sparkSession, e)
        e = star
        if state == before:
            roots = e.select(*keys, F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
            return e.select(*keys, F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
