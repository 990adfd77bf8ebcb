"""Sampled graphs, their components, and what each vertex reaches.

Samples are never stored: whether an edge is live in sample r is a coin, tossed in the stage that reads
the edges. Components of a single vertex aren't stored either; in every sample in which a vertex is in
no stored component, it reaches itself alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.coins import coin, threshold
from driftline.operators.components import connected_components
from driftline.operators.graph import Graph
from driftline.plans.storage import materialize


def live_edges(graph: Graph, samples: int) -> DataFrame:
    """``r, u, v`` (u < v) of the undirected edges that are live in each sample."""
    e = graph.half().select(F.col("src").alias("u"), F.col("dst").alias("v"), threshold(F.col("w")).alias("t"))
    tossed = e.select("u", "v", "t", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("r")).withColumn("r", F.col("r").cast("long"))
    return tossed.where(coin(F.col("u"), F.col("v"), F.col("r")) < F.col("t")).select("r", "u", "v")


@dataclass(frozen=True)
class Sketch:
    """``rows(r, v, label, size)`` of the vertices in components of two and more; label is the least id."""

    graph: Graph
    samples: int
    rows: DataFrame

    def all_rows(self) -> DataFrame:
        """Rows of every vertex in every sample."""
        every = self.graph.vertices.select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(self.samples - 1))).alias("r")).withColumn("r", F.col("r").cast("long"))
        joined = every.join(self.rows, ["r", "v"], "left")
        return joined.select("r", "v", F.coalesce("label", "v").alias("label"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))


def component_rows(graph: Graph, samples: int) -> DataFrame:
    """``r, v, label, size`` of the vertices in components of two and more: components and their sizes, joined when read."""
    comps = connected_components(live_edges(graph, samples), keys=["r"], src="u", dst="v").select("r", F.col("node").alias("v"), "label")
    sizes = materialize(comps.groupBy("r", "label").agg(F.count("*").alias("size")), "sizes")
    return comps.join(sizes, ["r", "label"]).select("r", "v", "label", "size")


def build_sketch(graph: Graph, samples: int) -> Sketch:
    return Sketch(graph, samples, materialize(component_rows(graph, samples), "sketch"))


def influence(sketch: Sketch, covered: DataFrame | None = None) -> DataFrame:
    """``v, gain``: the sum over samples of what each vertex reaches; components in ``covered(r, label)``
    count nothing."""
    rows = sketch.rows
    own = rows.groupBy("v").agg(F.count("*").alias("placed"))
    if covered is not None:
        rows = rows.join(covered, ["r", "label"], "left_anti")
    reached = rows.groupBy("v").agg(F.sum("size").alias("reached"))
    joined = sketch.graph.vertices.select(F.col("id").alias("v")).join(own, "v", "left").join(reached, "v", "left")
    gain = F.coalesce("reached", F.lit(0)) + F.lit(sketch.samples) - F.coalesce("placed", F.lit(0))
    return joined.select("v", gain.cast("long").alias("gain"))


def component_sizes(sketch: Sketch) -> DataFrame:
    """``r, label, size`` of every component."""
    return sketch.all_rows().groupBy("r", "label").agg(F.count("*").alias("size"))
