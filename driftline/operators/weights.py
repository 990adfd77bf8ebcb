"""Edge probabilities: each model adds a column ``w`` to the arcs of a graph."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.coins import P, coin
from driftline.operators.graph import Graph, out_degree


def constant(graph: Graph, w: float) -> Graph:
    return replace(graph, edges=graph.edges.withColumn("w", F.lit(float(w))))


def uniform(graph: Graph, low: float, high: float) -> Graph:
    """A value in low..high by a coin of the ends, the same in both directions."""
    zero = F.lit(0).cast("long")
    x = coin(F.least("src", "dst") + 1, F.greatest("src", "dst") + 1, zero) / F.lit(float(P))
    return replace(graph, edges=graph.edges.withColumn("w", F.lit(float(low)) + x * (high - low)))


def by_degree(graph: Graph) -> Graph:
    """2 / (degree of one end + degree of the other)."""
    d = out_degree(graph)
    e = graph.edges.join(d.toDF("src", "_a"), "src").join(d.toDF("dst", "_b"), "dst")
    return replace(graph, edges=e.withColumn("w", F.lit(2.0) / (F.col("_a") + F.col("_b"))).drop("_a", "_b"))


def by_in_degree(graph: Graph) -> Graph:
    """1 / in-degree of the destination; for directed graphs."""
    n = graph.edges.groupBy("dst").agg(F.count("*").alias("_n"))
    return replace(graph, edges=graph.edges.join(n, "dst").withColumn("w", F.lit(1.0) / F.col("_n")).drop("_n"))


def assign(graph: Graph, model: str, **options) -> Graph:
    """The model by name: constant (w), uniform (low, high), degree, in_degree."""
    models = {"constant": constant, "uniform": uniform, "degree": by_degree, "in_degree": by_in_degree}
    if model not in models:
        raise ValueError(f"unknown weight model {model!r}; there are {', '.join(models)}")
    return models[model](graph, **options)


def weights(graph: Graph) -> DataFrame:
    return graph.edges.select("src", "dst", "w")
