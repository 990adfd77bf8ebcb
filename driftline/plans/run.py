"""From a graph file to seeds and their spread in one call, with the time of every step."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from driftline.operators import cascade, influence, select, weights
from driftline.operators.graph import Graph
from driftline.plans.storage import materialize
from driftline.sources import graph_files

SELECTORS = ("greedy", "lazy")


@dataclass(frozen=True)
class Options:
    """What a run may choose. ``weight`` and its options as in :func:`driftline.operators.weights.assign`."""

    k: int = 100
    samples: int = 256
    weight: str = "degree"
    weight_options: tuple[tuple[str, float], ...] = ()
    selector: str = "greedy"
    alpha: float = 1.0


def _loaded(spark: SparkSession, path: str, options: Options, fmt: str | None, symmetric: bool, k: int | None = None) -> Graph:
    g = graph_files.read_graph(spark, path, fmt, symmetric, k)
    weighted = g if "w" in g.edges.columns and not symmetric else weights.assign(g, options.weight, **dict(options.weight_options))
    return Graph(g.vertices, materialize(weighted.edges, "graph"), g.symmetric)


def choose_seeds(spark: SparkSession, path: str, options: Options = Options(), fmt: str | None = None, knn: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Seeds ``round, vertex, gain, score`` of the symmetrized graph of a file, and a report ``step, seconds``."""
    if options.selector not in SELECTORS:
        raise ValueError(f"unknown selector {options.selector!r}; there are {', '.join(SELECTORS)}")
    times, began = [], time.perf_counter()

    def done(step: str) -> None:
        nonlocal began
        times.append((step, time.perf_counter() - began))
        began = time.perf_counter()

    graph = _loaded(spark, path, options, fmt, True, knn)
    done("graph")
    if options.alpha < 1:
        seeds = select.greedy_alpha(graph, options.samples, options.k, options.alpha)
        done("sketch construction and seed selection")
    else:
        sketch = influence.build_sketch(graph, options.samples)
        done("sketch construction")
        seeds = (select.greedy if options.selector == "greedy" else select.greedy_lazy)(sketch, options.k)
        done("seed selection")
    times.append(("total", sum(t for _, t in times)))
    return seeds, spark.createDataFrame(times, "step string, seconds double")


def evaluate_file(spark: SparkSession, path: str, seeds_path: str, ks: list[int], simulations: int, options: Options = Options(), fmt: str | None = None) -> DataFrame:
    """``set_id, k, simulations, mean`` of every set of a seed file, on the graph of a file as it stands."""
    graph = _loaded(spark, path, options, fmt, False)
    return cascade.evaluate_prefixes(graph, graph_files.read_seeds(spark, seeds_path), ks, simulations)
