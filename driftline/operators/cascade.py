"""Cascades: independent simulations over directed arcs, all of them in one table, hop by hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.coins import DIRECTED, coin, threshold
from driftline.operators.graph import Graph
from driftline.plans.storage import drop_path, materialize


#: Hops after which what was reached so far is written as one table.
COMPACT = 8
#: Rows of a front up to which it is sent to the arcs, instead of the arcs being dealt to it.
SMALL_FRONT = 100_000


def spread(graph: Graph, seeds: DataFrame, simulations: int) -> DataFrame:
    """``i, activated``: vertices that each simulation activates, the distinct ``seeds(vertex)`` included.

    An arc's coin hangs on its slot (``edge_id``) where the arcs have one, so parallel arcs toss independently; else
    on its ends, in this direction only. Seeds that are no vertices of the graph count for themselves. Whatever the number
    of hops, a hop's plan reads COMPACT tables at most.
    """
    return spread_of_sets(graph, seeds.select(F.lit(0).alias("set_id"), "vertex"), simulations).select("i", "activated")


def spread_of_sets(graph: Graph, sets: DataFrame, simulations: int) -> DataFrame:
    """``set_id, i, activated``: the same for many sets ``sets(set_id, vertex)`` at once, with the same coins."""
    spark = graph.edges.sparkSession
    slots = "edge_id" in graph.edges.columns
    ends = [F.col("edge_id"), F.lit(0).cast("long")] if slots else [F.col("src"), F.col("dst")]
    arcs = graph.edges.where("w > 0").select("src", "dst", threshold(F.col("w")).alias("t"), *(["edge_id"] if slots else []))
    arcs = materialize(arcs, "arcs")  # weights may come by joins
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(simulations - 1).cast("long")))
    begin = sets.select("set_id", F.col("vertex").alias("v")).distinct().select("set_id", runs.alias("i"), "v")
    front = materialize(begin, "front")
    parts = [front]
    seen = front
    while True:
        few = front.limit(SMALL_FRONT + 1).count() <= SMALL_FRONT
        step = (F.broadcast(front) if few else front).join(arcs, front["v"] == arcs["src"]).where(coin(*ends, F.col("i") + DIRECTED) < F.col("t"))
        new = step.select("set_id", "i", F.col("dst").alias("v")).distinct().join(seen, ["set_id", "i", "v"], "left_anti")
        front = materialize(new, "front")
        if front.isEmpty():
            return seen.groupBy("set_id", "i").agg(F.count("*").alias("activated"))
        parts.append(front)
        seen = seen.union(front)
        if len(parts) >= COMPACT:
            seen = materialize(seen, "seen")
            for p in parts[:-1]:  # the last one is the front
                drop_path(spark, p)
            parts = [seen]


def mean_spread(graph: Graph, seeds: DataFrame, simulations: int) -> DataFrame:
    """``simulations, mean``."""
    each = spread(graph, seeds, simulations)
    return each.agg(F.lit(simulations).cast("long").alias("simulations"), (F.sum("activated") / F.lit(simulations)).alias("mean"))


def evaluate_prefixes(graph: Graph, seeds: DataFrame, ks: list[int], simulations: int) -> DataFrame:
    """``set_id, k, simulations, mean``: the mean spread of the first k seeds of every set of ``seeds(set_id, round, vertex)``,
    for every k, all in one run."""
    spark = graph.edges.sparkSession
    cuts = F.broadcast(spark.createDataFrame([(int(k),) for k in sorted(set(ks))], "k int"))
    wanted = seeds.join(cuts, F.col("round") < F.col("k")).select(F.struct("set_id", "k").alias("set_id"), "vertex")
    each = spread_of_sets(graph, wanted, simulations).groupBy("set_id").agg((F.sum("activated") / F.lit(simulations)).alias("mean"))
    return each.select("set_id.set_id", "set_id.k", F.lit(simulations).cast("long").alias("simulations"), "mean")


def random_seeds(graph: Graph, k: int, salt: int = 0) -> DataFrame:
    """``vertex``: k vertices in the order of a coin, a baseline for chosen ones."""
    c = coin(F.col("id"), F.lit(salt).cast("long"), F.lit(7).cast("long"))
    return graph.vertices.orderBy(c, "id").limit(k).select(F.col("id").alias("vertex"))


def top_degree_seeds(graph: Graph, k: int) -> DataFrame:
    """``vertex``: the k vertices with most arcs, ties to the smallest id."""
    n = graph.edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "vertex").limit(k).select("vertex")


def seeds_of(spark: SparkSession, vertices: list[int]) -> DataFrame:
    return spark.createDataFrame([(int(v),) for v in vertices], "vertex long")
