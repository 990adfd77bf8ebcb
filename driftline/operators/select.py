"""Greedy choice of seeds: again and again the vertex with the largest marginal gain, ties to the smallest
id; chosen vertices are not chosen again. All three ways give the same seeds.

What comes to the driver: of each seed its component in each sample (k x samples rows), and in the lazy ways
those of the vertices that are evaluated, a batch of which doubles only while an old gain exceeds the best new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.coins import P, coin, threshold
from driftline.operators.graph import Graph
from driftline.operators.influence import Sketch, component_rows, influence
from driftline.plans.storage import drop_path, materialize

SCHEMA = "round int, vertex long, gain long, score double"


def _table(spark: SparkSession, seeds: list[tuple[int, int]], samples: int) -> DataFrame:
    return spark.createDataFrame([(i, v, g, g / samples) for i, (v, g) in enumerate(seeds)], SCHEMA)


def _pairs(spark: SparkSession, rows: set[tuple[int, int]]) -> DataFrame:
    """Covered components: at most one for each seed and sample."""
    return F.broadcast(spark.createDataFrame(sorted(rows), "r long, label long"))


def greedy(sketch: Sketch, k: int) -> DataFrame:
    """``round, vertex, gain, score`` of min(k, n) seeds. All gains are counted once; after each choice only the members
    of the components that it newly covers lose theirs."""
    spark = sketch.rows.sparkSession
    gains = materialize(influence(sketch), "gains")
    seeds: list[tuple[int, int]] = []
    covered: set[tuple[int, int]] = set()
    while len(seeds) < k:
        best = gains.orderBy(F.desc("gain"), "v").first()
        if best is None:
            break
        seeds.append((best["v"], best["gain"]))
        if len(seeds) == k:
            break
        found = {(x["r"], x["label"]) for x in sketch.rows.where(F.col("v") == best["v"]).select("r", "label").collect()}
        left = gains.where(F.col("v") != best["v"])
        if new := found - covered:
            loss = sketch.rows.join(_pairs(spark, new), ["r", "label"]).groupBy("v").agg(F.sum("size").alias("loss"))
            left = left.join(loss, "v", "left").select("v", (F.col("gain") - F.coalesce("loss", F.lit(0))).alias("gain"))
        covered |= new
        last, gains = gains, materialize(left, "gains")
        drop_path(spark, last)
    return _table(spark, seeds, sketch.samples)


def _lazy(spark: SparkSession, initial: DataFrame, samples: int, k: int, evaluate, batch: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Gains only fall, so old ones bound new ones: the best of a batch is final once no old gain
    outside of the batch exceeds it, nor equals it at a smaller id. ``evaluate(vertices)`` gives {vertex: {(r, label): size}} and
    counts lone vertices under label -1. Returns seeds and evaluations of each round."""
    initial = initial.orderBy(F.desc("gain"), "v")
    seeds: list[tuple[int, int]] = []
    covered: set[tuple[int, int]] = set()
    places: dict[int, dict] = {}
    fetched: list[tuple[int, int]] = []
    ended = False
    counts: list[int] = []
    while len(seeds) < k:
        chosen = {v for v, _ in seeds}
        best, size, n = None, batch, 0
        while True:
            if not ended and len(fetched) < size + len(seeds) + 1:
                want = max(size + len(seeds) + 1, 2 * len(fetched))
                fetched = [(x["v"], x["gain"]) for x in initial.limit(want).collect()]
                ended = len(fetched) < want
            new = [v for v, _ in fetched if v not in places]
            if new:
                places |= evaluate(new)
                n += len(new)
            now = [(-sum(s for c, s in places[v].items() if c not in covered), v) for v, _ in fetched if v not in chosen]
            best = min(now, default=None)
            bound = (-fetched[-1][1], fetched[-1][0]) if fetched else (0, -1)  # what comes after it is not better than this
            if ended or best is not None and best <= bound:
                break
            size *= 2
        counts.append(n)
        if best is None:
            break
        gain, v = -best[0], best[1]
        seeds.append((v, gain))
        covered |= set(places[v])
    return seeds, counts


def _of_rows(rows: DataFrame, vertices: list[int], samples: int) -> dict[int, dict]:
    """Components of some vertices: at most one row for each and sample."""
    spark = rows.sparkSession
    few = F.broadcast(spark.createDataFrame([(v,) for v in vertices], "v long"))
    out: dict[int, dict] = {v: {} for v in vertices}
    for x in rows.join(few, "v", "left_semi").select("r", "v", "label", "size").collect():
        out[x["v"]][x["r"], x["label"]] = x["size"]
    for v, found in out.items():
        alone = samples - len(found)
        if alone:
            found[-1 - v, -1] = alone  # a key of its own: only v itself covers it
    return out


def greedy_lazy(sketch: Sketch, k: int, batch: int = 64) -> DataFrame:
    """As :func:`greedy`, by batches of doubling size of the vertices with the largest old gains."""
    spark = sketch.rows.sparkSession
    initial = materialize(influence(sketch), "gains")
    seeds, _ = _lazy(spark, initial, sketch.samples, k, lambda vs: _of_rows(sketch.rows, vs, sketch.samples), batch)
    return _table(spark, seeds, sketch.samples)


def lazy_evaluations(sketch: Sketch, k: int, batch: int = 64) -> DataFrame:
    """``round, evaluated`` of :func:`greedy_lazy`."""
    spark = sketch.rows.sparkSession
    _, counts = _lazy(spark, materialize(influence(sketch), "gains"), sketch.samples, k, lambda vs: _of_rows(sketch.rows, vs, sketch.samples), batch)
    return spark.createDataFrame(list(enumerate(counts)), "round int, evaluated long")


def is_center(alpha: float):
    """Whether a vertex keeps its sketch rows: a coin, or always at 1."""
    if alpha >= 1:
        return F.lit(True)
    zero = F.lit(0).cast("long")
    return coin(F.col("v"), zero + 1, zero + 2) < int(alpha * P)


def locate(graph: Graph, samples: int, centers: DataFrame, vertices: list[int]) -> DataFrame:
    """``v, r, label, size`` of the component of each given vertex in each sample, from the rows of
    centers alone: the vertex searches its live edges, hop by hop, until it meets a center; if there
    is none in the component, what it has seen is the component."""
    spark = graph.edges.sparkSession
    arcs = graph.edges.select("src", "dst", threshold(F.col("w")).alias("t"))
    start = spark.createDataFrame([(v,) for v in vertices], "v long").select("v", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("r")).withColumn("r", F.col("r").cast("long"))
    rows = centers.select("r", F.col("v").alias("at"), "label", "size")
    front = seen = materialize(start.select("v", "r", F.col("v").alias("at")).join(rows, ["r", "at"], "left"), "front")
    while True:
        going = front.join(front.where("label IS NOT NULL").select("v", "r").distinct(), ["v", "r"], "left_anti")
        step = going.join(arcs, going["at"] == arcs["src"]).where(coin(F.least("src", "dst"), F.greatest("src", "dst"), F.col("r")) < F.col("t"))
        new = step.select("v", "r", F.col("dst").alias("at")).distinct().join(seen.select("v", "r", "at"), ["v", "r", "at"], "left_anti")
        front = materialize(new.join(rows, ["r", "at"], "left"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    ends = seen.groupBy("v", "r").agg(F.min("label").alias("label"), F.min("size").alias("size"), F.min("at").alias("least"), F.count("*").alias("n"))
    return ends.select("v", "r", F.coalesce("label", "least").alias("label"), F.coalesce("size", "n").alias("size"))


def greedy_alpha(graph: Graph, samples: int, k: int, alpha: float, batch: int = 16) -> DataFrame:
    """As :func:`greedy`, with sketch rows of a share ``alpha`` of the vertices only."""
    spark = graph.edges.sparkSession
    rows = component_rows(graph, samples)  # read twice, never written whole
    initial = materialize(influence(Sketch(graph, samples, rows)), "gains")
    centers = materialize(rows.where(is_center(alpha)), "centers")
    lone = "size > 1"  # a lone vertex is covered by itself alone
    seeds, _ = _lazy(spark, initial, samples, k, lambda vs: _of_rows(locate(graph, samples, centers, vs).where(lone), vs, samples), batch)
    return _table(spark, seeds, samples)


def total_score(seeds: DataFrame) -> DataFrame:
    """``k, score``: seeds and the sum of their scores."""
    return seeds.agg(F.count("*").alias("k"), F.sum("score").alias("score"))
