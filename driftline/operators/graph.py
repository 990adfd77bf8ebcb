"""Graphs as tables, and their construction.

Edges are a table ``src, dst`` (bigint), of which every undirected edge has both arcs once it is
symmetrized. Loops and repeated arcs go at that point, and only there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.coins import coin


@dataclass(frozen=True)
class Graph:
    """``vertices(id)`` and ``edges(src, dst[, w])``; symmetric: both arcs of every edge are there."""

    vertices: DataFrame
    edges: DataFrame
    symmetric: bool = False

    @classmethod
    def of_edges(cls, edges: DataFrame, symmetric: bool = False) -> Graph:
        ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
        return cls(ends.distinct(), edges, symmetric)

    def half(self) -> DataFrame:
        """Each undirected edge once, ``src < dst``."""
        if not self.symmetric:
            raise ValueError("only a symmetric graph has undirected edges")
        return self.edges.where("src < dst")


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both arcs of every edge, without loops and repeats."""
    e = edges.select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def transpose(edges: DataFrame) -> DataFrame:
    """Every arc turned round; loops and repeats stay."""
    turned = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return edges.select(*(turned.get(c, F.col(c)) for c in edges.columns))


def out_degree(graph: Graph) -> DataFrame:
    """``id, degree`` of every vertex, 0 for those without arcs."""
    n = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return graph.vertices.join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place (from 0) in ``order``, which must be total: sorted in ranges, counted by
    range, and numbered within; nothing passes through a single task but one count for each range."""
    from driftline.plans.storage import materialize

    ranged = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_row", within).join(F.broadcast(offsets), "_part").select(
        *rows.columns, (F.col("_before") + F.col("_row") - 1).alias(name)
    )


def slot_ids(edges: DataFrame) -> DataFrame:
    """``src, dst, edge_id``: the place of each arc in the order of (src, dst)."""
    return numbered(edges.select("src", "dst"), ["src", "dst"], "edge_id")


def offsets(graph: Graph) -> DataFrame:
    """``id, offset``: for every vertex, arcs of all smaller ones."""
    degree = numbered(out_degree(graph), ["id"], "_k")
    part = degree.withColumn("_part", F.floor(F.col("_k") / 65536))
    sums = part.groupBy("_part").agg(F.sum("degree").alias("s"))
    before = sums.select("_part", (F.sum("s").over(Window.orderBy("_part")) - F.col("s")).alias("_before"))
    own = F.sum("degree").over(Window.partitionBy("_part").orderBy("id")) - F.col("degree")
    return part.withColumn("_own", own).join(before, "_part").select("id", (F.col("_before") + F.col("_own")).cast("long").alias("offset"))


def remap_first_seen(edges: DataFrame) -> DataFrame:
    """``pos, src, dst`` of ``edges(pos, src, dst)`` with dense ids in the order of first appearance
    (source before destination, ties of ``pos`` by id), from 0."""
    seen = edges.select((2 * F.col("pos")).alias("at"), F.col("src").alias("id")).union(edges.select((2 * F.col("pos") + 1).alias("at"), F.col("dst").alias("id")))
    first = seen.groupBy("id").agg(F.min("at").alias("at"))
    ids = numbered(first, ["at", "id"], "new").select("id", "new")
    s, d = ids.toDF("src", "new_src"), ids.toDF("dst", "new_dst")
    return edges.join(s, "src").join(d, "dst").select("pos", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def ring_lattice(spark: SparkSession, n: int, k: int) -> DataFrame:
    """Arcs of a ring: vertices stand in an order shuffled by a coin, each points at its next k."""
    ids = spark.range(n).select("id", coin(F.col("id"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("c"))
    placed = numbered(ids, ["c", "id"], "place").select("id", "place")
    to = placed.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"), "place")
    to = to.select("src", F.pmod(F.col("place") + F.col("step"), F.lit(n)).cast("long").alias("place"))
    return to.join(placed.withColumnRenamed("id", "dst"), "place").select("src", "dst")


def copurchase(lineitem: DataFrame) -> DataFrame:
    """Parts that were bought in one order, as symmetric arcs."""
    items = lineitem.select("l_orderkey", "l_partkey").distinct()
    pairs = items.alias("a").join(items.alias("b"), "l_orderkey").where("a.l_partkey < b.l_partkey")
    half = pairs.select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")).distinct()
    return half.union(half.select("dst", "src").toDF("src", "dst"))


def bipartite(pairs: DataFrame, left: str, right: str, shift: int = 1_000_000) -> DataFrame:
    """Arcs from each left id to each right id it occurs with; right ids are shifted."""
    return pairs.select(F.col(left).alias("src"), (F.col(right) + shift).alias("dst")).distinct()


def knn(embeddings: DataFrame, k: int = 5, block: int = 512) -> DataFrame:
    """``src, dst`` of the k nearest by the inner product of components times 10^6, rounded down to
    integers (so it is exact); equal ones go to the smaller id. Blocks of rows meet, each pair in one product, and
    k rows of each source leave it."""
    import pandas as pd

    rows = embeddings.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1_000_000).cast("long")).alias("v"))
    n = rows.count()
    blocks = max(1, -(-n // block))
    grouped = rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    both = grouped.toDF("qb", "q").crossJoin(grouped.toDF("cb", "c"))

    def run(batches):
        import numpy as np

        def arrays(block):
            ids = np.array([r["vec_id"] for r in block], np.int64)
            by = np.argsort(ids, kind="stable")
            return ids[by], np.array([r["v"] for r in block], np.int64)[by]

        for batch in batches:
            for left, right in zip(batch.q, batch.c):
                (qi, q), (ci, c) = arrays(left), arrays(right)
                # in floating point where no sum can leave the exact integers
                small = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53
                dot = (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if small else q @ c.T
                by = np.argsort(-dot, axis=1, kind="stable")[:, : k + 1]  # ids ascend, so ties do; one may be the source itself
                src, dst = np.repeat(qi, by.shape[1]), ci[by].ravel()
                found = pd.DataFrame({"src": src, "dst": dst, "dot": np.take_along_axis(dot, by, 1).ravel()})
                yield found[src != dst]

    found = both.select("q", "c").mapInPandas(run, "src long, dst long, dot long")
    order = Window.partitionBy("src").orderBy(F.desc("dot"), "dst")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("src", "dst")
