"""Graph and seed files.

Formats: ``bin`` (compressed sparse rows: u64 n, m, size, then n + 1 u64 offsets, then m u32 ids, little
endian), ``bin2`` (two such blocks, out-arcs and in-arcs), ``adj`` (text: a header word, n, m, n offsets,
m ids), ``edges`` (text pairs, lines that begin with # left out), ``weighted`` (text: n m, then s t w)
and ``knn`` (text pairs, k for each vertex). Text is read by Spark's readers; ``bin`` by a data
source of which every partition reads a range of vertices.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftline.operators.graph import Graph, numbered, offsets, ring_lattice, slot_ids, symmetrize, transpose
from driftline.plans.storage import materialize

_HEAD = struct.Struct("<QQQ")
_WORD = r"\s+"


def _open(path: str):
    """A seekable file of any store that Arrow knows; plain paths are local."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inside), store.get_file_info(inside).size


class _Range(InputPartition):
    def __init__(self, block: int, first: int, last: int):
        self.block, self.first, self.last = block, first, last


class CsrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.blocks = 2 if options.get("layout") == "two_block" else 1
        self.vertices = int(options.get("vertices_per_partition", 1 << 20))

    def heads(self) -> list[tuple[int, int, int]]:
        """(start, n, m) of each block, sizes checked against the file's length."""
        f, length = _open(self.path)
        out, at = [], 0
        with f:
            for _ in range(self.blocks):
                if length - at < _HEAD.size:
                    raise ValueError(f"{self.path}: too short")
                f.seek(at)
                n, m, size = _HEAD.unpack(f.read(_HEAD.size))
                if size != (n + 1) * 8 + m * 4 + _HEAD.size:
                    raise ValueError(f"{self.path}: the size in the header is not that of {n} vertices and {m} arcs")
                out.append((at, n, m))
                at += size
        if at != length:
            raise ValueError(f"{self.path}: {length} bytes, the header says {at}")
        if len({(n, m) for _, n, m in out}) != 1:
            raise ValueError(f"{self.path}: blocks differ in size")
        return out

    def partitions(self):
        return [_Range(b, v, min(n, v + self.vertices)) for b, (_, n, _) in enumerate(self.heads()) for v in range(0, n, self.vertices)]

    def read(self, partition: _Range) -> Iterator:
        import numpy as np
        import pyarrow as pa

        start, n, _ = self.heads()[partition.block]
        f, _ = _open(self.path)
        with f:
            f.seek(start + _HEAD.size + 8 * partition.first)
            offs = np.frombuffer(f.read(8 * (partition.last - partition.first + 1)), "<u8").astype(np.int64)
            ids_at, a, b = start + _HEAD.size + 8 * (n + 1), int(offs[0]), int(offs[-1])
            sources = np.repeat(np.arange(partition.first, partition.last), np.diff(offs))
            for at in range(a, b, 1 << 20):
                upto = min(b, at + (1 << 20))
                f.seek(ids_at + 4 * at)
                ids = np.frombuffer(f.read(4 * (upto - at)), "<u4").astype(np.int64)
                own = sources[at - a : upto - a]
                columns = [np.full(len(ids), partition.block), np.arange(at, upto), own, ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "edge_id", "src", "dst"])


class CsrSource(DataSource):
    """``spark.read.format("csr").option("path", file)``; option ``layout`` = ``two_block`` for two blocks."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "block long, edge_id long, src long, dst long"

    def reader(self, schema) -> DataSourceReader:
        return CsrReader(self.options)


#: What orders the lines of a text, be it one file or many parts.
_ORDER = ["file", "block", "row"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of every line with the columns of _ORDER: within a split rows are read in order."""
    meta = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return meta.withColumn("row", F.monotonically_increasing_id())


def _tokens(lines: DataFrame) -> DataFrame:
    """``k, token``: the tokens of every line, by their places in it."""
    split = F.filter(F.split("value", _WORD), lambda x: x != "")
    return lines.select(*_ORDER, F.posexplode(split).alias("k", "token"))


def read_adj(spark: SparkSession, path: str) -> Graph:
    """The whole sequence of tokens is numbered in ranges; offsets tell which arcs are whose."""
    tokens = numbered(_tokens(_lines(spark, path)), [*_ORDER, "k"], "at").select("at", "token").where("at > 0")
    tokens = materialize(tokens.select((F.col("at") - 1).alias("at"), F.col("token").try_cast("long").alias("x")), "tokens")
    n, m = (r["x"] for r in tokens.where("at < 2").orderBy("at").collect())
    offs = tokens.where(f"at >= 2 AND at < {2 + n}").select((F.col("at") - 2).alias("id"), F.col("x").alias("o"))
    ids = tokens.where(f"at >= {2 + n} AND at < {2 + n + m}").select((F.col("at") - 2 - n).alias("edge_id"), F.col("x").alias("dst"))
    # the last vertex of which the offset is not beyond an arc owns it; vertices without arcs share an offset
    owners = offs.groupBy("o").agg(F.max("id").alias("src")).select(F.col("o").alias("edge_id"), "src", F.lit(None).cast("long").alias("dst"))
    both = owners.union(ids.select("edge_id", F.lit(None).cast("long").alias("src"), "dst"))
    both = both.withColumn("_range", F.floor(F.col("edge_id") / (1 << 20)))
    lead = both.where("src IS NOT NULL").groupBy("_range").agg(F.max("src").alias("_last"))
    spans = spark.range(m // (1 << 20) + 1).toDF("_range").join(lead, "_range", "left")
    carried = spans.select("_range", F.max("_last").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    within = F.max("src").over(Window.partitionBy("_range").orderBy("edge_id", F.col("dst").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    owned = both.join(F.broadcast(carried), "_range").withColumn("_src", F.greatest(within, F.col("_carried")))
    edges = owned.where("dst IS NOT NULL").select("edge_id", F.col("_src").alias("src"), "dst")
    return Graph(spark.range(n), edges)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``pos, src, dst`` of text pairs; lines that begin with # are left out, ``pos`` grows with the place."""
    split = F.filter(F.split("value", _WORD), lambda x: x != "")
    rows = _lines(spark, path).where(~F.col("value").startswith("#")).select(*_ORDER, split.alias("t")).where("size(t) >= 2")
    rows = numbered(rows, _ORDER, "pos")
    return rows.select("pos", F.col("t")[0].cast("long").alias("src"), F.col("t")[1].cast("long").alias("dst"))


def read_weighted(spark: SparkSession, path: str) -> Graph:
    split = F.filter(F.split("value", _WORD), lambda x: x != "")
    rows = spark.read.text(path).select(split.alias("t"))
    n = rows.where("size(t) = 2").select(F.col("t")[0].cast("long").alias("n")).first()["n"]
    t = F.col("t")
    return Graph(spark.range(n), rows.where("size(t) = 3").select(t[0].cast("long").alias("src"), t[1].cast("long").alias("dst"), t[2].cast("double").alias("w")))


def read_csr(spark: SparkSession, path: str, two_block: bool = False) -> Graph:
    """Arcs with their slots (``edge_id``); of two blocks the first, the second holding the same arcs turned round."""
    spark.dataSource.register(CsrSource)
    rows = spark.read.format("csr").option("path", path).option("layout", "two_block" if two_block else "one_block").load()
    n = CsrReader({"path": path, "layout": "two_block" if two_block else "one_block"}).heads()[0][1]
    return Graph(spark.range(n), rows.where("block = 0").select("edge_id", "src", "dst"))


#: Formats by the extension of a file's name.
EXTENSIONS = {"bin": "bin", "adj": "adj"}
#: Size of the graph that stands for a file of the name ``synthetic``: vertices, and arcs of each.
SYNTHETIC = (100_000, 63)


def format_of(path: str) -> str:
    """The format that a path's name tells: ``synthetic``, or by extension."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name == "synthetic":
        return name
    found = EXTENSIONS.get(name.rsplit(".", 1)[-1]) if "." in name else None
    if found is None:
        raise ValueError(f"{path}: its name tells no format; name one of {', '.join(FORMATS)}")
    return found


FORMATS = ("bin", "bin2", "adj", "edges", "weighted", "knn", "synthetic")


def read_graph(spark: SparkSession, path: str, fmt: str | None = None, symmetric: bool = False, k: int | None = None) -> Graph:
    """The graph of a file by format (without one, as the file's name tells; a path with ``sym`` in it then holds
    both arcs of every edge); with ``symmetric``, both arcs of every edge and no loops."""
    marked = fmt is None and "sym" in path
    fmt = fmt or format_of(path)
    if fmt == "synthetic":
        n, degree = SYNTHETIC
        return Graph(spark.range(n), symmetrize(ring_lattice(spark, n, k or degree)), True)
    if fmt == "bin":
        g = read_csr(spark, path)
    elif fmt == "bin2":
        g = read_csr(spark, path, two_block=True)
    elif fmt == "adj":
        g = read_adj(spark, path)
    elif fmt in ("edges", "knn"):
        pairs = read_pairs(spark, path)
        if fmt == "knn":
            if not k:
                raise ValueError("knn files need k")
            g = Graph(spark.range(pairs.count() // k), pairs.select("src", "dst"))
        else:
            g = Graph.of_edges(pairs.select("src", "dst"))
    elif fmt == "weighted":
        g = read_weighted(spark, path)
    else:
        raise ValueError(f"unknown graph format {fmt!r}; there are {', '.join(FORMATS)}")
    if marked and not symmetric:
        return Graph(g.vertices, g.edges, True)
    return Graph(g.vertices, symmetrize(g.edges), True) if symmetric else g


def convert_text(spark: SparkSession, path: str, plain: str, both_ways: str, n: int | None = None, k: int | None = None) -> None:
    """Write the pairs of a text file as two ``bin`` files: as they stand, and symmetrized. Vertices are 0..n-1; n is
    one more than the greatest id, or, with ``k``, the number of pairs divided by it."""
    pairs = materialize(read_pairs(spark, path).select("src", "dst"), "pairs")
    if n is None:
        n = pairs.count() // k if k else (pairs.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0) + 1
    vertices = spark.range(n)
    write_csr(Graph(vertices, pairs), plain)
    write_csr(Graph(vertices, symmetrize(pairs), True), both_ways)


def write_labels(sketch_rows: DataFrame, path: str) -> None:
    """Component labels as CSV parts with a header: ``r,v,label,size``."""
    sketch_rows.select("r", "v", "label", "size").write.option("header", True).csv(path)


def write_samples(live: DataFrame, path: str) -> None:
    """Sampled graphs ``r, u, v`` as Parquet, a folder for each sample."""
    live.write.partitionBy("r").parquet(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """``set_id, round, vertex``: the ids of each line that begins with ``seeds:``, lines in order from 0."""
    lines = _lines(spark, path).where(F.col("value").startswith("seeds:"))
    ids = F.filter(F.split(F.substring("value", 7, 1 << 30), " "), lambda x: x != "")
    sets = numbered(lines.select(*_ORDER, ids.alias("ids")), _ORDER, "set_id")
    return sets.select("set_id", F.posexplode("ids").alias("round", "vertex")).select("set_id", "round", F.col("vertex").cast("long").alias("vertex"))


def prefix_of(seeds: DataFrame, set_id: int, k: int) -> DataFrame:
    """The first k seeds of one set."""
    return seeds.where((F.col("set_id") == set_id) & (F.col("round") < k)).orderBy("round").select("vertex")


def seeds_line(seeds: DataFrame) -> DataFrame:
    """``value``: the line of a seed file, ids in the order of rounds."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("round", "vertex"))), lambda s: s["vertex"].cast("string"))
    return seeds.agg(F.concat(F.lit("seeds: "), F.concat_ws(" ", ids)).alias("value"))


def write_seeds(seeds: DataFrame, path: str) -> None:
    seeds_line(seeds).write.mode("append").text(path)


def write_csr(graph: Graph, path: str, two_block: bool = False) -> None:
    """Vertices must be 0..n-1. The driver streams one range of rows after another to the file."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_output_stream(inside) as out:
        for g in (graph, Graph(graph.vertices, transpose(graph.edges.select("src", "dst")))) if two_block else (graph,):
            n, m = g.vertices.count(), g.edges.count()
            out.write(_HEAD.pack(n, m, (n + 1) * 8 + m * 4 + _HEAD.size))
            offs = offsets(g).orderBy("id")
            ids = slot_ids(g.edges).orderBy("edge_id")
            for column, kind in ((offs.select("offset"), "Q"), (ids.select("dst"), "I")):
                for r in _packed(column, kind).toLocalIterator():
                    out.write(bytes(r["data"]))
                if kind == "Q":
                    out.write(struct.pack("<Q", m))


def _packed(column: DataFrame, kind: str) -> DataFrame:
    """Little-endian bytes of an ordered column, a row for each batch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            data = b.column(0).to_numpy(zero_copy_only=False).astype("<u8" if kind == "Q" else "<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    return column.mapInArrow(run, "data binary")


def write_adj(graph: Graph, path: str) -> None:
    """One token a line, in parts that follow one another in order."""
    spark = graph.edges.sparkSession
    n, m = graph.vertices.count(), graph.edges.count()
    head = spark.createDataFrame([(0, 0, "AdjacencyGraph"), (0, 1, str(n)), (0, 2, str(m))], "part int, at long, value string")
    offs = offsets(graph).select(F.lit(1).alias("part"), F.col("id").alias("at"), F.col("offset").cast("string").alias("value"))
    ids = slot_ids(graph.edges).select(F.lit(2).alias("part"), F.col("edge_id").alias("at"), F.col("dst").cast("string").alias("value"))
    head.union(offs).union(ids).orderBy("part", "at").select("value").write.text(path)
