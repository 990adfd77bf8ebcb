"""Driver-facing queries of the graph operators, each with its SQL for a second engine where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import coins
from driftline.operators import cascade, influence, select, weights
from driftline.operators import graph as graphs
from driftline.operators.graph import Graph
from driftline.plans.storage import materialize, new_path
from driftline.sources import graph_files

R, W, K = 16, 0.005, 5
SIMULATIONS = 16
#: Weight in the graph with repeated arcs, small enough for single arcs to matter.
MULTI_W = 0.0005
ALPHA = 0.1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """The co-purchase graph, built once in a query: every later step reads it several times."""
    edges = materialize(graphs.copurchase(_table(spark, sf_dir, "lineitem")), "copurchase")
    return Graph.of_edges(edges, symmetric=True)


def _weighted(spark: SparkSession, sf_dir: str) -> Graph:
    return weights.constant(_copurchase(spark, sf_dir), W)


def _arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph with loops and repeats: the nation of each supplier to that of each part's buyer."""
    l, s, o, c = (_table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders", "customer"))
    return l.join(s, l.l_suppkey == s.s_suppkey).join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select(
        F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")
    )


def q_supp_part(spark, d):
    return graphs.bipartite(_table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


def q_cust_supp(spark, d):
    l, o = _table(spark, d, "lineitem"), _table(spark, d, "orders")
    return graphs.bipartite(l.join(o, l.l_orderkey == o.o_orderkey), "o_custkey", "l_suppkey")


def q_remap(spark, d):
    e = _table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"))
    return graphs.remap_first_seen(e)


def q_offsets(spark, d):
    return graphs.offsets(_copurchase(spark, d))


def q_weights_uniform(spark, d):
    g = weights.uniform(_copurchase(spark, d), 0.1, 0.3)
    return g.edges.select("src", "dst", F.round("w", 9).alias("w"))


def q_weights_degree(spark, d):
    return weights.by_degree(_copurchase(spark, d)).edges.select("src", "dst", F.round("w", 9).alias("w"))


def q_weights_in_degree(spark, d):
    g = weights.by_in_degree(Graph.of_edges(_arcs(spark, d)))
    return g.edges.groupBy("src", "dst").agg(F.round(F.sum("w"), 9).alias("w"), F.count("*").alias("n"))


def _sketch(spark, d):
    return influence.build_sketch(_weighted(spark, d), R)


def q_top_influence(spark, d):
    return influence.influence(_sketch(spark, d)).orderBy(F.desc("gain"), "v").limit(10)


def q_spread(spark, d):
    g = _weighted(spark, d)
    return cascade.spread(g, cascade.top_degree_seeds(g, K), SIMULATIONS)


def q_mean_spread(spark, d):
    g = _weighted(spark, d)
    return cascade.mean_spread(g, cascade.top_degree_seeds(g, K), SIMULATIONS).select("simulations", F.round("mean", 6).alias("mean"))


def q_random_spread(spark, d):
    g = _weighted(spark, d)
    return cascade.spread(g, cascade.random_seeds(g, K), SIMULATIONS)


def _filed(spark, d) -> Graph:
    """The co-purchase graph with dense ids: what files hold. Part keys are 1..n at the driver's tables."""
    g = _copurchase(spark, d)
    return Graph(spark.range(g.vertices.agg(F.max("id")).first()[0] + 1), g.edges, True)


def q_load_bin(spark, d, two_block=False):
    path = new_path(spark, "graph") + ".bin"
    _make_folder(spark, path)
    graph_files.write_csr(_filed(spark, d), path, two_block)
    return graph_files.read_csr(spark, path, two_block).edges.select("edge_id", "src", "dst")


def _make_folder(spark, path: str) -> None:
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    store.create_dir(inside.rsplit("/", 1)[0], recursive=True)


def q_load_bin2(spark, d):
    return q_load_bin(spark, d, two_block=True)


def q_load_adj(spark, d):
    path = new_path(spark, "graph") + ".adj"
    graph_files.write_adj(_filed(spark, d), path)
    return graph_files.read_adj(spark, path).edges.select("edge_id", "src", "dst")


def q_load_edges(spark, d):
    path = new_path(spark, "pairs")
    _arcs(spark, d).select(F.concat_ws("\t", "src", "dst").alias("value")).union(spark.createDataFrame([("# arcs",)], "value string")).write.text(path)
    return graph_files.read_pairs(spark, path).groupBy("src", "dst").agg(F.count("*").alias("n"))


def q_load_weighted(spark, d):
    path = new_path(spark, "weighted")
    g = weights.by_degree(_copurchase(spark, d))
    head = spark.createDataFrame([("1000000 0",)], "value string")
    head.union(g.edges.select(F.concat_ws(" ", "src", "dst", F.round("w", 9).cast("string")).alias("value"))).write.text(path)
    return graph_files.read_weighted(spark, path).edges


def q_load_seeds(spark, d):
    path = new_path(spark, "seeds")
    g = _copurchase(spark, d)
    seeds = cascade.top_degree_seeds(g, K)
    ranked = g.edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("n")).join(seeds, "vertex", "left_semi")
    ranked = graphs.numbered(ranked.select((-F.col("n")).alias("n"), "vertex"), ["n", "vertex"], "round").select("round", "vertex")
    graph_files.write_seeds(ranked, path)
    return graph_files.read_seeds(spark, path).select("set_id", F.col("round").cast("long").alias("round"), "vertex")


def _slotted(spark, d) -> Graph:
    """The graph with repeated arcs, its arcs numbered and weighted."""
    arcs = materialize(graphs.slot_ids(_arcs(spark, d)), "slots")
    return weights.constant(Graph.of_edges(arcs), MULTI_W)


def q_multigraph(spark, d):
    g = _slotted(spark, d)
    return cascade.spread(g, cascade.top_degree_seeds(g, 2), SIMULATIONS)


def _ranked(spark, g: Graph) -> DataFrame:
    """``set_id, round, vertex``: the K vertices with most arcs as set 0, those with the largest ids as set 1."""
    n = g.edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "vertex").limit(K).select(F.lit(0).cast("long").alias("set_id"), (-F.col("n")).alias("n"), "vertex")
    last = n.orderBy(F.desc("vertex")).limit(K).select(F.lit(1).cast("long").alias("set_id"), (-F.col("vertex")).alias("n"), "vertex")
    few = top.union(last)  # 2 K rows
    return few.withColumn("round", F.row_number().over(Window.partitionBy("set_id").orderBy("n", "vertex")) - 1).select("set_id", "round", "vertex")


def q_seed_prefixes(spark, d):
    g = _weighted(spark, d)
    path = new_path(spark, "seeds")
    ranked = materialize(_ranked(spark, g), "ranked")
    for k in range(2):
        graph_files.write_seeds(ranked.where(F.col("set_id") == k), f"{path}/{k}")
    found = graph_files.read_seeds(spark, f"{path}/*")
    return cascade.evaluate_prefixes(g, found, [2, K], SIMULATIONS).withColumn("mean", F.round("mean", 6))


def q_load_knn(spark, d):
    path = new_path(spark, "knn")
    graphs.knn(_table(spark, d, "embeddings"), 5).select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)
    g = graph_files.read_graph(spark, path, "knn", k=5)
    return g.edges.crossJoin(F.broadcast(g.vertices.agg(F.count("*").alias("n"))))


def q_weight_choice(spark, d):
    """Every weight model by its name, on one graph."""
    g = _copurchase(spark, d)
    chosen = {"constant": {"w": W}, "uniform": {"low": 0.1, "high": 0.3}, "degree": {}, "in_degree": {}}
    out = None
    for name, options in chosen.items():
        e = weights.assign(g, name, **options).edges.agg(F.count("*").alias("n"), F.round(F.sum("w"), 3).alias("total")).select(F.lit(name).alias("model"), "n", "total")
        out = e if out is None else out.union(e)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "graph_copurchase": lambda s, d: graphs.copurchase(_table(s, d, "lineitem")),
    "graph_supp_part": q_supp_part,
    "graph_cust_supp": q_cust_supp,
    "graph_knn5": lambda s, d: graphs.knn(_table(s, d, "embeddings"), 5),
    "symmetrize": lambda s, d: graphs.symmetrize(_arcs(s, d)),
    "transpose": lambda s, d: graphs.transpose(_arcs(s, d)).groupBy("src", "dst").agg(F.count("*").alias("n")),
    "out_degree": lambda s, d: graphs.out_degree(_copurchase(s, d)),
    "offsets": q_offsets,
    "slot_ids": lambda s, d: graphs.slot_ids(_copurchase(s, d).edges),
    "remap_first_seen": q_remap,
    "ring_lattice": lambda s, d: graphs.ring_lattice(s, 1000, 3),
    "weights_uic": lambda s, d: weights.constant(_copurchase(s, d), W).edges.select("src", "dst", "w"),
    "weights_uniform": q_weights_uniform,
    "weights_wic": q_weights_degree,
    "weights_indegree": q_weights_in_degree,
    "live_edges": lambda s, d: influence.live_edges(_weighted(s, d), R),
    "components": lambda s, d: _sketch(s, d).all_rows().select("r", "v", "label"),
    "component_sizes": lambda s, d: influence.component_sizes(_sketch(s, d)),
    "initial_influence": lambda s, d: influence.influence(_sketch(s, d)),
    "top_influence": q_top_influence,
    "greedy_seeds": lambda s, d: select.greedy(_sketch(s, d), K),
    "greedy_lazy": lambda s, d: select.greedy_lazy(_sketch(s, d), K),
    "greedy_alpha": lambda s, d: select.greedy_alpha(_weighted(s, d), R, K, ALPHA),
    "greedy_evaluations": lambda s, d: select.lazy_evaluations(_sketch(s, d), K),
    "cascade_spread": q_spread,
    "cascade_mean": q_mean_spread,
    "cascade_random_baseline": q_random_spread,
    "cascade_multigraph": q_multigraph,
    "cascade_seed_prefixes": q_seed_prefixes,
    "weight_choice": q_weight_choice,
    "load_knn": q_load_knn,
    "load_bin": q_load_bin,
    "load_bin_two_block": q_load_bin2,
    "load_adj": q_load_adj,
    "load_edges": q_load_edges,
    "load_weighted": q_load_weighted,
    "load_seeds": q_load_seeds,
}

_P = coins.P
_IT = "it AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"
_HALF = f"{_IT}, h AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM it a JOIN it b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"
_SYM = f"{_HALF}, e AS (SELECT src, dst FROM h UNION ALL SELECT dst, src FROM h)"
_VERT = f"{_SYM}, vert AS (SELECT DISTINCT src AS id FROM e)"
_ARCS = """a AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst FROM lineitem
 JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
_DEG = f"{_VERT}, g AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src)"
_LIVE = f"{_VERT}, smp AS (SELECT r FROM range({R}) t(r)), lv AS (SELECT r, src AS u, dst AS v FROM h CROSS JOIN smp WHERE {coins.coin_sql('src', 'dst', 'r')} < {coins.threshold_sql(str(W))})"
_COMP = f"""{_LIVE}, bb AS (SELECT r, u AS a, v AS b FROM lv UNION ALL SELECT r, v, u FROM lv),
c(r, v, l) USING KEY (r, v) AS (
  SELECT r, id, id FROM vert CROSS JOIN smp
  UNION (SELECT c.r, bb.b, min(c.l) FROM c JOIN bb ON bb.r = c.r AND bb.a = c.v
         JOIN recurring.c rc ON rc.r = c.r AND rc.v = bb.b WHERE c.l < rc.l GROUP BY c.r, bb.b)),
sk AS MATERIALIZED (SELECT r, v, l AS label, count(*) OVER (PARTITION BY r, l) AS size FROM c)"""


def _greedy_sql(k: int) -> str:
    """One pair of parts for each round: the best vertex, and what its components leave uncovered."""
    parts, left, chosen = [_COMP], "sk", []
    for i in range(k):
        no = "".join(f" AND v.id NOT IN (SELECT vertex FROM s{j})" for j in chosen)
        parts.append(
            f"s{i} AS MATERIALIZED (SELECT v.id AS vertex, CAST(coalesce(sum(x.size), 0) AS BIGINT) AS gain FROM vert v LEFT JOIN {left} x ON x.v = v.id"
            f" WHERE true{no} GROUP BY v.id ORDER BY gain DESC, vertex LIMIT 1)"
        )
        parts.append(f"l{i} AS MATERIALIZED (SELECT x.* FROM {left} x WHERE NOT EXISTS (SELECT 1 FROM sk y JOIN s{i} ON y.v = s{i}.vertex WHERE y.r = x.r AND y.label = x.label))")
        left = f"l{i}"
        chosen.append(i)
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS round, vertex, gain, gain / {float(R)} AS score FROM s{i}" for i in range(k))
    return f"WITH RECURSIVE {', '.join(parts)} {rows}"


def _spread_sql(seeds: str) -> str:
    toss = coins.coin_sql("e.src", "e.dst", f"x.i + {coins.DIRECTED}")
    return f"""WITH RECURSIVE {_DEG}, sd AS ({seeds}),
x(i, v) AS (SELECT i, vertex FROM range({SIMULATIONS}) t(i) CROSS JOIN sd
            UNION SELECT x.i, e.dst FROM x JOIN e ON e.src = x.v WHERE {toss} < {coins.threshold_sql(str(W))}),
each_one AS (SELECT i, count(*) AS activated FROM x GROUP BY i)"""


_TOP = f"SELECT id AS vertex FROM g ORDER BY degree DESC, id LIMIT {K}"
_RANDOM = f"SELECT id AS vertex FROM vert ORDER BY {coins.coin_sql('id', '0', '7')}, id LIMIT {K}"
_RANKED = f"""tp AS (SELECT 0 AS set_id, id AS vertex, row_number() OVER (ORDER BY degree DESC, id) - 1 AS round FROM g),
la AS (SELECT 1 AS set_id, id AS vertex, row_number() OVER (ORDER BY id DESC) - 1 AS round FROM g),
ks AS (SELECT k FROM (VALUES (2), ({K})) t(k)),
sd AS (SELECT set_id, k, vertex FROM (SELECT * FROM tp UNION ALL SELECT * FROM la) JOIN ks ON round < k)"""
_KNN = """q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT)) AS v FROM embeddings),
u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM q),
p AS (SELECT a.vec_id AS src, b.vec_id AS dst, sum(a.x * b.x) AS dot FROM u a JOIN u b ON a.k = b.k AND a.vec_id <> b.vec_id GROUP BY 1, 2),
kn AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dot DESC, dst) AS n FROM p) WHERE n <= 5)"""
_UNIFORM = coins.coin_sql("least(src, dst) + 1", "greatest(src, dst) + 1", "0")
_SLOTS = f"WITH {_SYM} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src, dst FROM e"

ORACLES: dict[str, str] = {
    "graph_copurchase": f"WITH {_SYM} SELECT src, dst FROM e",
    "graph_supp_part": "SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem",
    "graph_cust_supp": "SELECT DISTINCT o_custkey AS src, l_suppkey + 1000000 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "graph_knn5": f"WITH {_KNN} SELECT src, dst FROM kn",
    "symmetrize": f"WITH {_ARCS} SELECT src, dst FROM a WHERE src <> dst UNION SELECT dst, src FROM a WHERE src <> dst",
    "transpose": f"WITH {_ARCS} SELECT dst AS src, src AS dst, count(*) AS n FROM a GROUP BY 1, 2",
    "out_degree": f"WITH {_DEG} SELECT id, degree FROM g",
    "offsets": f"WITH {_DEG} SELECT id, CAST(sum(degree) OVER (ORDER BY id) - degree AS BIGINT) AS \"offset\" FROM g",
    "slot_ids": _SLOTS,
    "remap_first_seen": """WITH a AS (SELECT l_orderkey * 8 + l_linenumber AS pos, l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem),
f AS (SELECT id, min(seen) AS seen FROM (SELECT 2 * pos AS seen, src AS id FROM a UNION ALL SELECT 2 * pos + 1, dst FROM a) GROUP BY id),
n AS (SELECT id, row_number() OVER (ORDER BY seen, id) - 1 AS fresh FROM f)
SELECT pos, s.fresh AS src, d.fresh AS dst FROM a JOIN n s ON s.id = a.src JOIN n d ON d.id = a.dst""",
    "ring_lattice": f"""WITH p AS (SELECT id, row_number() OVER (ORDER BY {coins.coin_sql('id', '0', '0')}, id) - 1 AS place FROM range(1000) t(id))
SELECT a.id AS src, b.id AS dst FROM p a CROSS JOIN range(1, 4) s(k) JOIN p b ON b.place = (a.place + k) % 1000""",
    "weights_uic": f"WITH {_SYM} SELECT src, dst, CAST({W} AS DOUBLE) AS w FROM e",
    "weights_uniform": f"WITH {_SYM} SELECT src, dst, round(CAST(0.1 AS DOUBLE) + {_UNIFORM} / CAST({_P} AS DOUBLE) * CAST(0.2 AS DOUBLE), 9) AS w FROM e",
    "weights_wic": f"WITH {_DEG} SELECT src, dst, round(CAST(2 AS DOUBLE) / (x.degree + y.degree), 9) AS w FROM e JOIN g x ON x.id = src JOIN g y ON y.id = dst",
    "weights_indegree": f"WITH {_ARCS}, i AS (SELECT dst, count(*) AS n FROM a GROUP BY dst) SELECT src, a.dst, round(count(*) / CAST(any_value(i.n) AS DOUBLE), 9) AS w, count(*) AS n FROM a JOIN i ON i.dst = a.dst GROUP BY src, a.dst",
    "live_edges": f"WITH {_LIVE} SELECT r, u, v FROM lv",
    "components": f"WITH RECURSIVE {_COMP} SELECT r, v, label FROM sk",
    "component_sizes": f"WITH RECURSIVE {_COMP} SELECT r, label, count(*) AS size FROM sk GROUP BY r, label",
    "initial_influence": f"WITH RECURSIVE {_COMP} SELECT v, CAST(sum(size) AS BIGINT) AS gain FROM sk GROUP BY v",
    "top_influence": f"WITH RECURSIVE {_COMP} SELECT v, CAST(sum(size) AS BIGINT) AS gain FROM sk GROUP BY v ORDER BY gain DESC, v LIMIT 10",
    "greedy_seeds": _greedy_sql(K),
    "greedy_lazy": _greedy_sql(K),
    "greedy_alpha": _greedy_sql(K),
    "cascade_spread": f"{_spread_sql(_TOP)} SELECT i, activated FROM each_one",
    "cascade_mean": f"{_spread_sql(_TOP)} SELECT CAST({SIMULATIONS} AS BIGINT) AS simulations, round(sum(activated) / CAST({SIMULATIONS} AS DOUBLE), 6) AS mean FROM each_one",
    "cascade_random_baseline": f"{_spread_sql(_RANDOM)} SELECT i, activated FROM each_one",
    "cascade_multigraph": f"""WITH RECURSIVE {_ARCS}, e AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS slot, src, dst FROM a),
sd AS (SELECT src AS vertex FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 2),
x(i, v) AS (SELECT i, vertex FROM range({SIMULATIONS}) t(i) CROSS JOIN sd
            UNION SELECT x.i, e.dst FROM x JOIN e ON e.src = x.v WHERE {coins.coin_sql('e.slot', '0', f'x.i + {coins.DIRECTED}')} < {coins.threshold_sql(str(MULTI_W))})
SELECT i, count(*) AS activated FROM x GROUP BY i""",
    "cascade_seed_prefixes": f"""WITH RECURSIVE {_DEG}, {_RANKED},
x(set_id, k, i, v) AS (SELECT set_id, k, i, vertex FROM range({SIMULATIONS}) t(i) CROSS JOIN sd
            UNION SELECT x.set_id, x.k, x.i, e.dst FROM x JOIN e ON e.src = x.v WHERE {coins.coin_sql('e.src', 'e.dst', f'x.i + {coins.DIRECTED}')} < {coins.threshold_sql(str(W))})
SELECT CAST(set_id AS BIGINT) AS set_id, k, CAST({SIMULATIONS} AS BIGINT) AS simulations, round(count(*) / CAST({SIMULATIONS} AS DOUBLE), 6) AS mean FROM x GROUP BY set_id, k""",
    "weight_choice": f"""WITH {_DEG}, wt AS (SELECT 'constant' AS model, CAST({W} AS DOUBLE) AS w FROM e
UNION ALL SELECT 'uniform', CAST(0.1 AS DOUBLE) + {_UNIFORM} / CAST({_P} AS DOUBLE) * CAST(0.2 AS DOUBLE) FROM e
UNION ALL SELECT 'degree', CAST(2 AS DOUBLE) / (y.degree + z.degree) FROM e JOIN g y ON y.id = src JOIN g z ON z.id = dst
UNION ALL SELECT 'in_degree', CAST(1 AS DOUBLE) / degree FROM e JOIN g ON g.id = dst)
SELECT model, count(*) AS n, round(sum(w), 3) AS total FROM wt GROUP BY model""",
    "load_knn": f"WITH {_KNN} SELECT src, dst, (SELECT count(*) // 5 FROM kn) AS n FROM kn",
    "load_bin": _SLOTS,
    "load_bin_two_block": _SLOTS,
    "load_adj": _SLOTS,
    "load_edges": f"WITH {_ARCS} SELECT src, dst, count(*) AS n FROM a GROUP BY 1, 2",
    "load_weighted": f"WITH {_DEG} SELECT src, dst, round(CAST(2 AS DOUBLE) / (x.degree + y.degree), 9) AS w FROM e JOIN g x ON x.id = src JOIN g y ON y.id = dst",
    "load_seeds": f"WITH {_DEG} SELECT CAST(0 AS BIGINT) AS set_id, row_number() OVER (ORDER BY degree DESC, id) - 1 AS round, id AS vertex FROM g ORDER BY degree DESC, id LIMIT {K}",
}
