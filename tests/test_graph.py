import pytest
from pyspark.sql import functions as F

from driftline.operators import cascade, graph, influence, select, weights
from driftline.operators.components import connected_components
from driftline.operators.graph import Graph

CERTAIN = [(0, 1), (1, 2), (0, 2), (3, 4)]


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def symmetric(spark, edges, n, w):
    e = graph.symmetrize(spark.createDataFrame(edges, "src long, dst long"))
    return weights.constant(Graph(spark.range(n), e, True), w)


def test_symmetrize_and_transpose(spark):
    e = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (1, 2), (1, 2)], "src long, dst long")
    assert rows(graph.symmetrize(e)) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert rows(graph.transpose(e)) == [(0, 1), (1, 0), (1, 1), (2, 1), (2, 1)]


def test_remap(spark):
    e = spark.createDataFrame([(0, 100, 7), (1, 7, 42), (2, 100, 42)], "pos long, src long, dst long")
    assert rows(graph.remap_first_seen(e), "src", "dst") == [(0, 1), (0, 2), (1, 2)]


def test_offsets_slots_and_ring(spark):
    g = Graph(spark.range(5), spark.createDataFrame([(0, 1), (0, 2), (1, 0), (2, 0), (3, 4), (4, 3)], "src long, dst long"))
    assert rows(graph.offsets(g)) == [(0, 0), (1, 2), (2, 3), (3, 4), (4, 5)]
    assert [r[2] for r in rows(graph.slot_ids(g.edges))] == list(range(6))
    ring = graph.ring_lattice(spark, 5, 2)
    assert {r["src"]: r["count"] for r in ring.groupBy("src").count().collect()} == {i: 2 for i in range(5)}
    assert graph.symmetrize(ring).count() == 20


def test_weights(spark):
    path = symmetric(spark, [(0, 1), (1, 2)], 3, 1.0)
    plain = Graph(path.vertices, path.edges.select("src", "dst"), True)
    assert {round(r[2], 9) for r in rows(weights.by_degree(plain).edges, "src", "dst", "w")} == {round(2 / 3, 9)}
    arcs = Graph(spark.range(3), spark.createDataFrame([(0, 2), (1, 2), (2, 0)], "src long, dst long"))
    assert rows(weights.by_in_degree(arcs).edges, "src", "dst", "w") == [(0, 2, 0.5), (1, 2, 0.5), (2, 0, 1.0)]
    u = {(r[0], r[1]): r[2] for r in rows(weights.uniform(plain, 0.1, 0.3).edges, "src", "dst", "w")}
    assert u[0, 1] == u[1, 0] and all(0.1 <= x <= 0.3 for x in u.values())
    with pytest.raises(ValueError):
        weights.assign(plain, "other")


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    out = connected_components(spark.createDataFrame(path, "src long, dst long"))
    assert rows(out) == [(i, 0) for i in range(201)] + [(1000 + i, 1000) for i in range(50)]
    assert rows(connected_components(spark.createDataFrame([], "src long, dst long"))) == []


def test_certain_impossible_and_more_seeds_than_vertices(spark):
    s = influence.build_sketch(symmetric(spark, CERTAIN, 6, 1.0), 4)
    labels = rows(s.all_rows().where("r = 0"), "v", "label", "size")
    assert labels == [(0, 0, 3), (1, 0, 3), (2, 0, 3), (3, 3, 2), (4, 3, 2), (5, 5, 1)]
    want = [(0, 0, 12), (1, 3, 8), (2, 5, 4), (3, 1, 0), (4, 2, 0), (5, 4, 0)]
    assert rows(select.greedy(s, 10), "round", "vertex", "gain") == want
    assert rows(select.greedy_lazy(s, 10, batch=1), "round", "vertex", "gain") == want
    assert select.total_score(select.greedy(s, 3)).first()["score"] == 6
    none = influence.build_sketch(symmetric(spark, CERTAIN, 6, 0.0), 4)
    assert rows(select.greedy(none, 3), "round", "vertex", "gain") == [(0, 0, 4), (1, 1, 4), (2, 2, 4)]


def test_alpha_and_lazy_change_nothing(spark):
    edges = [(i, (i * 7 + 3) % 30) for i in range(30)] + [(i, (i * 5 + 1) % 30) for i in range(30)]
    g = symmetric(spark, edges, 30, 0.3)
    s = influence.build_sketch(g, 4)
    want = rows(select.greedy(s, 4))
    gains = [r[2] for r in want]
    assert gains == sorted(gains, reverse=True)
    assert rows(select.greedy_lazy(s, 4, batch=2)) == want
    assert rows(select.greedy_alpha(g, 4, 4, 0.3, batch=8)) == want


def test_spread(spark):
    arcs = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src long, dst long, w double")
    g = Graph(spark.range(3), arcs)
    assert rows(cascade.spread(g, cascade.seeds_of(spark, [0]), 2)) == [(0, 3), (1, 3)]
    assert rows(cascade.spread(g, cascade.seeds_of(spark, [2]), 1)) == [(0, 1)]
    assert rows(cascade.spread(g, cascade.seeds_of(spark, [0, 0]), 1)) == [(0, 3)]
    assert cascade.mean_spread(g, cascade.seeds_of(spark, [0]), 4).first()["mean"] == 3
    assert cascade.random_seeds(g, 2).count() == 2


def test_coins_are_alike_in_both_engines(spark):
    import duckdb

    from driftline.functions.coins import coin, coin_sql

    q = "SELECT CAST(sum({c}) AS BIGINT) FROM (SELECT a.i AS u, b.i AS v FROM range(100) a(i) CROSS JOIN range(100) b(i)) t"
    want = duckdb.sql(q.format(c=coin_sql("u", "v", "3"))).fetchall()[0][0]
    t = spark.range(100).toDF("u").crossJoin(spark.range(100).toDF("v"))
    assert t.agg(F.sum(coin(F.col("u"), F.col("v"), F.lit(3).cast("long")))).first()[0] == want
    assert t.agg(F.expr(f"sum({coin_sql('u', 'v', '3')})")).first()[0] == want
    assert abs(want / 10_000 / 2**31 - 0.5) < 0.02


def test_parallel_arcs_toss_independently(spark):
    arcs = spark.createDataFrame([(0, 1, 0.5, i) for i in range(20)], "src long, dst long, w double, edge_id long")
    g = Graph(spark.range(2), arcs)
    mean = cascade.mean_spread(g, cascade.seeds_of(spark, [0]), 200).first()["mean"]
    assert mean > 1.99  # one coin for all would give 1.5


def test_many_hops_keep_the_plan_small(spark):
    n = 30
    g = Graph(spark.range(n), spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)], "src long, dst long, w double"))
    out = cascade.spread(g, cascade.seeds_of(spark, [0]), 1)
    assert rows(out) == [(0, n)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= cascade.COMPACT


def test_prefixes_of_many_sets(spark):
    g = Graph(spark.range(6), spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0)], "src long, dst long, w double"))
    sets = spark.createDataFrame([(0, 0, 0), (0, 1, 3), (1, 0, 5), (1, 1, 1)], "set_id long, round int, vertex long")
    got = rows(cascade.evaluate_prefixes(g, sets, [1, 2, 9], 2), "set_id", "k", "mean")
    assert got == [(0, 1, 3.0), (0, 2, 5.0), (0, 9, 5.0), (1, 1, 1.0), (1, 2, 3.0), (1, 9, 3.0)]


def lazily(components, n, samples, k, batch):
    """Vertices newly evaluated in each round, from the components as plain sets."""
    def gain(v, covered):
        return sum(len(c) for c in components if v in c and id(c) not in covered) + (samples - sum(v in c for c in components)) * (v not in covered)

    order = sorted(range(n), key=lambda v: (-gain(v, set()), v))
    known, counts, seeds, covered = 0, [], [], set()
    for _ in range(min(k, n)):
        size, begun = batch, known
        while True:
            want = min(max(size + len(seeds) + 1, 2 * known), n) if known < size + len(seeds) + 1 else known
            known = max(known, want)
            best = min(((-gain(v, covered), v) for v in order[:known] if v not in seeds), default=None)
            last = order[known - 1]
            if known >= n or best is not None and best <= (-gain(last, set()), last):
                break
            size *= 2
        counts.append(known - begun)
        if best is None:
            break
        seeds.append(best[1])
        covered |= {id(c) for c in components if best[1] in c} | {best[1]}
    return counts, seeds


def test_evaluations_against_plain_sets(spark):
    edges = [(i, (i * 7 + 3) % 40) for i in range(40)]
    s = influence.build_sketch(symmetric(spark, edges, 40, 0.2), 4)
    parts = {}
    for r in s.rows.collect():
        parts.setdefault((r["r"], r["label"]), set()).add(r["v"])
    counts, seeds = lazily(list(parts.values()), 40, 4, 5, 2)
    assert [r[1] for r in rows(select.lazy_evaluations(s, 5, batch=2))] == counts
    assert [r[1] for r in rows(select.greedy_lazy(s, 5, batch=2), "round", "vertex")] == seeds


def test_equal_gains_need_few_evaluations(spark):
    s = influence.build_sketch(symmetric(spark, [(2 * i, 2 * i + 1) for i in range(200)], 400, 1.0), 2)
    counts = [r[1] for r in rows(select.lazy_evaluations(s, 4, batch=8))]
    assert sum(counts) <= 32
    assert rows(select.greedy_lazy(s, 4, batch=8)) == rows(select.greedy(s, 4))
