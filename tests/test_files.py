import struct

import pytest

from driftline.operators.graph import Graph
from driftline.sources import graph_files

ARCS = [(0, 1), (0, 2), (1, 0), (2, 0), (3, 4), (4, 3)]


def arcs(g):
    return sorted((r["src"], r["dst"]) for r in g.edges.select("src", "dst").collect())


@pytest.fixture
def bin5(tmp_path):
    data = struct.pack("<QQQ", 5, 6, 96) + struct.pack("<6Q", 0, 2, 3, 4, 5, 6) + struct.pack("<6I", 1, 2, 0, 0, 4, 3)
    assert len(data) == 96
    path = tmp_path / "g.bin"
    path.write_bytes(data)
    return path


def test_read_bin(spark, bin5, tmp_path):
    g = graph_files.read_graph(spark, str(bin5), "bin")
    assert arcs(g) == ARCS and g.vertices.count() == 5
    reader = graph_files.CsrReader({"path": str(bin5), "vertices_per_partition": "2"})
    got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.select(["src", "dst"]).to_pylist()]
    assert got == ARCS and len(reader.partitions()) == 3
    (tmp_path / "long.bin").write_bytes(bin5.read_bytes() + b"x")
    with pytest.raises(ValueError):
        graph_files.CsrReader({"path": str(tmp_path / "long.bin")}).heads()
    (tmp_path / "two.bin").write_bytes(bin5.read_bytes() * 2)
    assert arcs(graph_files.read_graph(spark, str(tmp_path / "two.bin"), "bin2")) == ARCS


def test_write_bin(spark, bin5, tmp_path):
    g = graph_files.read_graph(spark, str(bin5), "bin")
    graph_files.write_csr(g, str(tmp_path / "out.bin"))
    assert (tmp_path / "out.bin").read_bytes() == bin5.read_bytes()


def test_adj(spark, tmp_path):
    path = tmp_path / "g.adj"
    path.write_text("AdjacencyGraph 5 6 0 2 3 4 5\n1 2 0 0 4 3\n")
    assert arcs(graph_files.read_graph(spark, str(path), "adj")) == ARCS
    # vertex 1 has no arcs, nor have the last ones
    path.write_text("AdjacencyGraph\n5\n3\n0\n2\n2\n3\n3\n1\n2\n0\n")
    assert arcs(graph_files.read_graph(spark, str(path), "adj")) == [(0, 1), (0, 2), (2, 0)]
    g = Graph(spark.range(5), spark.createDataFrame(ARCS, "src long, dst long"))
    graph_files.write_adj(g, str(tmp_path / "out"))
    assert arcs(graph_files.read_graph(spark, str(tmp_path / "out"), "adj")) == ARCS


def test_text_formats(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# made by hand\n0 1\n1\t2\n")
    assert arcs(graph_files.read_graph(spark, str(tmp_path / "e.txt"), "edges")) == [(0, 1), (1, 2)]
    assert arcs(graph_files.read_graph(spark, str(tmp_path / "e.txt"), "edges", symmetric=True)) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    (tmp_path / "k.txt").write_text("0 1\n1 0\n2 0\n")
    assert graph_files.read_graph(spark, str(tmp_path / "k.txt"), "knn", k=1).vertices.count() == 3
    (tmp_path / "w.txt").write_text("3 2\n0 1 0.5\n1 2 0.25\n")
    g = graph_files.read_graph(spark, str(tmp_path / "w.txt"), "weighted")
    assert sorted(r["w"] for r in g.edges.collect()) == [0.25, 0.5] and g.vertices.count() == 3
    with pytest.raises(ValueError):
        graph_files.read_graph(spark, str(tmp_path / "e.txt"), "other")


def test_seeds(spark, tmp_path):
    (tmp_path / "s.txt").write_text("noise\nseeds: 5 9 12 \nseeds: 3\n")
    seeds = graph_files.read_seeds(spark, str(tmp_path / "s.txt"))
    assert sorted(tuple(r) for r in seeds.collect()) == [(0, 0, 5), (0, 1, 9), (0, 2, 12), (1, 0, 3)]
    assert [r["vertex"] for r in graph_files.prefix_of(seeds, 0, 2).collect()] == [5, 9]
    assert graph_files.seeds_line(seeds.where("set_id = 0")).first()["value"] == "seeds: 5 9 12"


def test_formats_by_name(spark, bin5, tmp_path):
    assert arcs(graph_files.read_graph(spark, str(bin5))) == ARCS
    marked = tmp_path / "g_sym.bin"
    marked.write_bytes(bin5.read_bytes())
    assert graph_files.read_graph(spark, str(marked)).symmetric and not graph_files.read_graph(spark, str(marked), "bin").symmetric
    with pytest.raises(ValueError):
        graph_files.read_graph(spark, str(tmp_path / "e.txt"))
    assert graph_files.format_of("s3://x/synthetic") == "synthetic"


def test_text_to_binary(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# pairs\n0 1\n1 2\n2 2\n0 1\n")
    graph_files.convert_text(spark, str(tmp_path / "e.txt"), str(tmp_path / "e.bin"), str(tmp_path / "e_sym.bin"))
    assert arcs(graph_files.read_graph(spark, str(tmp_path / "e.bin"))) == [(0, 1), (0, 1), (1, 2), (2, 2)]
    assert arcs(graph_files.read_graph(spark, str(tmp_path / "e_sym.bin"))) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    (tmp_path / "k.txt").write_text("0 1\n1 0\n2 0\n3 1\n")
    graph_files.convert_text(spark, str(tmp_path / "k.txt"), str(tmp_path / "k.bin"), str(tmp_path / "k_sym.bin"), k=1)
    assert graph_files.read_graph(spark, str(tmp_path / "k.bin")).vertices.count() == 4


def test_from_file_to_seeds_and_spread(spark, bin5, tmp_path, capsys):
    from driftline.__main__ import main
    from driftline.operators import influence, weights
    from driftline.plans.run import Options, choose_seeds

    seeds, report = choose_seeds(spark, str(bin5), Options(k=2, samples=2, weight="constant", weight_options=(("w", 1.0),)))
    assert sorted(tuple(r)[:3] for r in seeds.collect()) == [(0, 0, 6), (1, 3, 4)]
    assert {r["step"] for r in report.collect()} == {"graph", "sketch construction", "seed selection", "total"}
    main(["seeds", str(bin5), "-k", "2", "-R", "2", "--weight", "constant", "--option", "w=1", "--selector", "lazy"])
    said = capsys.readouterr().out.splitlines()
    assert said[-2:] == ["influence: 5.00000", "seeds: 0 3"] and said[0].startswith("graph time: ")
    (tmp_path / "s.txt").write_text("seeds: 0 3\nseeds: 4\n")
    main(["spread", str(bin5), str(tmp_path / "s.txt"), "-k", "1", "-k", "2", "--simulations", "2", "--weight", "constant", "--option", "w=1"])
    assert capsys.readouterr().out.splitlines() == ["set 0 k 1 influence: 3.00000", "set 0 k 2 influence: 5.00000", "set 1 k 1 influence: 2.00000", "set 1 k 2 influence: 2.00000"]
    g = weights.constant(graph_files.read_graph(spark, str(bin5), symmetric=True), 1.0)
    graph_files.write_samples(influence.live_edges(g, 2), str(tmp_path / "live"))
    assert spark.read.parquet(str(tmp_path / "live")).count() == 6
    graph_files.write_labels(influence.build_sketch(g, 2).rows, str(tmp_path / "labels"))
    assert spark.read.option("header", True).csv(str(tmp_path / "labels")).count() == 10
