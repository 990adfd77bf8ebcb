"""Command line: ``python -m driftline seeds GRAPH`` and ``python -m driftline spread GRAPH SEEDS``."""

from __future__ import annotations

import argparse

from driftline.plans.run import SELECTORS, Options, choose_seeds, evaluate_file
from driftline.sources.graph_files import FORMATS


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="driftline", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    seeds, spread = commands.add_parser("seeds", help="choose seeds"), commands.add_parser("spread", help="simulate seed sets")
    for p in (seeds, spread):
        p.add_argument("graph")
        p.add_argument("--format", choices=FORMATS, help="by default as the file's name tells")
        p.add_argument("--weight", default="degree", choices=["constant", "uniform", "degree", "in_degree"])
        p.add_argument("--option", action="append", default=[], metavar="NAME=VALUE", help="of the weight model: w, or low and high")
    seeds.add_argument("-k", type=int, default=100)
    seeds.add_argument("-R", "--samples", type=int, default=256)
    seeds.add_argument("--selector", default="greedy", choices=SELECTORS)
    seeds.add_argument("--alpha", type=float, default=1.0)
    seeds.add_argument("--knn", type=int, help="arcs of each vertex in a knn file")
    spread.add_argument("seeds")
    spread.add_argument("-k", type=int, action="append", help="how many seeds of each set; may be repeated (100)")
    spread.add_argument("--simulations", type=int, default=2000)
    return out


def main(arguments: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    a = parser().parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    own = tuple((n, float(v)) for n, v in (x.split("=", 1) for x in a.option))
    if a.command == "seeds":
        seeds, report = choose_seeds(spark, a.graph, Options(a.k, a.samples, a.weight, own, a.selector, a.alpha), a.format, a.knn)
        for r in report.collect():
            print(f"{r['step']} time: {r['seconds']:.3f}")
        rows = seeds.orderBy("round").collect()
        print(f"influence: {sum(r['score'] for r in rows):.5f}")
        print("seeds:", *(r["vertex"] for r in rows))
    else:
        found = evaluate_file(spark, a.graph, a.seeds, a.k or [100], a.simulations, Options(weight=a.weight, weight_options=own), a.format)
        for r in found.orderBy("set_id", "k").collect():
            print(f"set {r['set_id']} k {r['k']} influence: {r['mean']:.5f}")


if __name__ == "__main__":
    main()
