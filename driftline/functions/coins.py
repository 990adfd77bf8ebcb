"""Deterministic coins: the same integer arithmetic as text for Spark SQL and for a second engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coins' modulus, a Mersenne prime: squares of residues fit into 64 bits.
P = 2_147_483_647
#: Added to the number of a simulation, so that directed coins are independent of the samples'.
DIRECTED = 100_000


def coin_sql(u: str, v: str, r: str) -> str:
    """SQL for a value in 0..P-1 that hangs on u, v and r alone (integers, not negative)."""
    x0 = f"((({u}) * 48271 + 11) % {P} * 69621 + ({v}) * 16807 + 7) % {P}"
    x1 = f"(({x0}) * ({x0}) + 40692 * (({r}) + 1) + 13) % {P}"
    x2 = f"(({x1}) * ({x1}) + ({x0}) + 1) % {P}"
    return f"(({x2}) * ({x2}) + ({x1}) + 1) % {P}"


def threshold_sql(w: str) -> str:
    """SQL for the number of coin values that are live at probability w."""
    return f"CAST(floor(({w}) * {P}.0) AS BIGINT)"


def undirected_sql(u: str, v: str, r: str) -> str:
    return coin_sql(f"least({u}, {v})", f"greatest({u}, {v})", r)


def coin(u: Column, v: Column, r: Column) -> Column:
    """As :func:`coin_sql`, for columns."""
    p = F.lit(P).cast("long")
    x0 = ((u * 48271 + 11) % p * 69621 + v * 16807 + 7) % p
    x1 = (x0 * x0 + (r + 1) * 40692 + 13) % p
    x2 = (x1 * x1 + x0 + 1) % p
    return (x2 * x2 + x1 + 1) % p


def threshold(w: Column) -> Column:
    return F.floor(w * F.lit(float(P))).cast("long")
