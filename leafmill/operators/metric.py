"""Exact nearest neighbours within a limit, by pivots and the triangle inequality.

Two vectors within the limit differ by at most the limit in their distance to any pivot. So the distance to the first pivot, in cells
`CELLS` limits wide, is an equality key: a query is sent to the one or two cells that its limit reaches, never to a whole group. The other pivots rule
out pairs within a cell; as keys they would multiply the vectors that are sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import geom as G

CELLS = 4


def _to_pivots(v: Column, pivots: list[list[float]]) -> list[Column]:
    return [G.mean_abs_distance(v, F.array(*[F.lit(float(x)) for x in p])) for p in pivots]


def candidates(queries: DataFrame, index: DataFrame, limit: float, group: list[str], pivots: list[list[float]]) -> DataFrame:
    """Pairs (group, `q` and `x` structs) that no pivot rules out. Both sides: group columns and `v`; vectors of another size than the pivots match nothing."""
    names = [f"_p{k}" for k in range(len(pivots))]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*[c for c in df.columns if c not in group]).alias(name)
        return df.where(F.size("v") == len(pivots[0])).select(*group, row, *[d.alias(f"{name}{p}") for d, p in zip(_to_pivots(F.col("v"), pivots), names, strict=True)])

    cell = lambda d: F.floor(d / (CELLS * limit))
    q, x = keyed(queries, "q"), keyed(index, "x")
    q = q.withColumn("_cell", F.explode(F.sequence(cell(F.col("q_p0") - limit), cell(F.col("q_p0") + limit))))
    x = x.withColumn("_cell", cell(F.col("x_p0")))
    near = F.lit(True)
    for p in names:
        near = near & (F.abs(F.col(f"q{p}") - F.col(f"x{p}")) <= limit)
    return q.join(x, [*group, "_cell"]).where(near).select(*group, "q", "x")


def nearest(queries: DataFrame, index: DataFrame, limit: float, group: list[str], pivots: list[list[float]], query_id: str, order: list[str]) -> DataFrame:
    """group, query_id, distance, nearest (a struct of the index row): the nearest within the limit; of equals the least by `order`."""
    d = G.mean_abs_distance(F.col("q.v"), F.col("x.v"))
    pairs = candidates(queries, index, limit, group, pivots).withColumn("d", d).where(F.col("d") <= limit)
    first = F.min_by(F.struct("d", "x"), F.struct("d", *[F.col(f"x.{c}") for c in order]))
    return pairs.groupBy(*group, F.col(f"q.{query_id}").alias(query_id)).agg(first.alias("m")).select(*group, query_id, F.col("m.d").alias("distance"), F.col("m.x").alias("nearest"))
