"""Cells addressed by (i, j, k): boxes, faces, owners, corners."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.joins import nearest
from terrane.plans.storage import written


def ordinal(i: Column, j: Column, k: Column, nx: int, ny: int) -> Column:
    """Place of a cell, i fastest (0-based)."""
    return i + nx * (j + ny * k)


def address(cell: Column, nx: int, ny: int) -> tuple[Column, Column, Column]:
    """(i, j, k) of a place."""
    return cell % nx, F.floor(cell / nx) % ny, F.floor(cell / (nx * ny))


def grid(spark, nx: int, ny: int, nz: int) -> DataFrame:
    """All cells: cell_id, i, j, k."""
    i, j, k = address(F.col("id"), nx, ny)
    return spark.range(nx * ny * nz).select(F.col("id").alias("cell_id"), i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"))


def broadcast_axes(cells: DataFrame, axes: dict[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """Axis vectors (DXV, DYV, DZV) as a value of each cell; vectors are short and become literals."""
    out = cells
    for name, (axis, values) in axes.items():
        out = out.withColumn(name, F.get(F.array(*[F.lit(float(v)) for v in values]), F.col(axis)))
    return out


@dataclass(frozen=True)
class BoxStep:
    """COPY, MULTIPLY, EQUALS or ADD on one attribute in a box of inclusive bounds; axes that aren't named are whole."""

    action: str
    target: str
    value: float | str
    box: dict[str, tuple[int, int]]


def apply_boxes(df: DataFrame, steps: Sequence[BoxStep]) -> DataFrame:
    """Steps in the order of the deck; each sees what the ones before did."""
    state: dict[str, Column] = {}
    now = lambda c: state.get(c, F.col(c))
    for s in steps:
        inside = F.lit(True)
        for axis, (a, b) in s.box.items():
            inside = inside & F.col(axis).between(a, b)
        old = now(s.target)
        new = {"COPY": lambda s=s: now(s.value), "EQUALS": lambda s=s: F.lit(s.value), "MULTIPLY": lambda s=s, o=old: o * s.value, "ADD": lambda s=s, o=old: o + s.value}[s.action]()
        state[s.target] = F.when(inside, new).otherwise(old)
    return df.withColumns(state)


def with_active(df: DataFrame, poro: str, volume: str, ntg: str, minpv: float, active: str = "active") -> DataFrame:
    """Cells with too little pore volume are inactive."""
    return df.withColumn(active, F.coalesce(F.col(active), F.lit(True)) & (F.col(poro) * F.col(volume) * F.coalesce(F.col(ntg), F.lit(1.0)) >= minpv))


def strip_inactive(values: DataFrame, cells: DataFrame, key: str = "cell_id", active: str = "active") -> DataFrame:
    return values.join(cells.filter(active).select(key), key, "left_semi")


def pad_inactive(values: DataFrame, cells: DataFrame, columns: Sequence[str], fill: float = 0.0, key: str = "cell_id") -> DataFrame:
    """Every cell, absent values filled."""
    return cells.select(key).join(values, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in columns})


def neighbours(cells: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Each cell with each of its places ±1 along an axis: d_<axis> and n_<axis>."""
    offsets = [[(1 if a == b else 0) * s for b in axes] for a in axes for s in (-1, 1)]
    o = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d_{a}") for a, v in zip(axes, row, strict=True)]) for row in offsets]))
    x = cells.select(*cells.columns, o.alias("__o"))
    return x.select(*cells.columns, *[F.col(f"__o.d_{a}").alias(f"d_{a}") for a in axes], *[(F.col(a) + F.col(f"__o.d_{a}")).alias(f"n_{a}") for a in axes])


def boundary_faces(cells: DataFrame, axes: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """Faces whose neighbour is off the grid or absent from ``cells``."""
    there = cells.select(*[F.col(a).alias(f"n_{a}") for a in axes])
    return neighbours(cells, axes).join(there, [f"n_{a}" for a in axes], "left_anti")


def owners(cells: DataFrame, seeds: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Breadth-first owner and hops of each cell from the seeds (axes, owner); of owners that are as near, the least.

    A frontier a hop, each written; it ends when no cell is reached any more. A step leads one
    hop back, aside or on, so it is held against the last two frontiers only. Cells that no
    seed reaches get the seed nearest by place, with hops -1; with no seed at all that is an error.
    """
    before, frontier = None, written(seeds.select(*axes, "owner").withColumn("hops", F.lit(0)))
    starts, reached = frontier, [frontier]
    while not frontier.isEmpty():
        step = neighbours(frontier.select(*axes, "owner"), axes).select(*[F.col(f"n_{a}").alias(a) for a in axes], "owner")
        known = frontier.select(*axes) if before is None else frontier.select(*axes).unionByName(before.select(*axes))
        new = step.join(cells.select(*axes), list(axes), "left_semi").join(known, list(axes), "left_anti")
        before, frontier = frontier, written(new.groupBy(*axes).agg(F.min("owner").alias("owner")).withColumn("hops", F.lit(len(reached))))
        reached.append(frontier)
    done = reduce(DataFrame.unionByName, reached)
    left = written(cells.select(*axes).distinct().join(done.select(*axes), list(axes), "left_anti"))
    if left.isEmpty():
        return done
    if starts.isEmpty():
        raise ValueError("no seeds to own the cells")
    far = nearest(left, starts, "owner", axes, "__near").select(*axes, F.col("__near").alias("owner"), F.lit(-1).alias("hops"))
    return done.unionByName(far)


def corner_points(cells: DataFrame, dx: str = "dx", dy: str = "dy", dz: str = "dz") -> DataFrame:
    """Eight corners of each orthogonal cell (x0, y0, z0 its lowest corner): cell_id, slot, x, y, z; i fastest, then j, then k."""
    slots = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(s & 1).alias("a"), F.lit(s >> 1 & 1).alias("b"), F.lit(s >> 2).alias("c")) for s in range(8)]))
    x = cells.select("cell_id", "x0", "y0", "z0", dx, dy, dz, slots.alias("s"))
    return x.select("cell_id", F.col("s.slot").alias("slot"), (F.col("x0") + F.col("s.a") * F.col(dx)).alias("x"), (F.col("y0") + F.col("s.b") * F.col(dy)).alias("y"), (F.col("z0") + F.col("s.c") * F.col(dz)).alias("z"))


def no_flow_faces(cells: DataFrame, near: float = 1.0) -> DataFrame:
    """Cells whose side lies within ``near`` of the bounding box of the grid: cell_id, axis, side."""
    sides = [(a, s) for a in "xyz" for s in (-1, 1)]
    edge = lambda a, s: F.col(f"c{a}") + s * F.col(f"l{a}") / 2
    box = cells.agg(*[(F.min if s < 0 else F.max)(edge(a, s)).alias(f"__{a}{s}") for a, s in sides])
    x = cells.crossJoin(F.broadcast(box))
    hits = F.filter(F.array(*[F.when(F.abs(edge(a, s) - F.col(f"__{a}{s}")) <= near, F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side"))) for a, s in sides]), lambda v: v.isNotNull())
    return x.select("cell_id", F.explode(hits).alias("f")).select("cell_id", "f.axis", "f.side")
