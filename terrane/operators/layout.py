"""Geometry of cells, faults, aquifers and tracks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.plans.shipping import ship

#: Corner slots of a cell's faces (slot = i + 2 j + 4 k).
FACE_SLOTS = {"X": (1, 3, 5, 7), "X-": (0, 2, 4, 6), "Y": (2, 3, 6, 7), "Y-": (0, 1, 4, 5), "Z": (4, 5, 6, 7), "Z-": (0, 1, 2, 3)}


def fault_faces(faults: DataFrame) -> DataFrame:
    """name, i, j, k, face and corner slots of fault rows (name, i1..k2, face; 1-based inclusive); ranges may be swapped."""
    span = lambda a: F.explode(F.sequence(F.least(f"{a}1", f"{a}2"), F.greatest(f"{a}1", f"{a}2")))
    x = faults.select("*", span("i").alias("i")).select("*", span("j").alias("j")).select("*", span("k").alias("k"))
    slots = F.lit(None).cast("array<int>")
    for face, own in FACE_SLOTS.items():
        slots = F.when(F.upper("face") == face, F.array(*[F.lit(s) for s in own])).otherwise(slots)
    return x.select("name", (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), (F.col("k") - 1).alias("k"), F.upper("face").alias("face"), slots.alias("slots"))


def in_boxes(cells: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Cells (0-based) inside each box (key, i1..k2; 1-based inclusive): aquifer connections.

    Boxes are written out as addresses, so that cells meet them by equality at any number of boxes.
    """
    spread = boxes
    for a in "ijk":
        spread = spread.filter(F.col(f"{a}1") <= F.col(f"{a}2")).withColumn(a, F.explode(F.sequence(F.col(f"{a}1") - 1, F.col(f"{a}2") - 1)))
    return cells.join(spread.select(key, *"ijk"), list("ijk")).select(key, "cell_id")


def base_zero(df: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Addresses counted from 0: if all lie in 1 to the dimension they are counted from 1. Others are an error."""
    g = df.agg(*[F.min(a).alias(f"lo_{a}") for a in dims], *[F.max(a).alias(f"hi_{a}") for a in dims]).first()
    if all(g[f"lo_{a}"] is None for a in dims):
        return df
    one = all(g[f"lo_{a}"] >= 1 and g[f"hi_{a}"] <= n for a, n in dims.items())
    if not one and any(g[f"lo_{a}"] < 0 or g[f"hi_{a}"] >= n for a, n in dims.items()):
        raise ValueError("an address lies outside the grid")
    return df.withColumns({a: F.col(a) - 1 for a in dims}) if one else df


def local_frames(cells: DataFrame) -> DataFrame:
    """cell_id, lengths lx, ly, lz and the frame (9 numbers, rows i, j, k) of cells (corners: 24 numbers).

    Mean edges along i, j, k; i stays, j is made normal to it, k normal to both and turned to the mean edge.
    """
    ship(cells.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["corners"].tolist(), float).reshape(-1, 2, 2, 2, 3)  # k, j, i
            edge = np.stack([(x[:, :, :, 1] - x[:, :, :, 0]).mean((1, 2)), (x[:, :, 1] - x[:, :, 0]).mean((1, 2)), (x[:, 1] - x[:, 0]).mean((1, 2))], 1)
            length = np.linalg.norm(edge, axis=2)
            unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-30)
            i = unit(edge[:, 0])
            j = unit(edge[:, 1] - (edge[:, 1] * i).sum(1, keepdims=True) * i)
            k = np.cross(i, j)
            k *= np.where((k * edge[:, 2]).sum(1, keepdims=True) < 0, -1.0, 1.0)
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "lx": length[:, 0], "ly": length[:, 1], "lz": length[:, 2], "frame": np.stack([i, j, k], 1).reshape(-1, 9).tolist()})

    return cells.select("cell_id", "corners").mapInPandas(run, "cell_id long, lx double, ly double, lz double, frame array<double>")


def log_radius(distance: Column, r_w: float = 0.5) -> Column:
    """Near-well feature: log of the distance over the well's radius, 0 inside it."""
    return F.ln(F.greatest(distance, F.lit(r_w)) / r_w)


def near_well_channel(distance: Column, offset: Sequence[Column], r0: float, r_max: float) -> tuple[Column, list[Column]]:
    """Log distance to the nearest perforation from -1 (at ``r0`` and inside it) to 1 (``r_max``), and its gradient; ``offset`` points from the perforation."""
    span = float(np.log(r_max) - np.log(r0))
    r = F.greatest(distance, F.lit(r0))
    phi = 2 * (F.ln(r) - float(np.log(r0))) / span - 1
    return phi, [F.when(distance > r0, 2 / span * d / (r * r)).otherwise(0.0) for d in offset]


def boundary_quads(faces: DataFrame, incidence: DataFrame) -> DataFrame:
    """Distinct faces (cell_id, face) as ``quad``, their four vertex ids in order; faces with fewer vertices have none."""
    slots = F.explode(F.array(*[F.struct(F.lit(f).alias("face"), F.lit(s).alias("slot")) for f, own in FACE_SLOTS.items() for s in own]))
    corners = faces.select("cell_id", "face", slots.alias("s")).filter("face = s.face").select("cell_id", "face", F.col("s.slot").alias("slot"))
    quads = corners.join(incidence, ["cell_id", "slot"]).groupBy("cell_id", "face").agg(F.array_sort(F.collect_list("vertex_id")).alias("quad"))  # four a face
    return quads.filter(F.size("quad") == 4).select("quad").distinct()


def affine_features(value: Column, gradient: Sequence[Column], offset: Sequence[Column]) -> Column:
    """``v + (x - x_c) . g`` of a feature over a cell."""
    out = value
    for g, d in zip(gradient, offset, strict=True):
        out = out + g * d
    return out


def greedy_track(blocks: DataFrame, well: str = "well") -> DataFrame:
    """Order of each well's blocks from the shallowest, each next the nearest left; a well's blocks are few."""
    ship(blocks.sparkSession)

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[["x", "y", "z"]].to_numpy(float)
        left, at = list(range(len(x))), int(np.lexsort((pdf["cell_id"], x[:, 2]))[0])
        path = [at]
        left.remove(at)
        while left:
            d = ((x[left] - x[at]) ** 2).sum(1)
            at = left[int(np.argmin(d))]
            left.remove(at)
            path.append(at)
        return pd.DataFrame({well: pdf[well].iloc[0], "cell_id": pdf["cell_id"].to_numpy()[path], "place": range(len(path))})

    return blocks.select(well, "cell_id", "x", "y", "z").groupBy(well).applyInPandas(order, f"{well} string, cell_id long, place int")


def map_axes(x: Column, y: Column, axes: Sequence[float]) -> tuple[Column, Column]:
    """Grid to map coordinates by MAPAXES (a point on the y axis, the origin, a point on the x axis)."""
    x1, y1, x0, y0, x2, y2 = (float(v) for v in axes)
    ux, uy = np.array([x2 - x0, y2 - y0]), np.array([x1 - x0, y1 - y0])
    ux, uy = ux / np.linalg.norm(ux), uy / np.linalg.norm(uy)
    return F.lit(x0) + x * float(ux[0]) + y * float(uy[0]), F.lit(y0) + x * float(ux[1]) + y * float(uy[1])


def pillar_corners(pillars: DataFrame, depths: DataFrame) -> DataFrame:
    """cell_id, slot, x, y, z of a corner-point grid: pillars (pi, pj, x0, y0, z0, x1, y1, z1), depths (cell_id, i, j, slot, z)."""
    on = depths.withColumn("pi", F.col("i") + F.col("slot") % 2).withColumn("pj", F.col("j") + F.floor(F.col("slot") / 2) % 2)
    j = on.join(pillars, ["pi", "pj"])
    flat = F.col("z1") == F.col("z0")
    t = F.when(flat, 0.0).otherwise((F.col("z") - F.col("z0")) / (F.col("z1") - F.col("z0")))
    return j.select("cell_id", "slot", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"), "z")
