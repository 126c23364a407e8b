"""A whole mesh out of cells, repaired: shared vertices, validity, pruning, borrowed geometry, boundary, and a report of each step.

1. Active cells are kept; their corners share vertices by place.
2. A cell is valid if its map is positive at every Gauss point and isn't collapsed.
3. Vertices that no valid cell uses are pruned, the rest renumbered in their order.
4. An invalid cell borrows vertices and geometry from the valid cell fewest steps away through active cells, and
   where none can be reached, from the one with the nearest centroid (``hops`` -1).
5. Faces of valid cells towards no active cell make the boundary.

Everything is joins by cell and vertex id; the search for owners goes a hop at a time through written
frontiers. Without a valid cell there is nothing to borrow from: an error if there are active cells.
Repeated cell ids are an error; inactive and null-active cells are left out; cells whose corners aren't 24 finite numbers are invalid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import cells as places
from terrane.operators import fem, layout, mesh
from terrane.operators.windows import sorted_ids
from terrane.plans.storage import written

AXES = ("i", "j", "k")


@dataclass
class Mesh:
    """vertices: vertex_id, x, y, z. incidence: cell_id, vertex_id (borrowed ones too). cells: cell_id, i, j, k, valid, owner, hops, volume, the
    owner's centroid, lengths and frame, and the corners. quads: vertex ids of each boundary face. report: step, measure, value."""

    vertices: DataFrame
    incidence: DataFrame
    cells: DataFrame
    quads: DataFrame
    report: DataFrame


def _corners(cells: DataFrame) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("slot")
    rows = cells.select("cell_id", "corners", at)
    return rows.select("cell_id", "slot", *[F.get("corners", F.col("slot") * 3 + n).alias(a) for n, a in enumerate("xyz")])


def build(grid: DataFrame, digits: int = 8, volume: str | None = None) -> Mesh:
    """The mesh of ``grid``: cell_id, i, j, k, active, corners (24 numbers), and with ``volume`` a column of known volumes to compare with."""
    whole = (F.size("corners") == 24) & ~F.exists("corners", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = [volume] if volume else []
    active = written(grid.filter("active").select(F.col("cell_id").cast("long").alias("cell_id"), *[F.col(a).cast("long").alias(a) for a in AXES], F.col("corners").cast("array<double>").alias("corners"), *kept).withColumn("__whole", F.coalesce(whole, F.lit(False))))
    if active.groupBy("cell_id").count().filter("count > 1").limit(1).count():
        raise ValueError("a cell id comes more than once")
    shaped = active.filter("__whole")
    vertices, incidence = mesh.vertices_of(_corners(shaped), digits)
    vertices, incidence = written(vertices), written(incidence)
    geometry = written(active.select("cell_id").join(fem.cell_geometry(shaped), "cell_id", "left").withColumn("valid", F.coalesce("valid", F.lit(False))))
    good = geometry.filter("valid").select("cell_id")

    used = sorted_ids(incidence.join(good, "cell_id", "left_semi"), ["vertex_id"], "new_id")
    used = written(used)
    pruned = written(vertices.join(used, "vertex_id").select(F.col("new_id").alias("vertex_id"), "x", "y", "z"))
    own = written(incidence.join(good, "cell_id", "left_semi").join(used, "vertex_id").select("cell_id", "slot", F.col("new_id").alias("vertex_id")))

    owned = active.select("cell_id", *AXES)
    if active.isEmpty():
        owners = owned.select("cell_id", F.col("cell_id").alias("owner"), F.lit(0).alias("hops"))
    else:
        reached = places.owners(owned, owned.join(good, "cell_id", "left_semi").select(*AXES, F.col("cell_id").alias("owner")), list(AXES))
        owners = owned.join(reached, list(AXES)).select("cell_id", "owner", "hops")
    owners = written(owners)
    taken = own.select(F.col("cell_id").alias("owner"), "vertex_id").distinct()
    shared = written(owners.join(taken, "owner").select("cell_id", "vertex_id"))

    of_owner = geometry.select(F.col("cell_id").alias("owner"), "cx", "cy", "cz").join(layout.local_frames(shaped).withColumnRenamed("cell_id", "owner"), "owner")
    out = active.drop("__whole").join(owners, "cell_id").join(geometry.select("cell_id", "valid", "volume"), "cell_id").join(of_owner, "owner", "left")
    out = written(out.select("cell_id", *AXES, "valid", "owner", "hops", F.coalesce("volume", F.lit(0.0)).alias("volume"), "cx", "cy", "cz", "lx", "ly", "lz", "frame", "corners", *[F.col(c).alias("known_volume") for c in kept]))

    open_ = places.boundary_faces(owned, AXES)
    axis = F.when(F.col("d_i") != 0, "i").when(F.col("d_j") != 0, "j").otherwise("k")
    side = F.col("d_i") + F.col("d_j") + F.col("d_k")
    faces = open_.select("cell_id", axis.alias("axis"), side.alias("side")).join(good, "cell_id", "left_semi")
    slots = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda s: F.floor(s / F.element_at(F.create_map(*[F.lit(v) for v in ("i", 1, "j", 2, "k", 4)]), F.col("axis"))) % 2 == F.when(F.col("side") > 0, 1).otherwise(0))
    at = faces.select("cell_id", "axis", "side", F.explode(slots).alias("slot")).join(own, ["cell_id", "slot"])
    quads = at.groupBy("cell_id", "axis", "side").agg(F.array_sort(F.collect_list("vertex_id")).alias("quad"))  # four a face
    quads = written(quads.select("quad").distinct())

    measures = {
        "cells": out.agg(F.count(F.lit(1)).alias("active"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("borrowing"), F.count_if(F.col("hops") < 0).alias("by_centroid"), F.coalesce(F.max("hops"), F.lit(0)).alias("most_hops"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume")),
        "vertices": incidence.agg(F.countDistinct("vertex_id").alias("made"), (F.count(F.lit(1)) - F.countDistinct("vertex_id")).alias("reused")),
        "kept": pruned.agg(F.count(F.lit(1)).alias("vertices")),
        "boundary": quads.select(F.explode("quad").alias("v")).agg((F.count(F.lit(1)) / 4).alias("quads"), F.countDistinct("v").alias("vertices")),
    }
    if volume:
        off = F.abs(F.col("volume") - F.col("known_volume")) / F.greatest(F.abs("known_volume"), F.lit(1e-12))
        measures["volume_error"] = out.filter("known_volume IS NOT NULL").agg(F.coalesce(F.avg(off), F.lit(0.0)).alias("mean"), F.coalesce(F.max(off), F.lit(0.0)).alias("largest"))
    report = None
    for step, one in measures.items():
        rows = one.select(F.lit(step).alias("step"), F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in one.columns])).alias("m")).select("step", "m.measure", "m.value")
        report = rows if report is None else report.unionByName(rows)
    return Mesh(pruned, shared, out, quads, report)
