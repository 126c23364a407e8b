"""Mesh building from cell corners: shared vertices, incidence, components, admissibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.operators.graph import connected_components
from terrane.operators.windows import first_appearance_ids
from terrane.plans.storage import written


def vertices_of(corners: DataFrame, digits: int = 8) -> tuple[DataFrame, DataFrame]:
    """(vertices: vertex_id, x, y, z; incidence: cell_id, slot, vertex_id) of corners (cell_id, slot, x, y, z).

    Corners share a vertex if they agree to ``digits`` decimals; ids go by first appearance
    in cell and slot order. Where two corners of a cell share one, the later gets its own.
    """
    keys = [f"__{a}" for a in "xyz"]
    c = corners.select("cell_id", "slot", "x", "y", "z", *[F.round(a, digits).alias(k) for a, k in zip("xyz", keys, strict=True)])
    twin = F.row_number().over(Window.partitionBy("cell_id", *keys).orderBy("slot"))
    c = written(c.withColumn("__own", F.when(twin > 1, F.col("cell_id") * 8 + F.col("slot")).otherwise(F.lit(-1).cast("long"))).withColumn("__pos", F.col("cell_id") * 8 + F.col("slot")))
    # own vertices of collapsed corners come after all shared ones
    last = F.col("__pos") + F.when(F.col("__own") >= 0, F.lit(1 << 50)).otherwise(0)
    ids = written(first_appearance_ids(c, [*keys, "__own"], last))
    placed = c.join(ids.drop("first_pos"), [*keys, "__own"])
    vertices = placed.groupBy("vertex_id").agg(F.min_by(F.struct("x", "y", "z"), "__pos").alias("p")).select("vertex_id", "p.x", "p.y", "p.z")
    return vertices, placed.select("cell_id", "slot", "vertex_id")


def cell_components(incidence: DataFrame) -> DataFrame:
    """vertex_id and component: vertices of a cell hang together; edges run from its least vertex, 7 a cell."""
    first = incidence.groupBy("cell_id").agg(F.min("vertex_id").alias("src"))
    edges = incidence.join(first, "cell_id").select("src", F.col("vertex_id").alias("dst"))
    return connected_components(edges).select(F.col("id").alias("vertex_id"), "component")


def null_modes(triplets: DataFrame) -> int:
    """Components of the pattern of non-zero entries."""
    return connected_components(triplets.filter("val <> 0"), "row", "col").select("component").distinct().count()


def admissibility(incidence: DataFrame, pore_volume: DataFrame, least_share: float) -> DataFrame:
    """component, n_vertices, share of pore volume and whether it is kept; cells are (cell_id, pore_volume)."""
    parts = cell_components(incidence)
    of_cell = incidence.join(parts, "vertex_id").groupBy("cell_id").agg(F.min("component").alias("component"))
    share = of_cell.join(pore_volume, "cell_id").groupBy("component").agg(F.sum("pore_volume").alias("pv"))
    total = share.agg(F.sum("pv").alias("t"))
    n = parts.groupBy("component").agg(F.count("*").alias("n_vertices"))
    return n.join(share, "component", "left").crossJoin(F.broadcast(total)).select("component", "n_vertices", (F.coalesce("pv", F.lit(0.0)) / F.col("t")).alias("share"), (F.coalesce("pv", F.lit(0.0)) / F.col("t") >= least_share).alias("keep"))


def reuse(incidence: DataFrame) -> DataFrame:
    """Largest number of cells that share a vertex."""
    return incidence.groupBy("vertex_id").agg(F.countDistinct("cell_id").alias("n")).agg(F.max("n").alias("max_reuse"))


def node_columns(vertices: DataFrame, digits: int = 6) -> DataFrame:
    """vertex_id, column id by rounded (x, y), and the number of levels in it."""
    v = vertices.select("vertex_id", F.round("x", digits).alias("__x"), F.round("y", digits).alias("__y"))
    ids = first_appearance_ids(v, ["__x", "__y"], F.col("vertex_id"), "column_id").drop("first_pos")
    w = Window.partitionBy("__x", "__y")
    return v.join(ids, ["__x", "__y"]).withColumn("levels", F.count("*").over(w)).select("vertex_id", "column_id", "levels")


def near_contacts(vertices: DataFrame, xtol: float, samples: int = 5) -> DataFrame:
    """src and dst component, n (vertices of src whose nearest of dst is within ``xtol``), min_distance and ``samples`` of them.

    ``vertices`` is (vertex_id, component, x, y, z). Both sides meet in cells of ``xtol``, so
    components that are further apart have no row. Of vertices as near the lowest id counts. Vertices of one
    component and place look for their nearest once.
    """
    axes = "xyz"
    place = ["component", *axes]
    own = vertices.select("vertex_id", *place)
    places = written(own.groupBy(*place).agg(F.min("vertex_id").alias("other_id")).withColumns({f"__{a}": F.floor(F.col(a) / xtol).cast("long") for a in axes}))
    other = places.select("other_id", F.col("component").alias("dst"), *[F.col(a).alias(f"o{a}") for a in axes], *[f"__{a}" for a in axes])
    for a in axes:
        other = other.withColumn(f"__{a}", F.explode(F.array(*[F.col(f"__{a}") + s for s in (-1, 0, 1)])))
    d2 = sum(((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in axes), F.lit(0.0))
    # the 27 rows of a place are more than Spark reckons, so it mustn't broadcast them
    met = places.drop("other_id").join(other.hint("merge"), [f"__{a}" for a in axes]).filter(F.col("component") != F.col("dst")).withColumn("d", F.sqrt(d2)).filter(F.col("d") <= xtol)
    hit = met.groupBy(*place, "dst").agg(F.min(F.struct("d", "other_id")).alias("m"))
    near = own.join(hit, place).groupBy(F.col("component").alias("src"), "dst", "vertex_id").agg(F.min("m").alias("m"))
    counts = near.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("m.d").alias("min_distance"))
    first = near.withColumn("__r", F.row_number().over(Window.partitionBy("src", "dst").orderBy("vertex_id"))).filter(F.col("__r") <= samples)
    shown = first.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("vertex_id", "m.other_id", F.col("m.d").alias("distance")))).alias("samples"))  # ``samples`` rows a pair
    return counts.join(shown, ["src", "dst"])


def well_vertices(tables: list[DataFrame]) -> DataFrame:
    """Vertices that any of the tables names, each once."""
    out = tables[0].select("vertex_id")
    for t in tables[1:]:
        out = out.unionByName(t.select("vertex_id"))
    return out.distinct()
