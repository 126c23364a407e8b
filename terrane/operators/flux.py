"""The balance of water, oil and gas at the vertices of a mesh, from states alone, and its projection on modes.

Cells are held in blocks by their least vertex. For each time slice a block gets the states of its vertices, each once; there
the cells' matrices give the flux (mobility upwinded by donor weights, times the stiffness of the potentials) and what it stores (mass
times the rate of change), added up within the block. Parts are added up by vertex, loads of wells are taken off, and the three balances
are recombined into pressure, water and free gas. Nothing is assembled and nothing leaves the executors; every step is a
join or a sum by ids, so slices and cells spread over all tasks.

A cell of which a vertex has no state in a slice takes no part there; vertices of no whole cell have no row. A
vertex has no rate of change in its first slice; there it and the vertices of its cells have no row. Null
permeabilities, rates and shares count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.fluids import Tables
from terrane.operators.fem import _blocks
from terrane.operators.residual import BARREL, STATE, accumulation, potentials, recombined
from terrane.plans.shipping import ship
from terrane.plans.storage import sized

#: Sharpness of the donor weights, and what keeps a root off zero.
BETA, TINY = 1.0, 1e-30
PHASES = ("w", "o", "g")


def vertex_terms(states: DataFrame, tables: Tables, density: dict[str, float], gravity: float, depth: str, poro: str, compressibility: float, reference: float, model: str = "stone2") -> DataFrame:
    """The states with, by phase, potential ``phi_``, mobility ``f_``, volume held ``u_`` and factor ``b_``; ``f_x`` is the gas that oil carries.

    Each group of terms is a projection of its own, so that what they share is computed once a row.
    """
    po, sw, sg, rs = (F.col(c) for c in STATE)
    phi = potentials(tables, density, gravity, F.col(depth))
    x = states.withColumns({f"phi_{p}": phi[p] for p in PHASES})
    x = x.withColumns({f"f_{p}": c for p, c in tables.mobilities(po, sw, sg, rs, model).items()}).withColumn("f_x", rs * F.col("f_o"))
    x = x.withColumns({f"u_{p}": c for p, c in accumulation(tables, F.col(poro), compressibility, reference).items()})
    p = tables.phase_pressures(po, sw, sg)
    return x.withColumns({"b_w": tables.bw(p["p_w"]), "b_o": tables.bo(rs), "b_g": tables.bg(p["p_g"])})


def with_rates(terms: DataFrame, time: str, key: Sequence[str] = ("vertex_id",)) -> DataFrame:
    """``du_``: the change of what a vertex holds since its slice before, over the time between; null in its first."""
    w = Window.partitionBy(*key).orderBy(time)
    rate = lambda c: (F.col(c) - F.lag(c).over(w)) / (F.col(time) - F.lag(time).over(w))
    return terms.withColumns({f"du_{p}": rate(f"u_{p}") for p in PHASES})


def donor_mobility(potential: np.ndarray, mobility: np.ndarray, beta: float = BETA) -> np.ndarray:
    """Of each cell (row): the mobilities of its vertices, weighted by the softmax of their potentials about the mean."""
    z = beta * (potential - potential.mean(1, keepdims=True))
    w = np.exp(z - z.max(1, keepdims=True))
    return (w * mobility).sum(1) / w.sum(1)


#: Least vertices that share so many upper bits make a block of cells.
BLOCK_BITS = 9
#: Vertex terms that cells gather.
GATHERED = [f"{k}_{p}" for k in ("phi", "f", "du") for p in PHASES] + ["f_x"]


def element_parts(cells: DataFrame, terms: DataFrame, time: str, consistent: bool = True, c_f: float = 1.0, beta: float = BETA) -> DataFrame:
    """time, vertex_id and r_w, r_o, r_g: flux and storage of all cells (cell_id, corners, v, kx, ky, kz) added up by vertex; without the vertices where a term is missing.

    ``consistent`` stores with the mass block, else with its row sums (lumped).
    """
    ship(cells.sparkSession)
    whole = cells.filter(F.size("v") == 8).filter(F.forall("v", lambda x: x.isNotNull())).withColumn("__b", F.shiftright(F.array_min("v").cast("long"), BLOCK_BITS))
    needed = whole.select("__b", F.explode(F.col("v").cast("array<bigint>")).alias("vertex_id")).distinct()
    nodal = terms.select(time, "vertex_id", *[F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) for c in GATHERED])
    held = nodal.join(needed, "vertex_id").repartition("__b").groupBy("__b", time).agg(F.collect_list(F.struct("vertex_id", *GATHERED)).alias("n"))  # a block's vertices in a slice
    shapes = whole.repartition("__b").groupBy("__b").agg(F.collect_list(F.struct("corners", "v", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("kx", "ky", "kz")])).alias("e"))
    shapes = shapes.select("__b", F.flatten("e.corners").alias("corners"), F.flatten("e.v").alias("v"), *[F.col(f"e.{c}").alias(c) for c in ("kx", "ky", "kz")])
    rows = held.join(shapes.hint("merge"), "__b").select(time, "corners", "v", "kx", "ky", "kz", F.col("n.vertex_id").alias("at"), *[F.col(f"n.{c}").alias(c) for c in GATHERED])
    kind = terms.schema[time].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                at = np.asarray(row["at"], np.int64)
                order = at.argsort()
                at, v = at[order], np.asarray(row["v"], np.int64).reshape(-1, 8)
                i = np.minimum(at.searchsorted(v), len(at) - 1)
                met = (at[i] == v).all(1)
                if not met.any():
                    continue
                i = i[met]
                x = {c: np.asarray(row[c], float)[order][i] for c in GATHERED}
                e = pd.DataFrame({"corners": list(np.asarray(row["corners"], float).reshape(-1, 24)[met])} | {c: np.asarray(row[c], float)[met] for c in ("kx", "ky", "kz")})
                stiff, mass = _blocks(e, "stiffness"), _blocks(e, "mass")
                if not consistent:
                    mass = mass.sum(2)[:, :, None] * np.eye(8)
                flow = {p: np.einsum("nij,nj->ni", stiff, x[f"phi_{p}"]) for p in PHASES}
                part = {p: donor_mobility(x[f"phi_{p}"], x[f"f_{p}"], beta)[:, None] * flow[p] for p in PHASES}
                part["g"] = part["g"] + donor_mobility(x["phi_o"], x["f_x"], beta)[:, None] * flow["o"]
                r = np.stack([(c_f * part[p] + BARREL * np.einsum("nij,nj->ni", mass, x[f"du_{p}"])).ravel() for p in PHASES])
                place, i = np.unique(i, return_inverse=True)
                i = i.ravel()
                missing = np.bincount(i, np.isnan(r).any(0), len(place)) > 0  # a term is missing
                yield pd.DataFrame({time: [row[time]] * len(place), "vertex_id": at[place], "open": missing} | {f"r_{p}": np.bincount(i, np.nan_to_num(r[k]), len(place)) for k, p in enumerate(PHASES)})

    parts = rows.mapInPandas(run, f"`{time}` {kind}, vertex_id long, open boolean, r_w double, r_o double, r_g double")
    sums = parts.groupBy(time, "vertex_id").agg(F.max("open").alias("__open"), *[F.sum(f"r_{p}").alias(f"r_{p}") for p in PHASES])
    return sums.filter("NOT __open").drop("__open")


def loads(shares: DataFrame, rates: DataFrame, time: str) -> DataFrame:
    """time, vertex_id and q_w, q_o, q_g: rates of perforations (time, perf_no, q_) dealt to vertices by ``shares`` (vertex_id, perf_no, share)."""
    q = [F.sum(F.coalesce(F.col("share") * F.col(f"q_{p}"), F.lit(0.0))).alias(f"q_{p}") for p in PHASES]
    return rates.join(shares, "perf_no").groupBy(time, "vertex_id").agg(*q)


def nodal_balance(cells: DataFrame, terms: DataFrame, q: DataFrame, time: str, consistent: bool = True, c_f: float = 1.0, beta: float = BETA) -> DataFrame:
    """time, vertex_id, r_p, r_w, r_g: ``M dU/dt + K phi - Q`` at the vertices, recombined."""
    moved = with_rates(terms, time)
    parts = element_parts(cells, moved, time, consistent, c_f, beta)
    x = parts.join(q, [time, "vertex_id"], "left").join(terms.select(time, "vertex_id", "b_w", "b_o", "b_g", "rs"), [time, "vertex_id"])
    r = recombined(*[F.col(f"r_{p}") - F.coalesce(f"q_{p}", F.lit(0.0)) for p in PHASES], *[F.col(f"b_{p}") for p in PHASES], F.col("rs"))
    return x.select(time, "vertex_id", *[c.alias(f"r_{n}") for n, c in r.items()])


def node_weights(nodes: DataFrame, kind: str = "none", boost: float = 1.0) -> DataFrame:
    """vertex_id and weight: 1, the ``volume`` over the mean one, or 1 and ``boost`` times the ``envelope`` of the wells."""
    if kind == "none":
        return nodes.select("vertex_id", F.lit(1.0).alias("weight"))
    if kind == "volume":
        return nodes.crossJoin(F.broadcast(nodes.agg(F.avg("volume").alias("__mean")))).select("vertex_id", (F.col("volume") / F.col("__mean")).alias("weight"))
    if kind == "wells":
        return nodes.select("vertex_id", (1 + boost * F.coalesce("envelope", F.lit(0.0))).alias("weight"))
    raise ValueError(f"unknown weight {kind}")


def project(rows: DataFrame, basis: DataFrame, mu: DataFrame, time: str, kind: str = "galerkin", weights: DataFrame | None = None) -> DataFrame:
    """time, mode, r_p, r_w, r_g on the modes of ``basis`` (vertex_id, mode, psi), scaled by the root of their ``mu`` (mode, mu).

    ``galerkin`` is ``sqrt(mu) psi^T R``; ``blocknorm`` is ``sqrt(mu |psi|^T (w R^2) + 1e-30)``, which keeps no sign and loses
    nothing to cancellation. Modes without a ``mu`` have no rows.
    """
    if kind not in ("galerkin", "blocknorm"):
        raise ValueError(f"unknown projection {kind}")
    names = ("r_p", "r_w", "r_g")
    x = rows if weights is None else rows.join(weights, "vertex_id")
    w = F.lit(1.0) if weights is None else F.col("weight")
    one = lambda c: F.col("psi") * F.col(c) if kind == "galerkin" else F.abs("psi") * w * F.col(c) * F.col(c)
    s = x.join(basis, "vertex_id").groupBy(time, "mode").agg(*[F.sum(one(c)).alias(c) for c in names]).join(sized(mu), "mode")
    out = lambda c: F.sqrt("mu") * F.col(c) if kind == "galerkin" else F.sqrt(F.col("mu") * F.col(c) + TINY)
    return s.select(time, "mode", *[out(c).alias(c) for c in names])


def term_rows(rows: DataFrame, key: Sequence[str], scales: Sequence[float], term: str = "pde") -> DataFrame:
    """term, key, channel and residual: balances over their scales, one row a channel, as the other terms of the loss have them."""
    each: list[Column] = [F.struct(F.lit(c).alias("channel"), (F.col(c) / s).alias("residual")) for c, s in zip(("r_p", "r_w", "r_g"), scales, strict=True)]
    return rows.select(F.lit(term).alias("term"), *key, F.explode(F.array(*each)).alias("r")).select("term", *key, "r.channel", "r.residual")
