"""Hexahedral elements: geometry, validity, stiffness and mass blocks, assembly and eigenpairs.

Element work is vectorized over Arrow batches of cells (``mapInPandas``) and needs no
shuffle; assembly is one sum by (row, col).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.aggregates import assemble
from terrane.plans.shipping import ship

#: Corner signs of the reference cube, i fastest.
SIGNS = np.array([[-1, -1, -1], [1, -1, -1], [-1, 1, -1], [1, 1, -1], [-1, -1, 1], [1, -1, 1], [-1, 1, 1], [1, 1, 1]], float)
GAUSS = SIGNS / np.sqrt(3.0)
#: det J at every Gauss point must be over this share of the bounding box.
LEAST = 1e-6


def shapes() -> tuple[np.ndarray, np.ndarray]:
    """(points, 8) values and (points, 8, 3) derivatives of the trilinear shapes at the Gauss points."""
    t = 1 + GAUSS[:, None, :] * SIGNS[None]
    n = t.prod(2) / 8
    d = np.stack([SIGNS[None, :, a] * np.delete(t, a, 2).prod(2) / 8 for a in range(3)], 2)
    return n, d


def geometry(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(determinants, gradients, volumes) of cells (n, 8, 3): (n, 8), (n, 8, 8, 3), (n,)."""
    _, d = shapes()
    jac = np.einsum("gka,nkb->ngab", d, corners)
    det = np.linalg.det(jac)
    safe = np.where(np.abs(det)[..., None, None] > 1e-300, jac, np.eye(3))
    grad = np.einsum("ngab,gkb->ngka", np.linalg.inv(safe), d)
    grad[np.abs(det) <= 1e-300] = 0
    return det, grad, np.abs(det).sum(1)


def _corners(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["corners"].tolist(), float).reshape(-1, 8, 3)


def cell_geometry(cells: DataFrame) -> DataFrame:
    """cell_id, valid, volume and centroid of cells (cell_id, corners: 24 doubles)."""
    ship(cells.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _corners(pdf)
            det, _, volume = geometry(x)
            box = np.ptp(x, axis=1).prod(1)
            c = x.mean(1)
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "valid": (det * 8 > LEAST * box[:, None]).all(1) & (box > 0), "volume": volume, "cx": c[:, 0], "cy": c[:, 1], "cz": c[:, 2]})

    return cells.select("cell_id", "corners").mapInPandas(run, "cell_id long, valid boolean, volume double, cx double, cy double, cz double")


def element_triplets(cells: DataFrame, kind: str) -> DataFrame:
    """(row, col, val) of each cell's block: mass, stiffness (with kx, ky, kz) or its part along x, y or z; cells have vertex ids ``v`` (8)."""
    ship(cells.sparkSession)
    _known(kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.array(pdf["v"].tolist(), np.int64)
            yield pd.DataFrame({"row": np.repeat(v, 8, 1).ravel(), "col": np.tile(v, (1, 8)).ravel(), "val": _blocks(pdf, kind).ravel()})

    return cells.select("corners", "v", *_permeabilities(kind)).mapInPandas(run, "row long, col long, val double")


def _known(kind: str) -> None:
    if kind not in ("stiffness", "mass", "x", "y", "z"):
        raise ValueError(kind)


def _permeabilities(kind: str) -> list[str]:
    return ["kx", "ky", "kz"] if kind == "stiffness" else [f"k{kind}"] if kind in "xyz" else []


def _blocks(pdf: pd.DataFrame, kind: str) -> np.ndarray:
    """8 x 8 blocks of cells: mass, stiffness, or the part of the stiffness along one axis; the three add up to the whole."""
    n, _ = shapes()
    det, grad, _ = geometry(_corners(pdf))
    w = np.abs(det)
    if kind == "mass":
        return np.einsum("ng,gi,gj->nij", w, n, n)
    k = np.zeros((len(pdf), 3))
    for a, c in enumerate(("kx", "ky", "kz")):
        if c in _permeabilities(kind):
            k[:, a] = pdf[c].to_numpy(float)
    return np.einsum("ng,ngia,na,ngja->nij", w, grad, k, grad)


def action(cells: DataFrame, nodal: DataFrame, kind: str, value: str = "x") -> DataFrame:
    """vertex_id and y: the operator on a nodal field, block by block, without assembling it.

    Cells gather their eight values by two joins on ids; what comes back is added up by vertex.
    """
    ship(cells.sparkSession)
    _known(kind)
    wanted = cells.select("cell_id", F.posexplode("v").alias("slot", "vertex_id"))
    held = wanted.join(nodal.select("vertex_id", F.col(value).alias("__x")), "vertex_id").groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "__x"))), lambda e: e["__x"]).alias("x"))  # eight a cell

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = np.einsum("nij,nj->ni", _blocks(pdf, kind), np.array(pdf["x"].tolist(), float))
            yield pd.DataFrame({"vertex_id": np.array(pdf["v"].tolist(), np.int64).ravel(), "y": y.ravel()})

    parts = cells.select("cell_id", "corners", "v", *_permeabilities(kind)).join(held, "cell_id").mapInPandas(run, "vertex_id long, y double")
    return parts.groupBy("vertex_id").agg(F.sum("y").alias("y"))


def centroid_gradients(cells: DataFrame, nodal: DataFrame, value: str = "x") -> DataFrame:
    """cell_id, value and gx, gy, gz of a nodal field at the middle of each cell."""
    ship(cells.sparkSession)
    wanted = cells.select("cell_id", F.posexplode("v").alias("slot", "vertex_id"))
    held = wanted.join(nodal.select("vertex_id", F.col(value).alias("__x")), "vertex_id").groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "__x"))), lambda e: e["__x"]).alias("x"))  # eight a cell

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        middle = SIGNS / 8
        for pdf in batches:
            jac = np.einsum("ka,nkb->nab", middle, _corners(pdf))
            x = np.array(pdf["x"].tolist(), float)
            g = np.linalg.solve(jac, np.einsum("ka,nk->na", middle, x)[..., None])[..., 0]
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "value": x.mean(1), "gx": g[:, 0], "gy": g[:, 1], "gz": g[:, 2]})

    return cells.select("cell_id", "corners").join(held, "cell_id").mapInPandas(run, "cell_id long, value double, gx double, gy double, gz double")


def operator(cells: DataFrame, kind: str) -> DataFrame:
    """The assembled sparse operator."""
    return assemble(element_triplets(cells, kind), "row", "col", "val")


def lumped_volumes(mass: DataFrame) -> DataFrame:
    """Volume of each vertex: row sums of the mass operator."""
    return mass.groupBy(F.col("row").alias("vertex_id")).agg(F.sum("val").alias("volume"))


def centroid_values(cell_vertex: DataFrame, nodal: DataFrame, value: str) -> DataFrame:
    """Mean of a nodal field over each cell's corners."""
    return cell_vertex.join(nodal, "vertex_id").groupBy("cell_id").agg(F.avg(value).alias(value))


def eigenpairs(a: np.ndarray, m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` lowest pairs of ``A x = l M x``, dense, by Cholesky of M; meant for up to some thousand vertices."""
    inverse = np.linalg.inv(np.linalg.cholesky(m))
    values, vectors = np.linalg.eigh(inverse @ a @ inverse.T)
    return np.maximum(values[:n], 0.0), inverse.T @ vectors[:, :n]


def dense(triplets: DataFrame, n: int, most: int = 4096) -> np.ndarray:
    """A small operator on the driver; larger ones are refused."""
    if n > most:
        raise ValueError(f"{n} vertices are more than the {most} of the dense solver")
    out = np.zeros((n, n))
    for r in triplets.toLocalIterator():
        out[r["row"], r["col"]] += r["val"]
    return out


def subspace_eigenpairs(a: DataFrame, m: DataFrame, n_vertices: int, n: int, rounds: int = 200, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Lowest pairs by LOBPCG over sparse triplets kept as CSR on the driver, for meshes past the dense limit.

    Memory is the triplets (27 a vertex) and three blocks of ``n`` vectors.
    """
    def csr(t: DataFrame):
        rows = t.toPandas()
        return rows["row"].to_numpy(), rows["col"].to_numpy(), rows["val"].to_numpy()

    (ar, ac, av), (mr, mc, mv) = csr(a), csr(m)

    def times(r, c, v, x):
        out = np.zeros_like(x)
        np.add.at(out, r, v[:, None] * x[c])
        return out

    rng = np.random.default_rng(0)
    x, p, last = rng.standard_normal((n_vertices, n)), None, None
    scale = np.bincount(ar[ar == ac], av[ar == ac], n_vertices)[:, None] + 1e-12
    for _ in range(rounds):
        mx = times(mr, mc, mv, x)
        x = x @ np.linalg.inv(np.linalg.cholesky(x.T @ mx)).T
        ax, mx = times(ar, ac, av, x), times(mr, mc, mv, x)
        values, q = np.linalg.eigh(x.T @ ax)
        x, ax, mx = x @ q, ax @ q, mx @ q
        if last is not None and np.abs(values - last).max() <= tol * max(1.0, np.abs(values).max()):
            break
        last = values
        basis = np.concatenate([x, (ax - mx * values) / scale] + ([] if p is None else [p]), 1)
        basis, _ = np.linalg.qr(basis)
        small_a, small_m = basis.T @ times(ar, ac, av, basis), basis.T @ times(mr, mc, mv, basis)
        _, y = eigenpairs((small_a + small_a.T) / 2, (small_m + small_m.T) / 2, n)
        new = basis @ y
        p = new - x @ (x.T @ times(mr, mc, mv, new))
        x = new
    return np.maximum(values, 0.0), x
