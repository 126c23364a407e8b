"""Fitting a small gated network by Gauss-Newton: rows stay distributed, only J^T J reaches the driver.

The network is a stack of gated blocks (four gates each). Its Jacobian is written out by
reverse differentiation in NumPy, per Arrow batch; each partition adds up its own
``J^T J`` and ``J^T r``, which are added up row by row on the executors, so one square of parameters
reaches the driver. With fewer residuals than parameters that square is J J^T, made in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.plans.shipping import ship
from terrane.plans.storage import discard, sized, written

GATES = ("z", "g", "r", "h")


@dataclass(frozen=True)
class Network:
    """``inputs`` to ``outputs`` over ``blocks`` gated blocks of ``width``."""

    inputs: int
    outputs: int
    width: int
    blocks: int

    def shapes(self) -> list[tuple[str, tuple[int, ...]]]:
        d, w = self.inputs, self.width
        out = [("in.w", (d, w)), ("in.b", (w,))]
        for k in range(self.blocks):
            for g in GATES:
                out += [(f"{k}.{g}.u", (d, w)), (f"{k}.{g}.w", (w, w)), (f"{k}.{g}.b", (w,))]
        return [*out, ("out.w", (w, self.outputs)), ("out.b", (self.outputs,))]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for _, s in self.shapes())

    def init(self, seed: int) -> np.ndarray:
        """Glorot normal weights and zero biases, flat."""
        rng, parts = np.random.default_rng(seed), []
        for _, s in self.shapes():
            parts.append(rng.standard_normal(s).ravel() * np.sqrt(2.0 / sum(s)) if len(s) == 2 else np.zeros(s))
        return np.concatenate(parts)

    def unflatten(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, s in self.shapes():
            n = int(np.prod(s))
            out[name], at = flat[at : at + n].reshape(s), at + n
        return out

    def forward(self, flat: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
        p = self.unflatten(flat)
        s = np.tanh(x @ p["in.w"] + p["in.b"])
        tape: list = [s]
        for k in range(self.blocks):
            gate = lambda g, t, k=k: np.tanh(x @ p[f"{k}.{g}.u"] + t @ p[f"{k}.{g}.w"] + p[f"{k}.{g}.b"])
            z, g, r = gate("z", s), gate("g", s), gate("r", s)
            h = gate("h", s * r)
            tape.append((s, z, g, r, h))
            s = (1 - g) * h + z * s
        tape.append(s)
        return s @ p["out.w"] + p["out.b"], tape

    def tangent(self, flat: np.ndarray, x: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outputs, their change for a change ``dx`` of the inputs), forward in one pass."""
        p = self.unflatten(flat)
        s = np.tanh(x @ p["in.w"] + p["in.b"])
        ds = (1 - s * s) * (dx @ p["in.w"])
        for k in range(self.blocks):
            def gate(g: str, t: np.ndarray, dt: np.ndarray, k: int = k) -> tuple[np.ndarray, np.ndarray]:
                v = np.tanh(x @ p[f"{k}.{g}.u"] + t @ p[f"{k}.{g}.w"] + p[f"{k}.{g}.b"])
                return v, (1 - v * v) * (dx @ p[f"{k}.{g}.u"] + dt @ p[f"{k}.{g}.w"])

            (z, dz), (g, dg), (r, dr) = gate("z", s, ds), gate("g", s, ds), gate("r", s, ds)
            h, dh = gate("h", s * r, ds * r + s * dr)
            s, ds = (1 - g) * h + z * s, -dg * h + (1 - g) * dh + dz * s + z * ds
        return s @ p["out.w"] + p["out.b"], ds @ p["out.w"]

    def jacobian(self, flat: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outputs (n, o), derivatives (n, o, parameters))."""
        p = self.unflatten(flat)
        y, tape = self.forward(flat, x)
        n, out = len(x), []
        for o in range(self.outputs):
            grad: dict[str, np.ndarray] = {}
            last = tape[-1]
            gw = np.zeros((n, self.width, self.outputs))
            gw[:, :, o] = last
            gb = np.zeros((n, self.outputs))
            gb[:, o] = 1
            grad["out.w"], grad["out.b"] = gw, gb
            ds = np.broadcast_to(p["out.w"][:, o], (n, self.width)).copy()
            for k in range(self.blocks - 1, -1, -1):
                s, z, g, r, h = tape[k + 1]
                pre = {"z": ds * s * (1 - z * z), "g": -ds * h * (1 - g * g), "h": ds * (1 - g) * (1 - h * h)}
                dsr = pre["h"] @ p[f"{k}.h.w"].T
                pre["r"] = dsr * s * (1 - r * r)
                down = ds * z + dsr * r
                for gate in GATES:
                    t = s * r if gate == "h" else s
                    grad[f"{k}.{gate}.u"] = x[:, :, None] * pre[gate][:, None, :]
                    grad[f"{k}.{gate}.w"] = t[:, :, None] * pre[gate][:, None, :]
                    grad[f"{k}.{gate}.b"] = pre[gate]
                    if gate != "h":
                        down = down + pre[gate] @ p[f"{k}.{gate}.w"].T
                ds = down
            d0 = ds * (1 - tape[0] * tape[0])
            grad["in.w"], grad["in.b"] = x[:, :, None] * d0[:, None, :], d0
            out.append(np.concatenate([grad[name].reshape(n, -1) for name, _ in self.shapes()], 1))
        return y, np.stack(out, 1)


def predict(df: DataFrame, net: Network, flat: np.ndarray, inputs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys and y (array) of each row."""
    ship(df.sparkSession)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y, _ = net.forward(flat, pdf[list(inputs)].to_numpy(float))
            yield pdf[list(keys)].assign(y=list(y))

    return df.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(run, f"{kinds}, y array<double>")


def _summed(parts: DataFrame) -> DataFrame:
    """(i, row): rows of doubles (binary) with one number added up, part by part, on the executors."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("row"))
        return pa.table({"i": pa.array([table.column("i")[0].as_py()], pa.int64()), "row": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy("i").applyInArrow(add, "i long, row binary")


def normal_equations(df: DataFrame, net: Network, flat: np.ndarray, inputs: Sequence[str], targets: Sequence[str], weight: str | None = None, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(J^T J, J^T r, sum of squares, rows): each partition adds up its own, rows of equal number are added up on the executors, and one square comes back."""
    ship(df.sparkSession)
    columns = [*inputs, *targets, *([weight] if weight else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, v, loss, n = np.zeros((net.size, net.size)), np.zeros(net.size), 0.0, 0
        for pdf in batches:
            for a in range(0, len(pdf), chunk):
                part = pdf.iloc[a : a + chunk]
                y, jac = net.jacobian(flat, part[list(inputs)].to_numpy(float))
                w = np.sqrt(part[weight].to_numpy(float))[:, None] if weight else 1.0
                r = (y - part[list(targets)].to_numpy(float)) * w
                j = (jac * (w[..., None] if weight else 1.0)).reshape(-1, net.size)
                g += j.T @ j
                v += j.T @ r.ravel()
                loss += float((r * r).sum())
                n += len(part)
        if n:
            yield pd.DataFrame({"i": range(net.size + 2), "row": [*(x.tobytes() for x in g), v.tobytes(), np.array([loss, n], float).tobytes()]})

    g, tail = np.zeros((net.size, net.size)), {net.size: np.zeros(net.size), net.size + 1: np.zeros(2)}
    for r in _summed(df.select(*columns).mapInPandas(run, "i long, row binary")).toLocalIterator():
        row = np.frombuffer(r["row"])
        if r["i"] < net.size:
            g[r["i"]] = row
        else:
            tail[r["i"]] = row
    return g, tail[net.size], float(tail[net.size + 1][0]), int(tail[net.size + 1][1])


#: Rows of a tile's side.
TILE_ROWS = 512


def row_tiles(df: DataFrame, net: Network, flat: np.ndarray, inputs: Sequence[str], targets: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, tiles): rows packed by ``key`` (unique) into blocks, and J J^T of each pair of blocks, the lower half.

    Blocks are shipped as inputs and their Jacobians made where a tile is, so what moves doesn't grow with the
    parameters. ``blocks``: b, x, t (binary) and n; ``tiles``: b, c, tile (binary).
    """
    from terrane.operators.windows import sorted_ids

    ship(df.sparkSession)
    placed = sorted_ids(df.select(key, *inputs, *targets), [key], "__at", [key])

    def pack(table: pa.Table) -> pa.Table:
        p = table.to_pandas().sort_values("__at")
        x, t = (p[list(c)].to_numpy(float) for c in (inputs, targets))
        return pa.table({"b": pa.array([p["__b"].iloc[0]], pa.int64()), "n": pa.array([len(p)], pa.int64()), "x": pa.array([x.tobytes()], pa.binary()), "t": pa.array([t.tobytes()], pa.binary())})

    blocks = written(placed.withColumn("__b", F.floor(F.col("__at") / TILE_ROWS)).groupBy("__b").applyInArrow(pack, "b long, n long, x binary, t binary"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                side = lambda c: net.jacobian(flat, np.frombuffer(batch.column(c)[k].as_buffer()).reshape(-1, len(inputs)))[1].reshape(-1, net.size)  # noqa: B023, E731
                tile = side("x") @ side("y").T
                yield pa.RecordBatch.from_arrays([*(pa.array([batch.column(c)[k].as_py()], pa.int64()) for c in "bc"), pa.array([tile.tobytes()], pa.binary())], ["b", "c", "tile"])

    others = blocks.select(F.col("b").alias("c"), F.col("x").alias("y"))
    last = blocks.agg(F.max("b")).first()[0]
    pairs = blocks.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b"))).alias("c")) if last is not None else blocks.select("b", F.col("b").alias("c"))
    pairs = pairs.repartition("b", "c") if last else pairs
    tiles = pairs.join(sized(blocks.select("b", "x")), "b").join(sized(others), "c").select("b", "c", "x", "y").mapInArrow(meet, "b long, c long, tile binary")
    return blocks, tiles


def step_by_rows(df: DataFrame, net: Network, flat: np.ndarray, inputs: Sequence[str], targets: Sequence[str], key: str, damping: float, most_rows: int = 8192) -> np.ndarray:
    """The damped Gauss-Newton direction by way of the rows, for fewer residuals than parameters: ``J^T a``, ``(J J^T + damping diag) a = r``.

    The driver holds the one square J J^T, filled tile by tile, and vectors; more than ``most_rows`` residuals are an error.
    """
    blocks, tiles = row_tiles(df, net, flat, inputs, targets, key)
    sizes = {r["b"]: r["n"] * len(targets) for r in blocks.select("b", "n").collect()}
    n = sum(sizes.values())
    if n > most_rows:
        raise ValueError(f"{n} residuals are more than the {most_rows} of the row side")
    at = dict(zip(sorted(sizes), np.cumsum([0, *[sizes[b] for b in sorted(sizes)]]).tolist(), strict=False))
    square = np.zeros((n, n))
    for r in tiles.toLocalIterator():
        b, c = r["b"], r["c"]
        t = np.frombuffer(r["tile"]).reshape(sizes[b], sizes[c])
        square[at[b] : at[b] + sizes[b], at[c] : at[c] + sizes[c]] = t
        square[at[c] : at[c] + sizes[c], at[b] : at[b] + sizes[b]] = t.T

    def sides(alpha: dict | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    b = batch.column("b")[k].as_py()
                    x, t = (np.frombuffer(batch.column(c)[k].as_buffer()).reshape(-1, len(w)) for c, w in (("x", inputs), ("t", targets)))
                    y, jac = net.jacobian(flat, x) if alpha is not None else (net.forward(flat, x)[0], None)
                    row = (y - t).ravel() if alpha is None else jac.reshape(-1, net.size).T @ alpha[b]
                    yield pa.RecordBatch.from_arrays([pa.array([b if alpha is None else 0], pa.int64()), pa.array([row.tobytes()], pa.binary())], ["i", "row"])

        return run

    r = np.zeros(n)
    for row in blocks.mapInArrow(sides(None), "i long, row binary").toLocalIterator():
        r[at[row["i"]] : at[row["i"]] + sizes[row["i"]]] = np.frombuffer(row["row"])
    a = damped_direction(square, r, damping)
    total = _summed(blocks.mapInArrow(sides({b: a[k : k + sizes[b]] for b, k in at.items()}), "i long, row binary")).first()
    discard(blocks)
    return np.zeros(net.size) if total is None else np.frombuffer(total["row"]).copy()


def direction(df: DataFrame, net: Network, flat: np.ndarray, inputs: Sequence[str], targets: Sequence[str], key: str, damping: float = 1e-6) -> np.ndarray:
    """The damped direction by the smaller side: rows if there are fewer residuals than parameters, else parameters."""
    if df.count() * len(targets) < net.size:
        return step_by_rows(df, net, flat, inputs, targets, key, damping)
    g, v, _, _ = normal_equations(df, net, flat, inputs, targets)
    return damped_direction(g, v, damping)


def losses(df: DataFrame, net: Network, candidates: Sequence[np.ndarray], inputs: Sequence[str], targets: Sequence[str]) -> np.ndarray:
    """Sum of squares at each candidate, all in one pass."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(candidates))
        for pdf in batches:
            x, t = pdf[list(inputs)].to_numpy(float), pdf[list(targets)].to_numpy(float)
            for k, flat in enumerate(candidates):
                total[k] += float(((net.forward(flat, x)[0] - t) ** 2).sum())
        yield pd.DataFrame({"k": range(len(candidates)), "loss": total})

    out = np.zeros(len(candidates))
    for row in df.select(*inputs, *targets).mapInPandas(run, "k int, loss double").groupBy("k").sum("loss").collect():
        out[row[0]] = row[1]
    return out


def damped_direction(g: np.ndarray, v: np.ndarray, damping: float, rungs: int = 3) -> np.ndarray:
    """Solve ``(G + damping diag) d = v``; where Cholesky fails the damping grows by 1e6, up to ``rungs`` times, then least squares."""
    scale = np.sqrt(np.maximum(np.diag(g), 1e-12))
    even = g / np.outer(scale, scale)
    for k in range(rungs + 1):
        try:
            low = np.linalg.cholesky(even + damping * 1e6**k * np.eye(len(g)))
        except np.linalg.LinAlgError:
            continue
        d = np.linalg.solve(low.T, np.linalg.solve(low, v / scale)) / scale
        return np.where(np.isfinite(d), d, 0.0)
    d = np.linalg.lstsq(even, v / scale, rcond=None)[0] / scale
    return np.where(np.isfinite(d), d, 0.0)


def rowspace_direction(jac: np.ndarray, r: np.ndarray, damping: float, shift: np.ndarray | None = None, rungs: int = 3) -> np.ndarray:
    """``J^T a`` with ``(J J^T + damping diag) a = 2 r - shift``: the same step by rows, for fewer rows than parameters.

    ``jac`` and ``r`` are one batch on the driver; its rows are bounded by what is sampled.
    """
    rhs = 2.0 * r - (0.0 if shift is None else shift)
    return jac.T @ damped_direction(jac @ jac.T, rhs, damping, rungs)


@dataclass(frozen=True)
class Phase:
    """``iterations`` of a method (``gauss_newton`` or ``adam``) with its step size at the start and at the end."""

    method: str
    iterations: int
    rate: float = 1e-3
    last_rate: float | None = None

    def rate_at(self, k: int) -> float:
        """Step size of the phase's k-th iteration (from 0), falling by equal factors."""
        if self.last_rate is None or self.iterations < 2:
            return self.rate
        return self.rate * (self.last_rate / self.rate) ** (k / (self.iterations - 1))


@dataclass
class Adam:
    """Adam's running moments; ``step`` gives the change of the parameters for a gradient."""

    size: int
    b1: float = 0.9
    b2: float = 0.999
    eps: float = 1e-8

    def __post_init__(self) -> None:
        self.m, self.v, self.n = np.zeros(self.size), np.zeros(self.size), 0

    def step(self, grad: np.ndarray, rate: float) -> np.ndarray:
        self.n += 1
        self.m = self.b1 * self.m + (1 - self.b1) * grad
        self.v = self.b2 * self.v + (1 - self.b2) * grad * grad
        return -rate * (self.m / (1 - self.b1**self.n)) / (np.sqrt(self.v / (1 - self.b2**self.n)) + self.eps)


def gradient(df: DataFrame, net: Network, flat: np.ndarray, inputs: Sequence[str], targets: Sequence[str], chunk: int = 2048) -> tuple[np.ndarray, float]:
    """(gradient of the mean square, mean square): each partition adds up its own, the parts are added up on the executors."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, loss, n = np.zeros(net.size), 0.0, 0
        for pdf in batches:
            for a in range(0, len(pdf), chunk):
                part = pdf.iloc[a : a + chunk]
                y, jac = net.jacobian(flat, part[list(inputs)].to_numpy(float))
                r = y - part[list(targets)].to_numpy(float)
                v += np.einsum("nop,no->p", jac, r)
                loss, n = loss + float((r * r).sum()), n + len(part)
        yield pd.DataFrame({"i": [0], "row": [np.array([*v, loss, n]).tobytes()]})

    total = _summed(df.select(*inputs, *targets).mapInPandas(run, "i long, row binary")).first()
    if total is None:
        return np.zeros(net.size), 0.0
    *v, loss, n = np.frombuffer(total["row"])
    return 2.0 * np.array(v) / max(n, 1.0), loss / max(n, 1.0)


def scheduled(df: DataFrame, net: Network, inputs: Sequence[str], targets: Sequence[str], phases: Sequence[Phase], seed: int = 0, damping: float = 1e-6) -> Iterator[tuple[int, str, float, np.ndarray]]:
    """(iteration, method, loss before an Adam step or after a Gauss-Newton one, parameters) over the phases in turn; a phase that stalls ends."""
    flat, done, adam = net.init(seed), 0, Adam(net.size)
    for phase in phases:
        if phase.method not in ("gauss_newton", "adam"):
            raise ValueError(f"unknown method {phase.method}")
        for k in range(phase.iterations):
            if phase.method == "adam":
                grad, loss = gradient(df, net, flat, inputs, targets)
                flat, size = flat + adam.step(grad, phase.rate_at(k)), 1.0
            else:
                flat, size, loss = step(df, net, flat, inputs, targets, damping)
            done += 1
            yield done, phase.method, loss, flat
            if size == 0.0:
                break


def predict_with_rate(df: DataFrame, net: Network, flat: np.ndarray, inputs: Sequence[str], along: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, y and dy: outputs and their derivative along a direction of the inputs (columns ``along``, the inputs' own rate in time)."""
    ship(df.sparkSession)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y, dy = net.tangent(flat, pdf[list(inputs)].to_numpy(float), pdf[list(along)].to_numpy(float))
            yield pdf[list(keys)].assign(y=list(y), dy=list(dy))

    return df.select(*dict.fromkeys([*keys, *inputs, *along])).mapInPandas(run, f"{kinds}, y array<double>, dy array<double>")


def effective_dimension(g: np.ndarray, damping: float) -> float:
    values = np.maximum(np.linalg.eigvalsh(g), 0.0)
    return float((values / (values + damping)).sum())


def step(df: DataFrame, net: Network, flat: np.ndarray, inputs: Sequence[str], targets: Sequence[str], damping: float = 1e-6, halvings: int = 12) -> tuple[np.ndarray, float, float]:
    """(new parameters, step size, loss): the first least loss over sizes 0, 1, 1/2, ...; 0 means stalled."""
    g, v, _, n = normal_equations(df, net, flat, inputs, targets)
    d = damped_direction(g, v, damping)
    sizes = [0.0, *[0.5**k for k in range(halvings)]]
    found = losses(df, net, [flat - s * d for s in sizes], inputs, targets)
    found = np.where(np.isnan(found), np.inf, found)
    k = int(np.argmin(found))
    return flat - sizes[k] * d, sizes[k], float(found[k]) / max(n, 1)


def fit(df: DataFrame, net: Network, inputs: Sequence[str], targets: Sequence[str], iterations: int, seed: int = 0, damping: float = 1e-6) -> Iterator[tuple[int, float, float, np.ndarray]]:
    """(iteration, loss, step size, parameters) of each step; ends where one stalls."""
    flat = net.init(seed)
    for k in range(1, iterations + 1):
        flat, size, loss = step(df, net, flat, inputs, targets, damping)
        yield k, loss, size, flat
        if size == 0.0:
            return
