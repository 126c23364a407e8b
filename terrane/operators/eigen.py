"""The lowest pairs of ``A x = l M x`` over sparse tables: block iteration (LOBPCG) as joins and sums, one solve a component.

Vectors are columns of a vertex table and stay there. A round multiplies the new search directions by both operators
in one join with their entries and one sum by row; small Gram blocks are added up by component and entry; the driver only
ever holds those, ``4 n`` squared a component, and sends back the mixing weights. All components advance together, each with its own
number of modes, so a mesh in many pieces costs no more rounds than one piece.

Vectors to deflate (the column space of a tall mesh, or modes known already) go along as columns of their own: the
search stays orthogonal to them in M. Rounds are written tables; a lost executor costs its part of one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.plans.shipping import ship
from terrane.plans.storage import discard, written

#: Blocks of a vertex: deflated, present, new and last directions.
BLOCKS = ("y", "x", "w", "p")
_NAMES = [f"{o}{b}" for b in BLOCKS for o in ("", "a", "m")]
_STATE = "vertex_id long, component long, scale double, " + ", ".join(f"{c} array<double>" for c in _NAMES)
#: Directions shorter than this share of the longest count as none: a value's error goes with their square.
_NONE = 1e-7


def products(entries: DataFrame, vectors: DataFrame, column: str, width: int) -> DataFrame:
    """vertex_id, and the arrays ``A v`` and ``M v`` (a, m) of the arrays in ``column``: one join by col, one sum by row.

    ``entries``: row, col, a, m. Sums are plain expressions, so they combine before the shuffle.
    """
    v = vectors.select(F.col("vertex_id").alias("col"), F.col(column).alias("__v"))
    sums = [F.sum(F.col(o) * F.get("__v", F.lit(k))).alias(f"{o}{k}") for o in "am" for k in range(width)]
    s = entries.join(v, "col").groupBy(F.col("row").alias("vertex_id")).agg(*sums)
    return s.select("vertex_id", *[F.array(*[F.coalesce(f"{o}{k}", F.lit(0.0)) for k in range(width)]).alias(o) for o in "am"])


def _stack(pdf: pd.DataFrame, column: str) -> np.ndarray:
    return np.array(pdf[column].tolist(), float).reshape(len(pdf), -1)


def grams(state: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """S^T A S and S^T M S of each component, S all blocks side by side: added up in each part, then by entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for c, part in pdf.groupby("component"):
                s, a, m = (np.concatenate([_stack(part, f"{o}{b}") for b in BLOCKS], 1) for o in ("", "a", "m"))
                g = np.stack([s.T @ a, s.T @ m])
                total[c] = total[c] + g if c in total else g
        for c, g in total.items():
            yield pd.DataFrame({"component": c, "entry": range(g.size), "value": g.ravel()})

    rows = state.drop("vertex_id", "scale").mapInPandas(run, "component long, entry long, value double").groupBy("component", "entry").agg(F.sum("value").alias("value"))
    out: dict = {}
    for r in rows.collect():  # (4 n)^2 a component, whatever the mesh
        out.setdefault(r["component"], {})[r["entry"]] = r["value"]
    squares = {c: np.array([v[k] for k in range(len(v))]) for c, v in out.items()}
    return {c: tuple((g + g.T) / 2 for g in v.reshape(2, *[int(np.sqrt(len(v) // 2))] * 2)) for c, v in squares.items()}


def ritz(a: np.ndarray, m: np.ndarray, known: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, weights) of the ``n`` lowest pairs in a span given by its Gram blocks, orthogonal in M to its first ``known`` columns.

    Columns that add nothing to the span are left out, so that dependent directions do no harm.
    """
    size = np.sqrt(np.maximum(np.diag(m), 0.0))
    use = np.flatnonzero(size > _NONE * max(size.max(initial=0.0), 1e-300))
    to = np.zeros((len(m), len(use)))
    to[use, range(len(use))] = 1 / size[use]
    first = int((use < known).sum())
    if first:
        g = to.T @ m @ to
        to[:, first:] -= to[:, :first] @ np.linalg.lstsq(g[:first, :first], g[:first, first:], rcond=1e-12)[0]
    free = to[:, first:]
    values, q = np.linalg.eigh(free.T @ m @ free)
    span = free @ (q[:, values > 1e-11] / np.sqrt(values[values > 1e-11]))
    values, q = np.linalg.eigh(span.T @ a @ span)
    return values[:n], span @ q[:, :n]


def lowest(entries: DataFrame, vertices: DataFrame, wanted: dict[int, int] | int, rounds: int = 120, tol: float = 1e-7, known: str | None = None, seed: int = 0) -> tuple[dict[int, np.ndarray], DataFrame]:
    """({component: values}, vectors): the lowest pairs of each component, ascending.

    ``entries``: row, col, a, m of both operators (missing ones are 0). ``vertices``: vertex_id and component, and with ``known``
    an array column of vectors to deflate. ``wanted`` is how many modes a component gets (one number for all, or by component).
    ``vectors`` has vertex_id, component, mode (from 0) and psi, with ``psi^T M psi = 1``; a written table. A component with fewer
    vertices than modes wanted gets as many as it has. Ends when no value moves by more than ``tol`` of its
    component's largest; a round limit that is met before is an error.
    """
    ship(entries.sparkSession)
    entries = written(entries.select(F.col("row").cast("long"), F.col("col").cast("long"), F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("m", F.lit(0.0)).alias("m")))
    counts = {r["component"]: r["count"] for r in vertices.groupBy("component").count().collect()}  # a row a component
    want = {c: min(n, wanted if isinstance(wanted, int) else wanted.get(c, 0)) for c, n in counts.items()}
    want = {c: n for c, n in want.items() if n > 0}
    if not want:
        return {}, entries.sparkSession.createDataFrame([], "vertex_id long, component long, mode int, psi double")
    width = max(want.values())
    diagonal = entries.filter("row = col").groupBy(F.col("row").alias("vertex_id")).agg(F.sum("a").alias("scale"))
    start = [(F.rand(seed * 1000 + k) - 0.5) for k in range(width)]
    state = vertices.filter(F.col("component").isin(list(want))).select(F.col("vertex_id").cast("long"), F.col("component").cast("long"), (F.col(known) if known else F.array().cast("array<double>")).alias("y"))
    state = written(state.join(diagonal, "vertex_id", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0))).withColumn("w", F.array(*start)))
    deep = state.select(F.max(F.size("y"))).first()[0] or 0
    none = F.array(*[F.lit(0.0)] * width)

    def multiplied(rows: DataFrame, column: str, size: int) -> DataFrame:
        got = products(entries, rows, column, size).select("vertex_id", F.col("a").alias(f"a{column}"), F.col("m").alias(f"m{column}"))
        return rows.join(got, "vertex_id", "left").withColumns({f"{o}{column}": F.coalesce(f"{o}{column}", F.array(*[F.lit(0.0)] * size)) for o in "am"})

    rows = multiplied(state, "y", deep) if deep else state.withColumns({"ay": F.col("y"), "my": F.col("y")})
    rows = multiplied(rows, "w", width).withColumns({f"{o}{b}": none for b in "xp" for o in ("", "a", "m")})
    order = [c.split()[0] for c in _STATE.split(", ")]
    now, values = written(rows.select(*order)), {}
    discard(state)

    def mixed(weights: dict[int, tuple[np.ndarray, np.ndarray]]):
        """The state after a round: x and p by the weights, w the scaled residual."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for c, part in pdf.groupby("component"):
                    theta, q = weights[c]
                    full = np.zeros((q.shape[0], width))
                    full[:, : q.shape[1]] = q
                    moved = full.copy()
                    moved[deep : deep + width] = 0
                    out = part[["vertex_id", "component", "scale", "y", "ay", "my"]].copy()
                    blocks = {o: np.concatenate([_stack(part, f"{o}{b}") for b in BLOCKS], 1) for o in ("", "a", "m")}
                    for o, s in blocks.items():
                        out[f"{o}x"], out[f"{o}p"] = list(s @ full), list(s @ moved)
                    away = blocks["a"] @ full - (blocks["m"] @ full) * np.pad(theta, (0, width - len(theta)))
                    out["w"] = list(away / np.maximum(part["scale"].to_numpy()[:, None], 1e-12))
                    out["aw"] = out["mw"] = [np.zeros(width)] * len(out)
                    yield out[order]

        return run

    for _ in range(rounds):
        weights = {c: ritz(a, m, deep, want[c]) for c, (a, m) in grams(now).items()}
        before, values = values, {c: w[0] for c, w in weights.items()}
        mix = now.mapInPandas(mixed(weights), _STATE)
        still = all(c in before and len(before[c]) == len(v) and np.abs(v - before[c]).max(initial=0) <= tol * max(1e-300, np.abs(v).max(initial=0)) for c, v in values.items())
        if still:
            break
        newer = written(multiplied(mix.drop("aw", "mw"), "w", width).select(*order))
        discard(now)
        now = newer
    else:
        raise RuntimeError(f"eigenpairs did not settle in {rounds} rounds")
    many = F.create_map(*[F.lit(int(k)) for c, v in values.items() for k in (c, len(v))])
    vectors = mix.select("vertex_id", "component", F.posexplode("x").alias("mode", "psi")).filter(F.col("mode") < many[F.col("component")])
    vectors = written(vectors)
    discard(now, entries)
    return {c: np.maximum(v, 0.0) for c, v in values.items()}, vectors


def stratified(entries: DataFrame, vertices: DataFrame, weight: str, n: int, **options) -> tuple[dict[int, np.ndarray], DataFrame]:
    """``n`` modes over all components, dealt by their share of ``weight`` (one each at least), as ``lowest`` returns them."""
    from terrane.operators.spectral import allocate_modes

    shares = vertices.groupBy("component").agg(F.sum(weight).alias("s")).orderBy("component").collect()  # a row a component
    return lowest(entries, vertices, dict(zip([r["component"] for r in shares], allocate_modes([r["s"] for r in shares], n), strict=True)), **options)
