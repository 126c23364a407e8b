"""Choosing modes: retention, allocation to components, adequacy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allocate_modes(shares: list[float], n: int) -> list[int]:
    """``n`` modes dealt to components by their shares of the total.

    Each gets the floor of its part, one at least. What is too much comes off the smallest
    that have more than one; what is left goes round from the largest, one each. Of equal
    shares the later component counts as the larger. Too few modes for one each is an error.
    """
    if n < len(shares):
        raise ValueError(f"{n} modes for {len(shares)} components: each needs one")
    if not shares:
        return []
    part = np.array(shares, float) / max(sum(shares), 1e-30)
    out = np.maximum(1, np.floor(n * part)).astype(int)
    rising = np.argsort(part, kind="stable")
    over = int(out.sum()) - n
    for k in rising:
        taken = min(max(over, 0), int(out[k]) - 1)
        out[k] -= taken
        over -= taken
    each, more = divmod(max(-over, 0), len(out))
    out += each
    out[rising[::-1][:more]] += 1
    return out.tolist()


def reserve(levels: int, n: int) -> int:
    """Vertical modes to keep room for."""
    return min(levels - 1, max(1, n // 8))


def retained(values: np.ndarray, vertical: np.ndarray, n: int, room: int, forced: int = 0) -> list[int]:
    """Places of the modes kept: the ``n`` lowest, with up to ``room`` vertical ones (share over 1/2) for the highest areal ones.

    The vertical block comes first, then the areal, each by value; ``forced`` leading modes stay.
    """
    order = np.argsort(values, kind="stable").tolist()
    kept, later = order[:n], order[n:]
    upright = lambda k: vertical[k] > 0.5
    missing = room - sum(map(upright, kept))
    more = [k for k in later if upright(k)][: max(missing, 0)]
    for k in more:
        areal = [a for a in kept[forced:] if not upright(a)]
        if not areal:
            break
        kept.remove(areal[-1])
        kept.append(k)
    rank = {k: i for i, k in enumerate(order)}
    return sorted(kept, key=lambda k: (not upright(k), rank[k]))


def adequate(features: np.ndarray, tol: float = 0.01) -> tuple[bool, int]:
    """Whether rounding to ``tol`` mean deviations tells all rows apart, and how many it tells."""
    cell = tol * features.std(0).mean()
    if cell == 0:
        return len(features) <= 1, min(1, len(features))
    n = len(np.unique(np.floor(features / cell + 0.5), axis=0))
    return n == len(features), n


def least_width(features: np.ndarray, tol: float = 0.01) -> int | None:
    """Fewest leading columns that are adequate; None if all aren't."""
    return next((k for k in range(1, features.shape[1] + 1) if adequate(features[:, :k], tol)[0]), None)


def distinct_by_width(df: DataFrame, vector: str, selections: Sequence[Sequence[int]], tol: float = 0.01) -> DataFrame:
    """width, n_rows, n_distinct and cell: how many rows each choice of columns tells apart, all choices in one pass.

    ``selections``: the columns of width 1, 2, ... - leading ones, or what ``retained`` keeps at that width. Values are rounded to
    ``tol`` mean deviations of the columns chosen. Rounded rows are known by 128 bits, so a row moves 24 bytes a
    width and equal ones combine before the shuffle; two different ones in one hash have a chance under 1e-18 a billion rows.
    Null vectors take no part; where no column varies all rows are one.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    used = sorted({c for s in selections for c in s})
    std = rows.agg(*[F.stddev_pop(F.get("v", F.lit(c))).alias(f"s{c}") for c in used]).first()  # a number a column
    cells = [tol * float(np.mean([std[f"s{c}"] or 0.0 for c in s])) for s in selections]
    each = []
    for s, cell in zip(selections, cells, strict=True):
        picked = F.slice("v", 1, len(s)) if list(s) == list(range(len(s))) else F.array(*[F.get("v", F.lit(int(c))) for c in s])
        scaled = F.transform(picked, lambda x: F.floor(x / F.lit(cell) + 0.5))  # noqa: B023
        q = scaled if cell > 0 else F.array().cast("array<bigint>")
        each.append(F.struct(F.lit(len(s)).alias("width"), F.xxhash64(q).alias("h1"), F.xxhash64(F.lit(1), q).alias("h2"), F.lit(cell).alias("cell")))
    keyed = rows.select(F.explode(F.array(*each)).alias("e")).select("e.*")
    counts = keyed.groupBy("width", "cell", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("width", "cell").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).select("width", "n_rows", "n_distinct", "cell")


def least_of(counts: DataFrame, share: float = 1.0) -> int | None:
    """The least width that tells at least ``share`` of the rows apart; None if none does."""
    return counts.filter(F.col("n_distinct") >= share * F.col("n_rows")).agg(F.min("width")).first()[0]
