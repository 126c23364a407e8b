"""Actions on gridded attributes: applied by column, flipped, turned, padded, cropped, differentiated, filtered."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def project(df: DataFrame, keys: Sequence[str], attrs: Sequence[str] | None = None) -> DataFrame:
    """Keys and the named attributes, whatever their case (None: all); names that aren't there are an error."""
    if attrs is None:
        return df
    own = {c.upper(): c for c in df.columns}
    absent = [a for a in attrs if a.upper() not in own]
    if absent:
        raise KeyError(f"no attribute {', '.join(absent)}")
    return df.select(*keys, *[F.col(own[a.upper()]) for a in attrs])


def apply(df: DataFrame, f: Callable[[Column], Column], attrs: Sequence[str]) -> DataFrame:
    """A function of columns on each attribute, in one projection."""
    return df.withColumns({a: f(F.col(a)) for a in attrs})


def apply_each_slice(df: DataFrame, f: Callable, by: str, schema: str) -> DataFrame:
    """A function of a time slice (a pandas frame) on every slice."""
    return df.groupBy(by).applyInPandas(f, schema)


def clipped(df: DataFrame, attrs: Sequence[str], low: float, high: float) -> DataFrame:
    return apply(df, lambda c: F.least(F.greatest(c, F.lit(low)), F.lit(high)), attrs)


def flipped(df: DataFrame, axis: str, n: int) -> DataFrame:
    """Cells counted from the other end of an axis of ``n``."""
    return df.withColumn(axis, F.lit(n - 1) - F.col(axis))


def turned(df: DataFrame, a: str, b: str, na: int, nb: int, times: int = 1) -> DataFrame:
    """Turned by quarters from axis ``a`` to axis ``b``: (a, b) goes to (nb - 1 - b, a)."""
    x, y, n, m = F.col(a), F.col(b), na, nb
    for _ in range(times % 4):
        x, y, n, m = F.lit(m - 1) - y, x, m, n
    return df.withColumns({a: x, b: y})


def padded(df: DataFrame, dims: dict[str, int], before: dict[str, int], after: dict[str, int], attrs: Sequence[str], fill: float) -> DataFrame:
    """Cells of the larger grid, addresses moved by ``before``; new cells hold ``fill``."""
    grid = None
    for a, n in dims.items():
        axis = df.sparkSession.range(n + before.get(a, 0) + after.get(a, 0)).select(F.col("id").cast("int").alias(a))
        grid = axis if grid is None else grid.crossJoin(axis)  # the grid itself is this product
    moved = df.withColumns({a: (F.col(a) + before.get(a, 0)).cast("int") for a in dims}).withColumn("__own", F.lit(True))
    return grid.join(moved, list(dims), "left").withColumns({c: F.when(F.col("__own"), F.col(c)).otherwise(F.lit(fill)) for c in attrs}).drop("__own")


def crops(df: DataFrame, dims: dict[str, int], shape: dict[str, int], size: int, seed: int) -> DataFrame:
    """Cells of ``size`` boxes of a shape at hashed places: ``crop`` and addresses within it. A cell is matched to a crop by its bounds."""
    at = df.sparkSession.range(size).select(F.col("id").cast("int").alias("crop"), *[F.pmod(F.xxhash64("id", F.lit(a), F.lit(seed)), F.lit(n - shape[a] + 1)).cast("int").alias(f"__{a}") for a, n in dims.items()])
    inside = [(F.col(a) >= F.col(f"__{a}")) & (F.col(a) < F.col(f"__{a}") + shape[a]) for a in dims]
    both = df.join(F.broadcast(at), inside)  # ``size`` rows
    return both.withColumns({a: F.col(a) - F.col(f"__{a}") for a in dims}).drop(*[f"__{a}" for a in dims])


def gradient(df: DataFrame, axis: str, across: Sequence[str], attr: str, out: str) -> DataFrame:
    """Central differences along an axis, one-sided at the ends of a row of cells, 0 where there is one cell."""
    w = Window.partitionBy(*across).orderBy(axis)
    before, after = F.lag(attr).over(w), F.lead(attr).over(w)
    alone = F.lag(F.lit(1)).over(w).isNull() & F.lead(F.lit(1)).over(w).isNull()
    inner = F.when(F.lag(F.lit(1)).over(w).isNull(), after - F.col(attr)).when(F.lead(F.lit(1)).over(w).isNull(), F.col(attr) - before).otherwise((after - before) / 2)
    return df.withColumn(out, F.when(alone, 0.0).otherwise(inner))


def filtered(df: DataFrame, axes: Sequence[str], dims: dict[str, int], attr: str, kernel: dict[tuple[int, ...], float], out: str) -> DataFrame:
    """A weighted stencil: every cell sends its value to the cells that see it; places off the grid hold the nearest edge.

    ``kernel`` maps offsets to weights. Values meet by address, one partial aggregate, no gathering of neighbours.
    """
    taps = F.explode(F.array(*[F.struct(*[F.lit(o).alias(a) for a, o in zip(axes, offset, strict=True)], F.lit(float(w)).alias("w")) for offset, w in kernel.items()]))
    want = df.select(*axes, taps.alias("__k"))
    place = lambda a: F.least(F.greatest(F.col(a) + F.col(f"__k.{a}"), F.lit(0)), F.lit(dims[a] - 1))
    want = want.select(*axes, F.col("__k.w").alias("__w"), *[place(a).alias(f"__{a}") for a in axes])
    source = df.select(*[F.col(a).alias(f"__{a}") for a in axes], F.col(attr).alias("__v"))
    summed = want.join(source, [f"__{a}" for a in axes]).groupBy(*axes).agg(F.sum(F.col("__w") * F.col("__v")).alias(out))
    return df.join(summed, list(axes), "left")


def downscaled(df: DataFrame, factors: dict[str, int]) -> DataFrame:
    """Each cell as ``factor`` cells along each axis, values kept; addresses count the finer grid."""
    out = df
    for a, f in factors.items():
        out = out.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(f - 1)))).withColumn(a, F.col(a) * f + F.col("__s")).drop("__s")
    return out


def gathered(index: DataFrame, table: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Values of a table at indices, one row an index; an index that isn't there gives null."""
    return index.join(table.select(key, *columns), key, "left")


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row a rule: its name, and how many rows break it; a rule that is null counts as broken."""
    broken = df.agg(*[F.count(F.when(~F.coalesce(r, F.lit(False)), 1)).alias(n) for n, r in rules.items()])
    return broken.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_broken")) for n in rules])).alias("r")).select("r.*")


def updated(old: Column, new: Column) -> tuple[Column, Column]:
    """A map after an update, and the keys whose value the update changed."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    changed = F.filter(F.map_keys(new), lambda k: F.array_contains(F.map_keys(old), k) & ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)))
    return F.map_concat(kept, new), changed
