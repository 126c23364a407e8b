"""Weighted, robust and residual aggregates.

Totals over everything are one partial aggregate and a one-row broadcast; no window runs
over a single partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_totals(df: DataFrame, *totals: Column) -> DataFrame:
    """Every row with aggregates over all rows."""
    return df.crossJoin(F.broadcast(df.agg(*totals)))


def allocate(df: DataFrame, by: Sequence[str], total: str, weight: str, out: str = "allocated") -> DataFrame:
    """A group's total over its members by weight: ``total * w / max(sum w, 1e-30)``."""
    s = F.sum(weight).over(Window.partitionBy(*by))
    return df.withColumn(out, F.col(total) * F.col(weight) / F.greatest(s, F.lit(1e-30)))


def allocate_or_equal(df: DataFrame, by: Sequence[str], total: str, weight: str, out: str = "allocated") -> DataFrame:
    """As ``allocate``; equal parts where the weights don't add up to more than 0."""
    w = Window.partitionBy(*by)
    s = F.coalesce(F.sum(weight).over(w), F.lit(0.0))
    return df.withColumn(out, F.col(total) * F.when(s > 0, F.coalesce(F.col(weight), F.lit(0.0)) / s).otherwise(1 / F.count(F.lit(1)).over(w)))


def weighted_mean(df: DataFrame, by: Sequence[str], value: str, weight: str, out: str = "mean") -> DataFrame:
    """Mean by owner; weights that are null, not finite or not positive count as 1."""
    w = F.when(F.col(weight).isNotNull() & ~F.isnan(weight) & (F.col(weight) > 0), F.col(weight)).otherwise(F.lit(1.0))
    return df.groupBy(*by).agg((F.sum(w * F.col(value)) / F.sum(F.when(F.col(value).isNotNull(), w))).alias(out))


def layer_profile(df: DataFrame, layer: str, value: str) -> DataFrame:
    """Mean of each layer and the midpoint to the next one's mean."""
    means = df.groupBy(layer).agg(F.avg(value).alias("mean"))
    w = Window.orderBy(layer)  # one row a layer
    return means.withColumn("boundary", (F.col("mean") + F.lead("mean").over(w)) / 2)


def robust_scale(value: Column, floor: float) -> Column:
    """``max(population std, 0.05 * mean |v|, floor)`` over non-null values."""
    return F.greatest(F.coalesce(F.stddev_pop(value), F.lit(floor)), F.coalesce(0.05 * F.avg(F.abs(value)), F.lit(floor)), F.lit(floor))


def phase_scales(df: DataFrame, phase: str, value: str, control: str, out: str = "scale") -> DataFrame:
    """Robust scale of each phase with a floor from its control magnitude, and at least 1e-3 of the largest."""
    floor = F.greatest(F.coalesce(0.05 * F.avg(F.abs(control)), F.lit(1.0)), F.lit(1.0))
    scales = df.groupBy(phase).agg(F.greatest(F.coalesce(F.stddev_pop(value), F.lit(0.0)), F.coalesce(0.05 * F.avg(F.abs(value)), F.lit(0.0)), floor).alias("__s"))
    return with_totals(scales, F.max("__s").alias("__m")).select(phase, F.greatest("__s", F.col("__m") * 1e-3).alias(out))


def widened_range(df: DataFrame, by: Sequence[str], value: str, sigmas: float = 1.5, low: float | None = None, high: float | None = None) -> DataFrame:
    """``min - sigmas * std`` to ``max + sigmas * std``, kept inside the bounds and not empty."""
    spread = sigmas * F.coalesce(F.stddev_pop(value), F.lit(0.0))
    lo, hi = F.min(value) - spread, F.max(value) + spread
    lo = F.greatest(lo, F.lit(low)) if low is not None else lo
    hi = F.least(hi, F.lit(high)) if high is not None else hi
    r = df.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi"))
    return r.withColumn("hi", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1.0))


def clipped(value: Column, lo: Column, hi: Column) -> Column:
    """Null and NaN go to the low end."""
    return F.coalesce(F.least(F.greatest(F.nanvl(value, lo), lo), hi), lo)


def rmse(df: DataFrame, by: Sequence[str], predicted: str, observed: str, out: str = "rmse") -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col(predicted) - F.col(observed), 2))).alias(out))


def group_losses(df: DataFrame, group: str, residual: str, weights: dict[str, float]) -> DataFrame:
    """Mean square of each group and its weighted part of the total."""
    weight = F.lit(0.0)
    for k, v in weights.items():
        weight = F.when(F.col(group) == k, v).otherwise(weight)
    g = df.groupBy(group).agg(F.avg(F.col(residual) * F.col(residual)).alias("loss"), F.count(residual).alias("n"))
    return g.withColumn("weighted", weight * F.col("loss"))


def residual_rows(df: DataFrame, group: str, residual: str, weight: Column, out: str = "row") -> DataFrame:
    """``sqrt(w / n) * r``: the squares of a group add up to its weighted loss. Counts come by a join that Spark broadcasts only if they turn out small, so a large group isn't gathered."""
    n = df.groupBy(group).agg(F.count(residual).alias("__n"))
    return df.join(n, group).withColumn(out, F.sqrt(weight / F.col("__n")) * F.col(residual)).drop("__n")


def quantized_distinct(df: DataFrame, vector: str, size: int, tol: float) -> DataFrame:
    """Number of rows and of distinct vectors after rounding to a lattice of ``tol`` mean deviations (exact)."""
    std = df.agg(*[F.stddev_pop(F.col(vector)[i]).alias(f"s{i}") for i in range(size)])
    cell = std.select((sum((F.col(f"s{i}") for i in range(size)), F.lit(0.0)) / size * tol).alias("__cell"))
    rounded = df.crossJoin(F.broadcast(cell)).select(F.transform(vector, lambda v: F.floor(v / F.col("__cell") + 0.5)).alias("q"))
    return rounded.groupBy("q").count().agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_distinct"))


def blind_fraction(df: DataFrame, vector: str, size: int, share: float = 0.01) -> DataFrame:
    """Share of rows whose centred norm is under ``share`` of the largest."""
    mean = df.agg(F.array(*[F.avg(F.col(vector)[i]) for i in range(size)]).alias("__mean"))
    norm = df.crossJoin(F.broadcast(mean)).select(F.sqrt(F.aggregate(F.zip_with(vector, "__mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).alias("n"))
    return with_totals(norm, F.max("n").alias("m")).agg(F.avg((F.col("n") < share * F.col("m")).cast("double")).alias("blind"))


def anova_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """Sum of squares within groups over the total one, from one pass of group sums."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.sum(F.col("n") * F.col("v")).alias("within"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    return t.select((F.col("within") / (F.col("within") + F.col("q") - F.col("s") * F.col("s") / F.col("n"))).alias("within_share"))


def share_keep(df: DataFrame, by: Sequence[str], weight: str, least: float) -> DataFrame:
    """Each group's share of all weight, and whether it reaches ``least``."""
    g = df.groupBy(*by).agg(F.sum(weight).alias("weight"))
    return with_totals(g, F.sum("weight").alias("__t")).select(*by, (F.col("weight") / F.col("__t")).alias("share"), (F.col("weight") / F.col("__t") >= least).alias("keep"))


def assemble(df: DataFrame, row: str, col: str, val: str) -> DataFrame:
    """Sparse triplets with equal places added up."""
    return df.groupBy(row, col).agg(F.sum(val).alias("val"))


def matvec(triplets: DataFrame, vector: DataFrame, row: str = "row", col: str = "col", val: str = "val", x: str = "x") -> DataFrame:
    """``A x`` for triplets and (col, x)."""
    return triplets.join(vector, col).groupBy(row).agg(F.sum(F.col(val) * F.col(x)).alias("y"))


def gramian(df: DataFrame, columns: Sequence[str], residual: str) -> DataFrame:
    """(i, j, g) of ``J^T J`` (upper half) and (i, -1) for ``2 J^T r``, in one partial aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in pairs] + [2 * F.sum(F.col(c) * F.col(residual)) for c in columns]
    names = pairs + [(i, -1) for i in range(len(columns))]
    one = df.agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), s.alias("g")) for (i, j), s in zip(names, sums, strict=True)]).alias("a"))
    return one.select(F.explode("a").alias("e")).select("e.i", "e.j", "e.g")


def upscale(df: DataFrame, keys: dict[str, int], aggregates: Sequence[Column]) -> DataFrame:
    """Blocks of ``floor(key / factor)``."""
    return df.groupBy(*[F.floor(F.col(k) / f).alias(k) for k, f in keys.items()]).agg(*aggregates)


def add_aligned(parts: Sequence[DataFrame], node: str, date: str, value: str) -> DataFrame:
    """Series of several children added by date (absent: 0) and accumulated over dates."""
    rows = parts[0].select(node, date, value)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(node, date, value))
    total = rows.groupBy(node, date).agg(F.sum(value).alias("total"))
    return total.withColumn("cumulative", F.sum("total").over(Window.partitionBy(node).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)))


def relative_error(predicted: Column, observed: Column, least: float = 1.0) -> Column:
    """``|predicted - observed| / max(observed, least)``."""
    return F.abs(predicted - observed) / F.greatest(observed, F.lit(least))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of each group, exact, and ``top``, the largest value; nulls don't count.

    Equal values are counted first; ranks come from a range sort in parts and the two neighbours of
    each place are picked by rank, so no group is held in one task.
    """
    from terrane.operators.windows import running_counts

    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranked = running_counts(counted, [*by, "__v"], "__n", "__end")  # rows up to and with a value, over all groups
    ends = ranked.groupBy(*by).agg(F.min(F.col("__end") - F.col("__n")).alias("__start"), F.max("__end").alias("__stop"), F.max("__v").alias("top"))
    place = {k: q * (F.col("__stop") - F.col("__start") - 1) for k, q in at.items()}
    x = ranked.join(ends, list(by))
    holds = lambda r: (F.col("__end") - F.col("__n") - F.col("__start") <= r) & (r < F.col("__end") - F.col("__start"))
    low = {f"__l_{k}": F.max(F.when(holds(F.floor(p)), F.col("__v"))) for k, p in place.items()}
    high = {f"__h_{k}": F.max(F.when(holds(F.ceil(p)), F.col("__v"))) for k, p in place.items()}
    part = {f"__p_{k}": F.max(p - F.floor(p)) for k, p in place.items()}
    out = x.groupBy(*by).agg(F.max("top").alias("top"), *[c.alias(n) for n, c in (low | high | part).items()])
    return out.select(*by, *[(F.col(f"__l_{k}") + F.col(f"__p_{k}") * (F.col(f"__h_{k}") - F.col(f"__l_{k}"))).alias(k) for k in at], "top")


def largest(df: DataFrame, by: Sequence[str], kind: str, value: str) -> DataFrame:
    """The kind with the largest total of each group, ties to the first by name, and that ``total``."""
    t = df.groupBy(*by, kind).agg(F.sum(value).alias("total"))
    best = t.groupBy(*by).agg(F.min_by(F.struct(kind, "total"), F.struct((-F.col("total")).alias("t"), kind)).alias("b"))
    return best.select(*by, F.col(f"b.{kind}").alias(kind), "b.total")


def rmse_mean(df: DataFrame, step: str, predicted: str, observed: str, steps: int) -> DataFrame:
    """One row: the mean over ``steps`` evenly spaced steps of each one's RMSE, and that of the last step."""
    from terrane.operators.joins import even_subset

    each = rmse(even_subset(df, step, steps), [step], predicted, observed)
    return each.agg(F.avg("rmse").alias("mean"), F.max_by("rmse", step).alias("final"), F.count("*").alias("n"))
