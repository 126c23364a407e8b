"""Time-ordered operators: as-of joins, fills, clocks and interpolation in time.

An as-of join is a union and one ``last(ignore nulls)`` over the key's time order: one
shuffle by key, no inequality join, so a long schedule costs its rows and not its pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, order: Sequence[str] = (), name: str = "match") -> DataFrame:
    """Each left row with the struct of the latest right row at or before it (null: none).

    ``by`` columns are in both. Right rows of one time are ordered by ``order``, the last wins.
    Right rows with a null time never match; left rows with one find nothing.
    """
    keep = [c for c in left.columns]
    probe = left.select(*by, F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*keep).alias("__l"), F.lit(None).cast(right.select(F.struct(*right.columns).alias("x")).schema["x"].dataType).alias("__r"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__o{i}") for i, c in enumerate(order)])
    build = right.filter(F.col(right_ts).isNotNull()).select(*by, F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(probe.schema["__l"].dataType).alias("__l"), F.struct(*right.columns).alias("__r"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    w = Window.partitionBy(*by).orderBy(F.col("__t").asc_nulls_first(), "__side", *[f"__o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    both = probe.unionByName(build).withColumn("__m", F.when(F.col("__t").isNotNull(), F.last("__r", ignorenulls=True).over(w)))
    return both.filter("__side = 1").select("__l.*", F.col("__m").alias(name))


def asof_precedence(left: DataFrame, sources: Sequence[tuple[str, DataFrame]], by: Sequence[str], left_ts: str, right_ts: str, order: Sequence[str] = (), name: str = "match") -> DataFrame:
    """As-of over several sources at once: the newest row wins, ties go to the first source listed.

    Within a source, rows of one time are ordered by ``order``, the last wins.

    All sources have the same columns; the match carries ``source``. One shuffle for all of them.
    """
    rows = None
    for rank, (label, df) in enumerate(sources):
        one = df.withColumn("source", F.lit(label)).withColumn("__rank", F.lit(-rank))
        rows = one if rows is None else rows.unionByName(one)
    return asof(left, rows, by, left_ts, right_ts, order=["__rank", *order], name=name)


def asof_or_first(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, name: str = "match") -> DataFrame:
    """As-of, or the key's first right row where none is early enough.

    Right rows with a null time are always early enough and come before all others (of several the greatest).
    """
    whole = F.struct(*right.columns)
    timeless = F.max(F.when(F.col(right_ts).isNull(), whole))
    first = right.groupBy(*by).agg(F.coalesce(timeless, F.min_by(whole, F.col(right_ts))).alias("__first"))
    return asof(left, right, by, left_ts, right_ts, name=name).join(first, list(by), "left").withColumn(name, F.coalesce(F.col(name), F.col("__first"))).drop("__first")


def fill(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str = "filled") -> DataFrame:
    """Forward fill from the last value, then back fill before the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    forward = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    backward = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(forward, backward))


def transient(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, boost: float, out: str = "boost") -> DataFrame:
    """``1 + boost * |step| / max |step|``; the first row's step is 0, the maximum is over all rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    stepped = df.withColumn("__step", F.abs(F.col(value) - F.lag(value, 1).over(w))).withColumn("__step", F.coalesce("__step", F.lit(0.0)))
    top = stepped.agg(F.max("__step").alias("__top"))
    ratio = F.when(F.col("__top") > 0, F.col("__step") / F.col("__top")).otherwise(0.0)
    return stepped.crossJoin(F.broadcast(top)).withColumn(out, 1 + boost * ratio).drop("__step", "__top")


def running_clock(df: DataFrame, by: Sequence[str], order: Sequence[str], reset: Column, step: Column, out: str = "clock") -> DataFrame:
    """A clock that ``reset`` (non-null) sets and ``step`` advances, row by row; null before the first reset."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__reset", reset).withColumn("__step", F.when(F.col("__reset").isNull(), F.coalesce(step, F.lit(0.0))).otherwise(0.0))
    marked = marked.withColumn("__island", F.count("__reset").over(w))
    inner = Window.partitionBy(*by, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(out, F.first("__reset").over(inner) + F.sum("__step").over(inner)).drop("__reset", "__step", "__island")


def report_days(ts: Column, first: Column) -> Column:
    """Fractional days since the first report."""
    return (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / F.lit(8.64e10)


def interpolate_at(left: DataFrame, series: DataFrame, by: Sequence[str], left_x: str, x: str, y: str, out: str = "value") -> DataFrame:
    """Linear interpolation of (x, y) at each left row, held at both ends; null for a key without a series."""
    w = Window.partitionBy(*by).orderBy(x)
    seg = series.select(*by, x, y, F.lead(x).over(w).alias("__x1"), F.lead(y).over(w).alias("__y1"))
    first = series.groupBy(*by).agg(F.min(F.struct(x, y)).alias("__f"))
    m = asof(left, seg, by, left_x, x, name="__m").join(first, list(by), "left")
    x0, y0, x1, y1 = (F.col(f"__m.{c}") for c in (x, y, "__x1", "__y1"))
    value = F.when(F.col("__m").isNull(), F.col(f"__f.{y}")).when(x1.isNull(), y0).otherwise(y0 + (y1 - y0) * (F.col(left_x) - x0) / (x1 - x0))
    return m.withColumn(out, value).drop("__m", "__f")
