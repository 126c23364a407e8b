"""Deterministic batches: strided rows, collocation times, history and forecast strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def positions(n_rows: int, n: int) -> list[int]:
    """``n`` distinct evenly spaced places of ``n_rows``, ends included, halves to even."""
    if n >= n_rows:
        return list(range(n_rows))
    return sorted({round(i * (n_rows - 1) / max(n - 1, 1)) for i in range(n)})


def linear_times(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("k"), (F.lit(lo) + F.col("id") * ((hi - lo) / max(n - 1, 1))).alias("t"))


def middle_times(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    """``lo + (k + 1/2) step``."""
    return spark.range(n).select(F.col("id").alias("k"), (F.lit(lo) + (F.col("id") + 0.5) * ((hi - lo) / n)).alias("t"))


def random_times(spark: SparkSession, lo: float, hi: float, n: int, seed: int) -> DataFrame:
    """Uniform draws by hash: the same for any plan."""
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return spark.range(n).select(F.col("id").alias("k"), (F.lit(lo) + u * (hi - lo)).alias("t"))


def strata(t_end: float, observed_end: float, n: int, least: int = 1) -> list[tuple[float, float, int]]:
    """(lo, hi, slices) of history and forecast in proportion to their length; one of them if the other is empty."""
    if observed_end >= t_end:
        return [(0.0, t_end, n)]
    first = min(max(round(n * observed_end / t_end), least), n - least)
    return [(0.0, observed_end, first), (observed_end, t_end, n - first)]


def window(df: DataFrame, id_col: str, n: int, seed: int, replace: bool, n_rows: int | None = None) -> DataFrame:
    """A random batch: without replacement by the least hashes; with it by hashed draws of dense ids."""
    if not replace:
        return df.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(n)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_rows)).alias("__row"))
    return draws.join(df, F.col("__row") == F.col(id_col)).drop("__row")


def capped(df: DataFrame, place: str, n_rows: int, n: int) -> DataFrame:
    """Rows at evenly spaced places; their list is ``n`` long and broadcast."""
    keep: Sequence[int] = positions(n_rows, n)
    chosen = df.sparkSession.createDataFrame([(k,) for k in keep], "__p long")
    return df.join(F.broadcast(chosen), F.col(place) == F.col("__p"), "left_semi")
