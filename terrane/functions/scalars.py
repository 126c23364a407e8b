"""Scalar and small aggregate expressions of the well, deck and sampling operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_finite(*columns: Column) -> Column:
    """First value that is neither null nor NaN nor infinite."""
    ok = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), c)
    return F.coalesce(*[ok(c) for c in columns])


def first_text(*columns: Column) -> Column:
    """First non-empty text, trimmed and upper-cased."""
    return F.coalesce(*[F.nullif(F.upper(F.trim(c)), F.lit("")) for c in columns])


def clean_name(c: Column) -> Column:
    """A keyword's name: quotes and blanks off, upper case."""
    return F.upper(F.btrim(c, F.lit("'\" ")))


def category(boundary: Column, well: Column, aquifer: Column) -> Column:
    """Vertex category; boundary goes before well, well before aquifer."""
    return F.when(boundary, "boundary").when(well, "well").when(aquifer, "aquifer").otherwise("interior")


def layers(k1: Column, k2: Column) -> Column:
    """All layers of a completion, in order even if its ends are swapped."""
    return F.sequence(F.least(k1, k2), F.greatest(k1, k2))


def expand_repeats(tokens: Column) -> Column:
    """``n*v`` as n times v; ``n*`` as n nulls."""
    one = lambda t: F.when(t.rlike(r"^\d+\*"), F.array_repeat(F.nullif(F.regexp_extract(t, r"^\d+\*(.*)$", 1), F.lit("")), F.regexp_extract(t, r"^(\d+)\*", 1).cast("int"))).otherwise(F.array(t))
    return F.flatten(F.transform(tokens, one))


def strip_comment(line: Column) -> Column:
    return F.upper(F.trim(F.substring_index(line, "--", 1)))


def tokens(line: Column) -> Column:
    """Quote-aware tokens of a line without its comment and slashes."""
    found = F.regexp_extract_all(F.substring_index(line, "--", 1), F.lit(r"'[^']*'|\"[^\"]*\"|[^\s/'\"]+"), F.lit(0))
    return F.transform(found, clean_name)


def control_kind(mode: Column, control: Column, rate: Column, bhp: Column) -> Column:
    """closed, rate, bhp or null, from a schedule row."""
    return (
        F.when(F.upper(mode).isin("STOP", "SHUT", "CLOSE", "CLOSED"), "closed")
        .when(F.upper(control).isin("ORAT", "WRAT", "GRAT", "LRAT", "RESV", "RATE"), "rate")
        .when(F.upper(control).isin("BHP", "THP"), "bhp").when(rate.isNotNull(), "rate").when(bhp.isNotNull(), "bhp")
    )


def binding(observed: str, controlled: str, has_bhp: Column) -> Column:
    """The BHP limit binds: the observed rate is strictly under 99 % of the controlled one."""
    return (F.abs(observed) < 0.99 * F.abs(controlled)) & has_bhp


def flow_direction(is_rate: Column, q_ctrl: Column, channels: Column) -> Column:
    """Sign of the control, or of the channels that aren't zero."""
    return F.when(is_rate, F.signum(q_ctrl)).otherwise(F.signum(channels))


def well_index(cf: Column, h: Column, k11: Column, k22: Column, r_e: Column, r_w: Column, skin: Column, conversion: float = 0.001127) -> Column:
    """Connection factor over its conversion where given and positive, else Peaceman's index; r_w is 0.5 ft by default."""
    peaceman = 2 * F.pi() * h * F.sqrt(k11 * k22) / (F.ln(r_e / F.coalesce(r_w, F.lit(0.5))) + F.coalesce(skin, F.lit(0.0)))
    return F.coalesce(F.when(cf > 0, cf / conversion), peaceman)


def closed_form_bhp(q_pin: str, a: str, lift: Column, low: float, high: float) -> Column:
    """``(q + sum a (p - gamma dz)) / max(sum a, 1e-12)`` over a well's perforations, clipped; an aggregate with q_pin grouped."""
    p = (F.col(q_pin) + F.sum(F.col(a) * lift)) / F.greatest(F.sum(a), F.lit(1e-12))
    return F.least(F.greatest(p, F.lit(low)), F.lit(high))


def anchored_sigmoid(y: Column, low: float, high: float) -> Column:
    return low + (high - low) / (1 + F.exp(-y))


def log_time(t: Column, t0: float, scale: float) -> Column:
    """Warped time channel; ``unlog_time`` is its inverse."""
    return F.log1p((t - t0) / scale)


def unlog_time(tau: Column, t0: float, scale: float) -> Column:
    return t0 + scale * F.expm1(tau)


def time_channel(t: Column, t_end: float, warp: float | None = None) -> Column:
    """Time as a feature from -1 to 1: linear, or by logarithm over ``warp``."""
    part = t / t_end if warp is None else F.log1p(t / warp) / math.log1p(t_end / warp)
    return 2 * part - 1


def time_of_channel(tau: Column, t_end: float, warp: float | None = None) -> Column:
    """Inverse of ``time_channel``."""
    part = (tau + 1) / 2
    return part * t_end if warp is None else warp * F.expm1(part * math.log1p(t_end / warp))


def warp_scores(df: DataFrame, by: Sequence[str], order: str, elapsed: str, candidates: Sequence[float]) -> DataFrame:
    """Mean log spacing of warped times for each candidate scale: one window, all candidates in the row."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(elapsed).over(w)
    gaps = df.withColumn("__b", before).filter("__b IS NOT NULL")
    each = gaps.select(F.explode(F.array(*[F.struct(F.lit(float(c)).alias("c"), F.ln(F.ln(1 + F.col(elapsed) / c) - F.ln(1 + F.col("__b") / c)).alias("v")) for c in candidates])).alias("x"))
    return each.groupBy(F.col("x.c").alias("c")).agg(F.avg("x.v").alias("score"))


def sample_rows(df: DataFrame, id_col: str, seed: int, n: int) -> DataFrame:
    """``n`` rows without replacement, by a hash of id and seed: the plan doesn't change the draw."""
    return df.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"/{seed}"))), id_col).limit(n)


def draw_with_replacement(spark, n_rows: int, n: int, seed: int) -> DataFrame:
    """(draw, row): ``n`` hashed draws from 0 to n_rows - 1."""
    return spark.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_rows)).alias("row"))
