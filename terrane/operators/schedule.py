"""Schedule-wide masks, flags, limits and merges of well tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.plans.shipping import ship

#: Oil saturation below which dissolved gas isn't observed, floor of a residual's scale.
OIL_EPS, SCALE_FLOOR = 1e-3, 1e-12


def in_span(t: Column, low: float, high: float, reach: float | None = None) -> Column:
    """Whether a time lies in [low, high], with room for rounding; ``reach`` is the span's end that the room follows."""
    eps = max(1e-6, 1e-6 * max(abs(high if reach is None else reach), 1.0))
    return t.between(low - eps, high + eps)


def gas_is_observed(sw: Column, sg: Column) -> Column:
    """Whether a cell has oil that holds gas."""
    return 1 - sw - sg > OIL_EPS


def slice_view(cells: DataFrame, **bounds: tuple[int | None, int | None]) -> DataFrame:
    """Cells whose indices lie within inclusive bounds, such as ``k=(7, None)``; None is open."""
    for axis, (low, high) in bounds.items():
        if low is not None:
            cells = cells.filter(F.col(axis) >= low)
        if high is not None:
            cells = cells.filter(F.col(axis) <= high)
    return cells


def injector_flags(steps: DataFrame) -> DataFrame:
    """is_inj and inj_phase of (report_step, well, is_rate, q_ctrl, ctrl_phase, inj_water, inj_gas).

    A rate-controlled step goes by its own rate and phase. Any other goes by its well's
    history: whether any step injects, and water before gas before the phase of the first
    positive rate, else gas.
    """
    w = Window.partitionBy("well").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    some = lambda c: F.coalesce(F.bool_or(c).over(w), F.lit(False))
    water, gas, rate = some(F.col("inj_water") > 0), some(F.col("inj_gas") > 0), some(F.col("q_ctrl") > 0)
    first = F.min(F.when(F.col("q_ctrl") > 0, F.struct("report_step", "ctrl_phase"))).over(w)["ctrl_phase"]
    own = F.coalesce(F.col("q_ctrl") > 0, F.lit(False))
    phase = F.when(water, 1).when(gas, 2).otherwise(F.coalesce(first, F.lit(2)))
    return steps.withColumn("is_inj", F.when(F.col("is_rate"), own).otherwise(water | gas | rate)).withColumn("inj_phase", F.when(F.col("is_rate"), F.col("ctrl_phase")).otherwise(phase))


def head_limits(controls: DataFrame, rate: str = "rate", head: str = "bhpt") -> DataFrame:
    """One row: ``inj_cap``, the highest finite pressure of an injecting control, and ``prod_floor``, the lowest of a producing one."""
    p = F.when(~F.isnan(head) & (F.abs(head) < float("inf")), F.col(head))
    return controls.agg(F.max(F.when(F.col(rate) > 0, p)).alias("inj_cap"), F.min(F.when(F.col(rate) < 0, p)).alias("prod_floor"))


def output_ranges(states: DataFrame, limits: DataFrame, pressure: str, rs_top: float, pad: float, margin: float, rs_step: float, rs_headroom: int) -> DataFrame:
    """One row: p_min, p_max and rs_max, widened by a part of the span and rounded outward to whole pads."""
    s = states.agg(F.min(pressure).alias("lo"), F.max(pressure).alias("hi")).crossJoin(F.broadcast(limits))  # a row each
    span = F.col("hi") - F.col("lo")
    low = F.greatest(F.lit(0.0), F.col("lo") - margin * span)
    high = F.greatest(F.col("hi") + margin * span, F.coalesce("inj_cap", F.col("hi")))
    rs = F.round((F.ceil(F.lit(rs_top / rs_step)) + rs_headroom) * rs_step, 6)
    return s.select((F.floor(low / pad) * pad).alias("p_min"), (F.ceil(high / pad) * pad).alias("p_max"), rs.cast("double").alias("rs_max"))


def residual_scales(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``scale`` of each channel: its deviation over all rows, never 0."""
    return rows.groupBy(*by).agg((F.coalesce(F.stddev_pop(value), F.lit(0.0)) + SCALE_FLOOR).alias("scale"))


def first_of_each(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key, the first by ``order`` (a partial aggregate, not a window over hot keys)."""
    rest = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*by, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*rows.columns)


def ends(rows: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """``first``, ``last`` and ``n`` of each group; filter by ``n`` for groups with more than one row."""
    return rows.groupBy(*by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.count("*").alias("n"))


def merged(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of all files with the number of their file, so that lists keep the files' order."""
    return reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(name)).withColumn("source_no", F.lit(n)) for n, (name, df) in enumerate(sources)])


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], mode: str = "w") -> DataFrame:
    """Rows after an update: ``w`` replaces the keys that are in ``new``, ``a`` puts its rows beside them."""
    if mode not in ("w", "a"):
        raise ValueError(f"unknown mode {mode}")
    kept = old if mode == "a" else old.join(new.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(new)


def rank_in_run(rows: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "slot") -> DataFrame:
    """The place, from 0, of a row in its key's run."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


#: Segments in a block, rows of a partition whose places make a block, and pairs that are worked out at once.
SEGMENTS, ROW_BITS, PAIRS = 4096, 15, 1 << 18


def nearest_segment(points: DataFrame, track: DataFrame, key: str, point: Sequence[str], order: str) -> DataFrame:
    """Each point (``id``, its coordinates) with the direction of the nearest segment of its key's track.

    Segments join consecutive places of the track (the same columns); those of no length
    are passed over, and of equal distances the first counts. Blocks of a key's distinct places meet blocks of its
    segments, so that no row is made for a pair and long tracks spread over tasks.
    """
    ship(points.sparkSession)
    axes = range(len(point))
    w = Window.partitionBy(key).orderBy(order)
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    at, step = [f"__a{n}" for n in axes], [f"__d{n}" for n in axes]
    double = lambda c: F.col(c).cast("double")
    seg = track.select(key, F.col(order).alias("__at"), *[double(c).alias(a) for c, a in zip(point, at, strict=True)], *[(F.lead(double(c)).over(w) - double(c)).alias(s) for c, s in zip(point, step, strict=True)])
    seg = seg.withColumn("__l", total(F.col(s) * F.col(s) for s in step)).filter(F.col("__l") > 1e-12)
    seg = seg.groupBy(key, *at, *step, "__l").agg(F.min("__at").alias("__at")).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__at")) - 1)
    seg = seg.groupBy(key, F.floor(F.col("__n") / SEGMENTS).alias("__block")).agg(F.sort_array(F.collect_list(F.struct("__n", *at, *step, "__l"))).alias("__s"))
    rows = points.select(key, "id", *[double(c).alias(f"__p{n}") for n, c in enumerate(point)])
    here = [f"__p{n}" for n in axes]
    blocks = rows.select(key, *here).distinct().withColumn("__rows", F.shiftrightunsigned(F.monotonically_increasing_id(), ROW_BITS))
    blocks = blocks.groupBy(key, "__rows").agg(F.collect_list(F.struct(*here)).alias("__p"))
    pairs = blocks.join(seg, key).select(key, *[F.col(f"__p.{c}").alias(c) for c in here], *[F.col(f"__s.{c}").alias(c) for c in ("__n", *at, *step, "__l")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                col = lambda c: batch.column(c)[i].values  # noqa: B023, E731
                place, s = [col(c) for c in here], {c: col(c).to_numpy(zero_copy_only=False) for c in ("__n", *at, *step, "__l")}
                p = [x.to_numpy(zero_copy_only=False) for x in place]
                gap, first = np.empty(len(p[0])), np.empty(len(p[0]), np.int64)
                size = max(1, PAIRS // len(s["__l"]))
                for j in range(0, len(gap), size):
                    q = [x[j : j + size, None] for x in p]
                    tau = total((x - s[a]) * s[d] for x, a, d in zip(q, at, step, strict=True)) / s["__l"]
                    tau = np.minimum(np.maximum(tau, 0.0), 1.0)
                    g = total((x - s[a] - tau * s[d]) ** 2 for x, a, d in zip(q, at, step, strict=True))
                    g = np.where(np.isnan(g), np.inf, g)
                    first[j : j + size] = k = g.argmin(1)
                    gap[j : j + size] = g[np.arange(len(k)), k]
                keys = pa.array([batch.column(key)[i].as_py()] * len(gap), batch.schema.field(key).type)
                yield pa.RecordBatch.from_arrays([keys, *place, pa.array(gap), pa.array(s["__n"][first].astype(np.int64)), *[pa.array(s[d][first]) for d in step]], [key, *here, "__g", "__n", *step])

    kind = points.schema[key].dataType.simpleString()
    best = pairs.mapInArrow(run, f"`{key}` {kind}, {', '.join(f'{c} double' for c in here)}, __g double, __n long, {', '.join(f'{d} double' for d in step)}")
    found = F.struct(F.struct("__g", "__n").alias("o"), F.struct(*[F.col(d).alias(c) for d, c in zip(step, point, strict=True)]).alias("tangent"))
    best = best.groupBy(key, *here).agg(F.min(found).alias("__m")).select(F.col(key).alias("__key"), *[F.col(c).alias(f"_{c}") for c in here], "__m")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in here], F.col(key) == F.col("__key"))
    return rows.join(best, same).groupBy(key, "id").agg(F.min("__m").alias("__m")).select(key, "id", "__m.tangent")


def worst(rows: DataFrame, value: str, n: int = 4, ties: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows of the least value: a top-k, never a sort of all rows in one task."""
    return rows.orderBy(value, *ties).limit(n)


def shared(frames: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Index rows that all masks hold."""
    return reduce(DataFrame.intersect, [df.select(*columns) for df in frames.values()])
