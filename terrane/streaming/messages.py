"""Typed messages of a run, batch and streaming.

A message is (kind, iteration, total, pde, ic, data, well, payload): rows of one schema,
so a stream of them is filtered and projected like any table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.plans.shipping import ship

SCHEMA = "kind string, iteration int, total double, pde double, ic double, data double, well double, payload string"
#: The kinds of a message, the fields of a state in their order, the bytes of a grid part.
KINDS = ("stage", "grid", "loss", "state", "metrics", "error")
FIELDS = ("S_w", "S_o", "S_g", "p_o", "p_w", "p_g", "R_so")
LOSSES = ("total", "pde", "ic", "data", "well")
PART_BYTES = 2_500_000
#: base64 takes 4 characters for 3 bytes; a cell is 8 corners of 3 float32.
CELLS_PER_PART = PART_BYTES * 3 // 4 // 96


def message(df: DataFrame, kind: str, payload: Column | None = None, iteration: Column | None = None) -> DataFrame:
    """Rows as messages of a kind; loss columns that aren't there are 0, the payload is compact JSON or, if there is none, empty text."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    losses = [(F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c) for c in LOSSES]
    at = iteration if iteration is not None else (F.col("iteration") if "iteration" in df.columns else F.lit(0))
    return df.select(F.lit(kind).alias("kind"), at.cast("int").alias("iteration"), *losses, F.coalesce(payload if payload is not None else F.lit(""), F.lit("")).alias("payload"))


def stage(df: DataFrame, name: str, fraction: str, text: str) -> DataFrame:
    """Progress: the fraction, kept between 0 and 1, stands in ``total``."""
    f = F.least(F.greatest(F.col(fraction).cast("double"), F.lit(0.0)), F.lit(1.0))
    rows = df.select(f.alias("total"), F.to_json(F.struct(F.col(name).alias("stage"), F.col(text).alias("message"))).alias("__said"))
    return message(rows, "stage", F.col("__said"))


def loss(df: DataFrame, wall: str | None = None, eta: str | None = None) -> DataFrame:
    """Losses of an iteration, with its seconds (``wall_s``) and step size (``eta``, null where there is none)."""
    of = lambda c: (F.lit(None) if c is None else F.col(c)).cast("double")
    return message(df, "loss", F.to_json(F.struct(of(wall).alias("wall_s"), of(eta).alias("eta")), {"ignoreNullFields": "false"}))


def metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return message(df, "metrics", F.to_json(F.struct(*columns)))


def error(df: DataFrame, text: str) -> DataFrame:
    return message(df, "error", F.to_json(F.struct(F.col(text).alias("message"))))


def field_of(path: str) -> Column:
    """A value of the payload by its path, like ``7.stage``."""
    return F.get_json_object("payload", "$." + path.split(".", 1)[-1])


def grid_parts(corners: DataFrame, cells_per_part: int = CELLS_PER_PART) -> DataFrame:
    """part, start, count, corners and ijk (base64) of cells (cell_id, i, j, k, corners: array of 24 doubles).

    A part has a bounded number of cells, so packing one is bounded too.
    """
    import base64

    ship(corners.sparkSession)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("cell_id")
        enc = lambda a: base64.b64encode(a.tobytes()).decode()
        xyz = np.array(p["corners"].tolist(), "<f4")
        return pd.DataFrame({"part": [int(p["part"].iloc[0])], "start": [int(p["cell_id"].iloc[0])], "count": [len(p)], "corners": [enc(xyz)], "ijk": [enc(p[["i", "j", "k"]].to_numpy("<i2"))]})

    rows = corners.withColumn("part", F.floor(F.col("cell_id") / cells_per_part))
    return rows.groupBy("part").applyInPandas(pack, "part long, start long, count long, corners string, ijk string")


def state_parts(states: DataFrame, ranges: dict[str, tuple[float, float]], by: str = "report_step", per_part: int = 500_000) -> DataFrame:
    """step, part, start, count and one base64 half-float column a field; values are clipped, absent ones are the low end."""
    import base64

    ship(states.sparkSession)
    fields = [f for f in ranges]
    kept = states.select(F.col(by).alias("step"), "cell_id", F.floor(F.col("cell_id") / per_part).alias("part"), *[F.coalesce(F.least(F.greatest(F.nanvl(F.col(f), F.lit(lo)), F.lit(lo)), F.lit(hi)), F.lit(lo)).alias(f) for f, (lo, hi) in ranges.items()])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("cell_id")
        out = {"step": [int(p["step"].iloc[0])], "part": [int(p["part"].iloc[0])], "start": [int(p["cell_id"].iloc[0])], "count": [len(p)]}
        for f in fields:
            out[f] = [base64.b64encode(p[f].to_numpy("<f2").tobytes()).decode()]
        return pd.DataFrame(out)

    return kept.groupBy("step", "part").applyInPandas(pack, "step long, part long, start long, count long, " + ", ".join(f"`{f}` string" for f in fields))


def decode_array(text: str, dtype: str) -> np.ndarray:
    import base64

    return np.frombuffer(base64.b64decode(text), dtype)


def parse(df: DataFrame, schema: str) -> DataFrame:
    """Messages with their payload as columns; an empty payload is an empty object."""
    return df.withColumn("body", F.from_json(F.coalesce(F.nullif(F.col("payload"), F.lit("")), F.lit("{}")), schema))


def cadence(iteration: Column, every: int) -> Column:
    """Whether a message is due after this many iterations (count windows, not time)."""
    return iteration % every == 0


def with_history(stream: DataFrame, keep: int) -> DataFrame:
    """A stateful stream over losses: each group's last ``keep`` totals, and ``stalled`` from the first step of size 0 on.

    Input (run, iteration, total, eta); state is bounded by ``keep``.
    """
    ship(stream.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        totals, stalled = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        for pdf in frames:
            out = []
            for r in pdf.sort_values("iteration").itertuples():
                if stalled:
                    continue
                totals = [*totals, float(r.total)][-keep:]
                stalled = float(r.eta) == 0.0
                out.append((key[0], int(r.iteration), float(r.total), min(totals), len(totals), "stalled" if stalled else "running"))
            state.update((totals, stalled))
            yield pd.DataFrame(out, columns=["run", "iteration", "total", "best", "n", "status"])

    return stream.groupBy("run").applyInPandasWithState(step, "run string, iteration int, total double, best double, n int, status string", "totals array<double>, stalled boolean", "append", "NoTimeout")


def with_last(stream: DataFrame, limits: dict[str, int], default: int) -> DataFrame:
    """A stateful stream: after each batch, the last messages of each (run, kind) up to the kind's limit, oldest first.

    Input (run, kind, iteration, payload); output has ``place`` (0: the newest) beside them. State is bounded by the limits.
    """
    ship(stream.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, kind = key
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in frames:
            held += [(int(r.iteration), r.payload) for r in pdf.itertuples()]
        most = limits.get(kind, default)
        held = sorted(held, key=lambda h: h[0])[-most:] if most > 0 else []
        state.update(([h[0] for h in held], [h[1] for h in held]))
        n = len(held)
        yield pd.DataFrame([(run, kind, i, p, n - 1 - k) for k, (i, p) in enumerate(held)], columns=["run", "kind", "iteration", "payload", "place"])

    return stream.groupBy("run", "kind").applyInPandasWithState(step, "run string, kind string, iteration int, payload string, place int", "iterations array<int>, payloads array<string>", "update", "NoTimeout")


def windowed_counts(stream: DataFrame, ts: str = "ts", by: str = "event_type", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Event-time windows with a watermark: an extra of this engine over plain event tables."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
