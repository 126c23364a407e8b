"""Well-model operators: control resolution, Peaceman tensor, packing, closures, residual rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions import fluids, scalars
from terrane.operators import aggregates, temporal
from terrane.plans.shipping import ship
from terrane.plans.storage import sized

#: Observation channels with phase (0 oil, 1 water, 2 gas) and sign of flow.
CHANNELS = (("wopr", 0, -1.0), ("wwpr", 1, -1.0), ("wgpr", 2, -1.0), ("wwir", 1, 1.0), ("wgir", 2, 1.0))
GRAVITY = 0.006944


def resolve_controls(report: DataFrame, schedule: DataFrame) -> DataFrame:
    """The control of each (well, ts) of ``report``: kind (closed, rate, bhp, null), source, mode, phase, signed rate, bhpt and control.

    ``schedule`` has rows of ``terrane.sources.deck.controls``, with source EVENT for events.
    An event goes before all else; else the newest of producer, injector and history rows
    (ties in that order); a later or equal WELOPEN closes either.
    """
    s = lambda k: schedule.filter(F.col("source") == k).drop("source", "path")
    x = temporal.asof(report, s("EVENT"), ["well"], "ts", "ts", ["seq"], name="e")
    x = temporal.asof_precedence(x, [(k, s(k)) for k in ("WCONPROD", "WCONINJE", "WCONHIST")], ["well"], "ts", "ts", ["seq"], name="c")
    x = temporal.asof(x, s("WELOPEN"), ["well"], "ts", "ts", ["seq"], name="o")
    has_event = F.col("e").isNotNull()
    pick = lambda c: F.when(has_event, F.col(f"e.{c}")).otherwise(F.col(f"c.{c}"))
    at = pick("ts")
    reopened = F.coalesce(F.col("o.ts") >= at, F.lit(False))
    mode = F.when(~has_event & reopened, F.coalesce("o.mode", "c.mode")).otherwise(pick("mode"))
    closed_later = reopened & F.upper("o.mode").isin("SHUT", "STOP", "CLOSED", "CLOSE")
    kind = F.when(closed_later, "closed").otherwise(scalars.control_kind(mode, pick("control"), pick("rate"), pick("bhpt")))
    source = F.when(has_event, "EVENT").otherwise(F.col("c.source"))
    rate = F.when(source == "WCONINJE", pick("rate")).otherwise(-F.abs(pick("rate")))
    phase = F.when(F.upper(pick("phase")) == "WATER", 1).when(F.upper(pick("phase")) == "GAS", 2).when(F.upper(pick("control")) == "WRAT", 1).when(F.upper(pick("control")) == "GRAT", 2).otherwise(0)
    return x.select(*report.columns, F.when(at.isNotNull(), kind).alias("kind"), source.alias("source"), mode.alias("mode"), phase.alias("phase"), F.when(F.coalesce(kind == "rate", F.lit(False)), rate).alias("rate"), pick("bhpt").alias("bhpt"), pick("control").alias("control"))


def tensor_index(k11: Column, k12: Column, k22: Column, d1: Column, d2: Column, h: Column, r_w: Column, skin: Column) -> dict[str, Column]:
    """Peaceman's index of a 2x2 permeability block across the well: k_eff, r_e, wi.

    Eigenvalues of a symmetric 2x2 in closed form; wi is null where the block isn't
    positive definite or r_e isn't over r_w.
    """
    mean, half = (k11 + k22) / 2, F.sqrt(F.pow((k11 - k22) / 2, 2) + k12 * k12)
    a, b = mean + half, mean - half
    ok = (b > 0) & (k11 > 0)
    ratio = F.sqrt(a / b)
    r_e = 0.28 * F.sqrt(ratio * d1 * d1 + d2 * d2 / ratio) / (F.sqrt(ratio) + 1 / F.sqrt(ratio))
    r = F.coalesce(r_w, F.lit(0.5))
    wi = 2 * F.pi() * h * F.sqrt(a * b) / (F.ln(r_e / r) + F.coalesce(skin, F.lit(0.0)))
    return {"k_eff": F.when(ok, F.sqrt(a * b)), "r_e": F.when(ok, r_e), "wi": F.when(ok & (r_e > r), wi)}


def peaceman(perforations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, h_s, r_e, wi and ``why`` of perforations (k: nine numbers, tx, ty, tz, hx, hy, hz, r_w, skin).

    The permeability is turned into the well's frame, its third axis the tangent; the block across
    the well gives index and radius. Where that block isn't positive definite, or the radius isn't
    over the well's, ``wi`` is null and ``why`` says so: the caller may raise, or take another weight.
    """
    ship(perforations.sparkSession)
    kinds = ", ".join(f"`{k}` {perforations.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
        for pdf in batches:
            k = np.array(pdf["k"].tolist(), float).reshape(-1, 3, 3)
            t, size = unit(pdf[["tx", "ty", "tz"]].to_numpy(float)), pdf[["hx", "hy", "hz"]].to_numpy(float)
            up = np.where(np.abs(t[:, 2:]) < 0.9, [[0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0]])
            a = unit(np.cross(up, t))
            frame = np.stack([a, np.cross(t, a)], 2)
            across = np.einsum("nia,nij,njb->nab", frame, (k + k.transpose(0, 2, 1)) / 2, frame)
            low_high, vectors = np.linalg.eigh(across)
            ok = (low_high > 0).all(1)
            lam = np.where(ok[:, None], low_high, 1.0)
            extent = np.einsum("nia,ni->na", np.abs(frame @ vectors), size)
            ratio = np.sqrt(lam[:, 1] / lam[:, 0])
            r_e = 0.28 * np.sqrt(ratio * extent[:, 0] ** 2 + extent[:, 1] ** 2 / ratio) / (np.sqrt(ratio) + 1 / np.sqrt(ratio))
            h, r_w = (np.abs(t) * size).sum(1), pdf["r_w"].to_numpy(float)
            wide = r_e > r_w
            wi = 2 * np.pi * h * np.sqrt(lam.prod(1)) / (np.log(np.where(wide, r_e / r_w, np.e)) + pdf["skin"].to_numpy(float))
            why = np.where(~ok, "not positive definite", np.where(~wide, "radius within the well", None))
            good = ok & wide
            blank = lambda v, keep: pd.Series(v, dtype="Float64").where(pd.Series(keep), pd.NA)
            yield pdf[list(keys)].reset_index(drop=True).assign(h_s=h, r_e=blank(r_e, ok), wi=blank(wi, good), why=why)

    columns = dict.fromkeys([*keys, "k", "tx", "ty", "tz", "hx", "hy", "hz", "r_w", "skin"])
    return perforations.select(*columns).mapInPandas(run, f"{kinds}, h_s double, r_e double, wi double, why string")


def split_rates(controlled: DataFrame, perforations: DataFrame) -> DataFrame:
    """Rates of (report_step, well) over its perforations by wi, equal parts without any; totals of exactly 0 are left out."""
    j = controlled.filter((F.col("kind") == "rate") & (F.col("rate") != 0)).join(perforations, "well")
    return aggregates.allocate_or_equal(j, ["report_step", "well"], "rate", "wi", out="q_perf")


def phase_split(df: DataFrame) -> DataFrame:
    """Rows by phase of unphased totals, from observed oil, water and gas rates (columns obs_0 to obs_2).

    Without observed rates the total is water if it is injected, else oil.
    """
    seen = F.coalesce(*[F.col(f"obs_{p}") for p in range(3)]).isNotNull()
    parts = F.filter(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"obs_{p}").alias("rate")) for p in range(3)]), lambda x: x["rate"].isNotNull() & (x["rate"] != 0))
    default = F.array(F.struct(F.when(F.col("rate") > 0, 1).otherwise(0).alias("phase"), F.col("rate").alias("rate")))
    return df.withColumn("__p", F.explode(F.when(seen, parts).otherwise(default))).withColumn("phase", F.col("__p.phase")).withColumn("rate", F.col("__p.rate")).drop("__p")


def pack_steps(rows: DataFrame) -> DataFrame:
    """One row a (report_step, well) of perforation rows (is_rate, q, phase, bhp_target): is_rate, q_ctrl, phase, p_bh_ctrl.

    Rate-controlled if any perforation is; the phase is the most frequent one, ties to the lowest.
    """
    counts = [F.sum(F.when(F.col("is_rate") & (F.col("phase") == p), 1).otherwise(0)) for p in range(3)]
    best = F.greatest(*counts)
    phase = F.when(counts[0] == best, 0).when(counts[1] == best, 1).otherwise(2)
    any_rate = F.bool_or("is_rate")
    return rows.groupBy("report_step", "well").agg(any_rate.alias("is_rate"), F.when(any_rate, F.sum(F.when(F.col("is_rate"), F.col("q")))).alias("q_ctrl"), F.when(any_rate, phase).alias("ctrl_phase"), F.when(~any_rate, F.avg("bhp_target")).alias("p_bh_ctrl"))


def observed_channels(results: DataFrame) -> DataFrame:
    """report_step, well, channel, phase and signed obs of summary rates (columns by channel name); counter-direction ones are null."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.lit(p).alias("phase"), (s * F.abs(F.col(c))).alias("obs")) for n, (c, p, s) in enumerate(CHANNELS)]))
    x = results.select("report_step", "well", "q_ctrl", rows.alias("r")).select("report_step", "well", "q_ctrl", "r.*")
    total = F.sum("obs").over(Window.partitionBy("report_step", "well"))
    way = F.signum(F.coalesce(F.nullif(F.col("q_ctrl"), F.lit(0.0)), total))
    return x.withColumn("obs", F.when((way == 0) | (F.signum("obs") == way), F.col("obs")))


def realized_mode(steps: DataFrame) -> DataFrame:
    """binding and q_pin of (is_rate, ctrl_phase, q_ctrl, q_obs, bhp_obs): gas control is never pinned to what was observed."""
    pin = F.when(F.col("ctrl_phase") == 2, F.col("q_ctrl")).otherwise(F.coalesce("q_obs", "q_ctrl"))
    bind = F.col("is_rate") & scalars.binding("q_obs", "q_ctrl", F.col("bhp_obs").isNotNull())
    return steps.withColumn("q_pin", pin).withColumn("binding", F.coalesce(bind, F.lit(False)))


def perforation_state(cells: DataFrame, tables: fluids.Tables, model: str = "stone2") -> DataFrame:
    """Phase mobilities of perforations (wi, pressure, swat, sgas, rs, is_inj, inj_phase); an injector's total is on its phase."""
    m = tables.mobilities(F.col("pressure"), F.col("swat"), F.col("sgas"), F.col("rs"), model)
    total = m["o"] + m["w"] + m["g"]
    own = {p: F.when(F.col("is_inj"), F.when(F.col("inj_phase") == n, total).otherwise(0.0)).otherwise(m[p]) for n, p in enumerate("owg")}
    return cells.withColumns({f"lam_{p}": own[p] for p in "owg"})


def closed_form_head(perforations: DataFrame, low: float, high: float) -> DataFrame:
    """Flowing pressure of each (report_step, well) that meets ``q_pin`` over its perforations: two sums and a clip."""
    a = F.col("wi") * F.when(F.col("ctrl_phase") == 1, F.col("lam_w")).when(F.col("ctrl_phase") == 2, F.col("lam_g")).otherwise(F.col("lam_o"))
    x = perforations.withColumn("__a", a).withColumn("__lift", F.col("pressure") - F.col("gamma") * (F.col("z_cell") - F.col("z_bh")))
    p = scalars.closed_form_bhp("q_pin", "__a", F.col("__lift"), low, high)
    return x.groupBy("report_step", "well", "q_pin").agg(p.alias("p_bh"))


def head_range(steps: DataFrame, low: float, high: float, margin: float = 0.05) -> DataFrame:
    """The anchors, widened to observed and controlled pressures and a margin of their span."""
    lo, hi = F.least(F.min("bhp_obs"), F.min("p_bh_ctrl")), F.greatest(F.max("bhp_obs"), F.max("p_bh_ctrl"))
    r = steps.agg(F.least(F.coalesce(lo, F.lit(low)), F.lit(low)).alias("a"), F.greatest(F.coalesce(hi, F.lit(high)), F.lit(high)).alias("b"))
    return r.select((F.col("a") - margin * (F.col("b") - F.col("a"))).alias("lo"), (F.col("b") + margin * (F.col("b") - F.col("a"))).alias("hi"))


def residual_rows(heads: DataFrame, channels: DataFrame, bhp_scale: float, scales: DataFrame) -> DataFrame:
    """group, report_step, well, channel and scaled residual: pressures first, then channels.

    A few phases would gather all channels in as many tasks, so the scales go to the channels.
    """
    h = heads.filter("bhp_obs IS NOT NULL").select(F.lit("bhp").alias("grp"), "report_step", "well", F.lit(-1).alias("channel"), ((F.col("p_bh") - F.col("bhp_obs")) / bhp_scale).alias("residual"))
    c = channels.filter("obs IS NOT NULL").join(sized(scales), "phase").select(F.lit("channel").alias("grp"), "report_step", "well", "channel", ((F.col("predicted") - F.col("obs")) / F.col("scale")).alias("residual"))
    return h.unionByName(c)
