"""The well model's tables over report steps: controls, observations, windows, forcing, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import aggregates, schedule, temporal, wells
from terrane.operators.windows import nested_ids

PRODUCED, INJECTED = ("wopr", "wwpr", "wgpr"), ("wwir", "wgir")
#: Phases (0 oil, 1 water, 2 gas) in the order of the residuals.
RESIDUAL_ORDER = ((1, "w"), (0, "o"), (2, "g"))


def _flows(c: str) -> Column:
    """Magnitude of a rate that is finite and not 0, else null."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")) & (v != 0), F.abs(v))


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def synthetic_control(rows: DataFrame) -> DataFrame:
    """syn_kind, syn_phase, syn_rate and syn_bhpt of simulated wells (is_open, well_type, observed rates, wbhp).

    An open well is controlled by what it produced or injected; the type INJ counts, else
    injection alone. Without a rate its pressure controls it; without either, and for wells
    that are shut, all four are null. The phase is oil before water before gas.
    """
    made, put = [_flows(c) for c in PRODUCED], [_flows(c) for c in INJECTED]
    total = lambda parts: sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    some = lambda parts: F.coalesce(*parts).isNotNull()
    injects = F.upper(F.coalesce("well_type", F.lit(""))).startswith("INJ") | (some(put) & ~some(made))
    rate = F.when(injects, F.when(some(put), total(put))).when(some(made), -total(made))
    first = lambda parts, names: F.coalesce(*[F.when(p.isNotNull(), n) for p, n in zip(parts, names, strict=True)])
    phase = F.when(injects, first(put, ("WATER", "GAS"))).otherwise(first(made, ("OIL", "WATER", "GAS")))
    kind = F.when(F.coalesce(F.col("is_open"), F.lit(False)), F.when(rate.isNotNull(), "rate").when(_finite("wbhp").isNotNull(), "bhp"))
    found = rows.withColumn("syn_kind", kind)
    has = F.col("syn_kind").isNotNull()
    return found.withColumns({"syn_phase": F.when(has, phase), "syn_rate": F.when(has, rate), "syn_bhpt": F.when(has, _finite("wbhp"))})


def well_entries(report: DataFrame, controls: DataFrame, simulated: DataFrame, results: DataFrame, perforations: DataFrame) -> DataFrame:
    """A row for each (ts, well, perforation, phase) that a control drives: kind, source, phase, weight, p_bh, rate.

    ``report`` is (ts, well), ``controls`` the schedule, ``simulated`` (well, ts, is_open, well_type) and
    ``results`` (well, ts, summary channels) are read as of the report, ``perforations`` is (well, perf_id, weight) or,
    where they change, (ts, well, perf_id, weight). The schedule goes before the simulation. A pressure control is kept on
    each perforation; a rate goes to its phase and is dealt to the perforations by weight, equally without any; ``driven`` and
    ``over_perforations`` are its two halves, between which ``well_metadata`` splits unphased totals.
    Wells that were simulated as shut, wells without control and rates of 0 have no rows.
    """
    return over_perforations(driven(report, controls, simulated, results), perforations)


def driven(report: DataFrame, controls: DataFrame, simulated: DataFrame, results: DataFrame) -> DataFrame:
    """ts, well, kind (rate, bhp), source, phase, rate, p_bh, ``control`` (the schedule's code) and the observed channels of each controlled well."""
    channels = [*PRODUCED, *INJECTED, "wbhp"]
    x = wells.resolve_controls(report.select("well", "ts"), controls)
    x = temporal.asof(x, simulated.select("well", "ts", "is_open", "well_type"), ["well"], "ts", "ts", name="sim")
    x = temporal.asof(x, results.select("well", "ts", *channels), ["well"], "ts", "ts", name="res")
    x = x.filter("sim IS NULL OR sim.is_open").withColumns({"is_open": F.col("sim.is_open"), "well_type": F.col("sim.well_type"), **{c: F.col(f"res.{c}") for c in channels}})
    x = synthetic_control(x).withColumn("from_deck", F.col("kind").isNotNull())
    syn_phase = F.when(F.col("syn_phase") == "WATER", 1).when(F.col("syn_phase") == "GAS", 2).otherwise(0)
    pick = lambda own, syn: F.when(F.col("from_deck"), own).otherwise(syn)
    x = x.select("ts", "well", pick(F.col("kind"), F.col("syn_kind")).alias("kind"), pick(F.col("source"), F.lit("SIMULATION")).alias("source"), pick(F.col("phase"), syn_phase).alias("phase"), pick(F.col("rate"), F.col("syn_rate")).alias("rate"), pick(F.col("bhpt"), F.col("syn_bhpt")).alias("p_bh"), F.when(F.col("from_deck"), F.col("control")).alias("control"), *channels)
    return x.filter("kind IN ('rate', 'bhp')")


def over_perforations(x: DataFrame, perforations: DataFrame) -> DataFrame:
    """Rows of ``driven`` on their perforations: pressures on each, rates by weight within (ts, well, phase)."""
    on = ["ts", "well"] if "ts" in perforations.columns else ["well"]
    columns = ["ts", "well", "perf_id", "kind", "source", "phase", "weight"]
    heads = x.filter("kind = 'bhp' AND p_bh IS NOT NULL").join(perforations, on).select(*columns, "p_bh", F.lit(None).cast("double").alias("rate"))
    flow = aggregates.allocate_or_equal(x.filter("kind = 'rate' AND rate <> 0").join(perforations, on), ["ts", "well", "phase"], "rate", "weight", out="rate_perf")
    return heads.unionByName(flow.select(*columns, F.lit(None).cast("double").alias("p_bh"), F.col("rate_perf").alias("rate")))


#: Controls whose rate is of no one phase, by the phases that it adds up.
TOTALS = {"LRAT": ("wopr", "wwpr"), "RESV": ("wopr", "wwpr", "wgpr")}


def split_totals(x: DataFrame) -> DataFrame:
    """Rows of ``driven`` with totals (TOTALS) dealt to their phases by the rates observed; without any they stay on the phase they had."""
    flows = {c: F.coalesce(_flows(c), F.lit(0.0)) for c in PRODUCED}
    out = F.array(F.struct(F.col("phase").alias("phase"), F.col("rate").alias("rate")))
    for code, parts in TOTALS.items():
        total = sum((flows[c] for c in parts), F.lit(0.0))
        each = F.array(*[F.struct(F.lit(PRODUCED.index(c)).alias("phase"), (F.col("rate") * flows[c] / F.when(total > 0, total)).alias("rate")) for c in parts])
        held = F.filter(each, lambda e: e["rate"] != 0)
        out = F.when((F.col("kind") == "rate") & (F.upper("control") == code) & (total > 0), held).otherwise(out)
    return x.withColumn("__p", F.explode(out)).withColumns({"phase": F.col("__p.phase"), "rate": F.col("__p.rate")}).drop("__p")


def open_completions(report: DataFrame, completions: DataFrame) -> DataFrame:
    """ts, well, cell_id, cf, r_w and skin of the completions that are open at each report: the newest row of a (well, cell) by then.

    ``completions``: well, cell_id, ts, seq, status, cf, r_w, skin. A completion holds until a later row of its cell; before
    its first it isn't there.
    """
    cells = report.select("ts", "well").distinct().join(completions.select("well", "cell_id").distinct(), "well")
    x = temporal.asof(cells, completions, ["well", "cell_id"], "ts", "ts", ["seq"], name="c")
    return x.filter(F.upper("c.status") == "OPEN").select("ts", "well", "cell_id", *[F.col(f"c.{n}").alias(n) for n in ("cf", "r_w", "skin")])


def well_metadata(report: DataFrame, controls: DataFrame, simulated: DataFrame, results: DataFrame, completions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Everything of the wells at each report in one plan: the rows of ``well_entries`` with ``why`` a perforation has no index.

    ``completions`` (see ``open_completions``) are read as of the report; ``blocks`` (cell_id, k: nine numbers, tx, ty, tz, hx, hy, hz) give
    Peaceman's index where a completion brings no factor of its own. The control is resolved, totals are split
    by the phases observed, and rates dealt by index. A perforation is its cell; one in no block, or without an index, weighs nothing.
    """
    open_ = open_completions(report, completions).join(blocks, "cell_id", "left")
    bore = open_.withColumns({"r_w": F.coalesce("r_w", F.lit(0.5)), "skin": F.coalesce("skin", F.lit(0.0))})
    shapes = bore.filter("k IS NOT NULL").select("cell_id", "k", "tx", "ty", "tz", "hx", "hy", "hz", "r_w", "skin").dropDuplicates(["cell_id", "r_w", "skin"])
    index = wells.peaceman(shapes, ["cell_id", "r_w", "skin"]).select("cell_id", "r_w", "skin", "wi", "why")
    x = bore.select("ts", "well", "cell_id", "cf", "r_w", "skin").join(index, ["cell_id", "r_w", "skin"], "left")
    factor = F.when(F.col("cf") > 0, F.col("cf"))
    why = F.when(factor.isNull(), F.when(F.col("wi").isNull(), F.coalesce("why", F.lit("no block"))))
    perforations = x.select("ts", "well", F.col("cell_id").alias("perf_id"), F.coalesce(factor, "wi", F.lit(0.0)).alias("weight"), why.alias("why"))
    entries = over_perforations(split_totals(driven(report, controls, simulated, results)), perforations.drop("why"))
    return entries.join(perforations.select("ts", "well", "perf_id", "why"), ["ts", "well", "perf_id"])


def packed(perforations: DataFrame, once: bool = False) -> DataFrame:
    """Perforations with ``perf_no`` in order of (well, perf_id) and ``well_no`` in order of wells, both from 0; with ``once`` a row each."""
    return nested_ids(perforations, ["well", "perf_id"], ["well_no", "perf_no"], once)


def dense_steps(steps: DataFrame, times: DataFrame, names: DataFrame) -> DataFrame:
    """Every (report_step, well) with its packed row; ``active`` is whether it has one, absent rates are 0."""
    grid = times.select("report_step").crossJoin(names.select("well"))  # the pack itself is this product
    x = grid.join(steps.withColumn("active", F.lit(True)), ["report_step", "well"], "left")
    return x.withColumns({"active": F.coalesce("active", F.lit(False)), "is_rate": F.coalesce("is_rate", F.lit(False)), "q_ctrl": F.coalesce("q_ctrl", F.lit(0.0))})


def apply_windows(steps: DataFrame, time: str, low: float, high: float, obs_high: float, channels: Sequence[str]) -> DataFrame:
    """in_obs and in_ctrl, observations (``channels``, bhp_obs) null outside the observed window.

    There ``binding`` is off and ``q_pin`` is the control: what the wells did later isn't known.
    """
    t = F.col(time)
    x = steps.withColumn("in_ctrl", schedule.in_span(t, low, high)).withColumn("in_obs", schedule.in_span(t, low, obs_high, high))
    seen = {c: F.when(F.col("in_obs"), F.col(c)) for c in (*channels, "bhp_obs")}
    return x.withColumns(seen | {"binding": F.col("binding") & F.col("in_obs"), "q_pin": F.when(F.col("in_obs"), F.col("q_pin")).otherwise(F.col("q_ctrl"))})


def row_counts(steps: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row, the sidecar of a pack: n_times, n_wells, n_bhp, n_rate and n_rows."""
    seen = sum((F.count(c) for c in channels), F.lit(0))
    return steps.agg(F.countDistinct("report_step").alias("n_times"), F.countDistinct("well").alias("n_wells"), F.count("bhp_obs").alias("n_bhp"), seen.alias("n_rate")).withColumn("n_rows", F.col("n_bhp") + F.col("n_rate"))


def pack_scales(steps: DataFrame) -> DataFrame:
    """phase (null: pressure) and scale: robust, floored by the controls, at least 1e-3 of the busiest phase."""
    obs = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(c).cast("double").alias("v")) for c, p, _ in wells.CHANNELS]))
    seen = steps.select(obs.alias("r")).select("r.phase", "r.v", F.lit(None).cast("double").alias("q"))
    held = steps.filter("is_rate").select(F.col("ctrl_phase").alias("phase"), F.lit(None).cast("double").alias("v"), F.abs("q_ctrl").alias("q"))
    scales = aggregates.phase_scales(seen.unionByName(held), "phase", "v", "q")
    head = steps.agg(aggregates.robust_scale(F.col("bhp_obs"), 1.0).alias("scale")).select(F.lit(None).cast("int").alias("phase"), "scale")
    return head.unionByName(scales)


def forcing(steps: DataFrame, perforations: DataFrame, from_controls: bool = False, controls_from: float | None = None) -> DataFrame:
    """report_step, perf_id and the source terms q_w, q_o, q_g of each perforation.

    Observed channels (magnitudes; null: unobserved) go first, and the control fills its phase where
    that has none. ``from_controls``, and times after ``controls_from``, take controls alone; wells
    held at a pressure then have no source. Rates are spread by the share of ``wi``.
    """
    use = F.lit(from_controls)
    if controls_from is not None:
        use = use | (F.col("time") > controls_from + 1e-6)
    out = {}
    for p, name in RESIDUAL_ORDER:
        own = [(F.col(c).cast("double"), s) for c, q, s in wells.CHANNELS if q == p]
        seen = F.coalesce(*[v for v, _ in own]).isNotNull()
        total = sum((F.coalesce(s * v, F.lit(0.0)) for v, s in own), F.lit(0.0))
        held = F.col("is_rate") & (F.col("ctrl_phase") == p)
        ctrl = F.when(held & F.col("active"), F.col("q_ctrl")).otherwise(0.0)
        out[name] = F.when(use, ctrl).otherwise(F.when(seen, total).when(held, F.col("q_ctrl")).otherwise(0.0))
    q = steps.select("report_step", "well", *[F.coalesce(c, F.lit(0.0)).alias(f"__{n}") for n, c in out.items()])
    sums = perforations.groupBy("well").agg(F.greatest(F.sum("wi"), F.lit(1e-30)).alias("__sum"))
    share = perforations.join(sums, "well").select("well", "perf_id", (F.col("wi") / F.col("__sum")).alias("__part"))
    return q.join(share, "well").select("report_step", "well", "perf_id", *[(F.col(f"__{n}") * F.col("__part")).alias(f"q_{n}") for n in out])


def rates_at(perforations: DataFrame, head: str, c_f: float = 1.0) -> DataFrame:
    """q_w, q_o and q_g (dissolved gas with it) of perforations at a flowing pressure.

    Columns: wi, dz, rs, active, and for each phase lam_, gamma_ and p_; shut wells give 0.
    """
    flow = lambda p: F.when(F.col("active"), c_f * F.col("wi") * F.col(f"lam_{p}") * (F.col(head) + F.col(f"gamma_{p}") * F.col("dz") - F.col(f"p_{p}"))).otherwise(0.0)
    x = perforations.withColumns({"q_w": flow("w"), "q_o": flow("o"), "q_g": flow("g")})
    return x.withColumn("q_g", F.col("q_g") + F.col("rs") * F.col("q_o"))


def well_totals(rates: DataFrame) -> DataFrame:
    """Totals of each (report_step, well) over its perforations."""
    return rates.groupBy("report_step", "well").agg(*[F.sum(f"q_{p}").alias(f"q_{p}") for p in "wog"], F.bool_or("active").alias("active"))


def synthesized(totals: DataFrame) -> DataFrame:
    """Observed channels as modelled totals give them; a channel of the other direction, or of a shut well, is null."""
    name = {0: "q_o", 1: "q_w", 2: "q_g"}
    v = {c: s * F.col(name[p]) for c, p, s in wells.CHANNELS}
    return totals.select("report_step", "well", *[F.when((x > -1e-9) & F.col("active"), F.greatest(x, F.lit(0.0))).alias(c) for c, x in v.items()])
