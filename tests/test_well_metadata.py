"""Wells at each report by hand: completions by time, index or factor, totals split by phase."""

import datetime as dt
import math

import pytest

from terrane.operators import well_pack

DAY = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
CONTROLS = "well string, ts timestamp_ntz, seq long, source string, mode string, control string, phase string, rate double, bhpt double"
COMPLETIONS = "well string, cell_id long, ts timestamp_ntz, seq long, status string, cf double, r_w double, skin double"
BLOCKS = "cell_id long, k array<double>, tx double, ty double, tz double, hx double, hy double, hz double"


def test_metadata_by_hand(spark):
    make = spark.createDataFrame
    report = make([("P", DAY(d)) for d in (1, 5, 9)] + [("I", DAY(5)), ("X", DAY(5)), ("S", DAY(5))], "well string, ts timestamp_ntz")
    controls = make([("P", DAY(0), 0, "WCONPROD", "OPEN", "LRAT", None, 90.0, None), ("P", DAY(8), 1, "WCONPROD", "OPEN", "BHP", None, None, 700.0), ("I", DAY(0), 2, "WCONINJE", "OPEN", "RATE", "WATER", 40.0, None), ("S", DAY(0), 3, "WCONPROD", "SHUT", "ORAT", None, 5.0, None)], CONTROLS)
    channels = "wopr double, wwpr double, wgpr double, wwir double, wgir double, wbhp double"
    results = make([("P", DAY(3), 20.0, 10.0, 500.0, None, None, 900.0)], f"well string, ts timestamp_ntz, {channels}")
    simulated = make([], "well string, ts timestamp_ntz, is_open boolean, well_type string")
    completions = make([("P", 1, DAY(0), 0, "OPEN", None, 0.5, 0.0), ("P", 2, DAY(2), 1, "OPEN", 3.0, None, None), ("P", 2, DAY(6), 2, "SHUT", None, None, None), ("P", 4, DAY(9), 3, "OPEN", None, None, None), ("I", 3, DAY(0), 4, "open", None, None, 2.0), ("S", 1, DAY(0), 5, "OPEN", None, None, None)], COMPLETIONS)
    diagonal = lambda a: [a, 0, 0, 0, a, 0, 0, 0, a]
    blocks = make([(1, [float(v) for v in diagonal(10)], 0.0, 0.0, 1.0, 50.0, 50.0, 4.0), (3, [float(v) for v in diagonal(-1)], 0.0, 0.0, 1.0, 50.0, 50.0, 4.0)], BLOCKS)
    rows = {(r["well"], r["ts"], r["perf_id"], r["phase"]): r for r in well_pack.well_metadata(report, controls, simulated, results, completions, blocks).collect()}
    wi = 2 * math.pi * 4 * 10 / math.log(0.14 * 50 * math.sqrt(2) / 0.5)
    got = lambda *k: rows[k]["rate"]
    assert set(rows) == {("P", DAY(1), 1, 0), ("P", DAY(5), 1, 0), ("P", DAY(5), 1, 1), ("P", DAY(5), 2, 0), ("P", DAY(5), 2, 1), ("P", DAY(9), 1, 0), ("P", DAY(9), 4, 0), ("I", DAY(5), 3, 1)}
    assert got("P", DAY(1), 1, 0) == -90.0  # nothing observed yet
    assert [got("P", DAY(5), c, p) for c in (1, 2) for p in (0, 1)] == pytest.approx([-q * w / (wi + 3) for w in (wi, 3) for q in (60, 30)])
    assert (rows["P", DAY(9), 1, 0]["p_bh"], rows["P", DAY(9), 1, 0]["kind"], rows["P", DAY(9), 4, 0]["why"]) == (700.0, "bhp", "no block")
    assert got("I", DAY(5), 3, 1) == 40.0 and rows["I", DAY(5), 3, 1]["why"] == "not positive definite" and rows["I", DAY(5), 3, 1]["weight"] == 0.0
    assert rows["P", DAY(5), 2, 0]["why"] is None and rows["P", DAY(5), 1, 0]["weight"] == pytest.approx(wi)
    assert well_pack.well_metadata(report.limit(0), controls, simulated, results, completions, blocks).count() == 0
