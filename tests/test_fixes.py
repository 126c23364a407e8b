"""Results that once departed from the contract."""

import numpy as np
import pytest

from terrane.operators import fit, joins, temporal


def test_rows_of_one_time_go_by_their_order(spark):
    left = spark.createDataFrame([("w", 10)], "well string, t int")
    one = spark.createDataFrame([("w", 5, s, v) for s, v in ((3, "late"), (1, "early"), (2, "middle"))], "well string, ts int, seq int, v string")
    two = spark.createDataFrame([("w", 5, 9, "other")], "well string, ts int, seq int, v string")
    got = temporal.asof_precedence(left, [("first", one), ("second", two)], ["well"], "t", "ts", ["seq"]).first()["match"]
    assert (got["source"], got["v"]) == ("first", "late")


def test_rows_without_a_time_are_always_early_enough(spark):
    left = spark.createDataFrame([("a", 1), ("a", 9), ("b", 1), ("c", 1), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", None, "none"), ("a", 5, "five"), ("b", 7, "seven"), ("b", 6, "six")], "k string, ts int, v string")
    got = {(r["k"], r["t"]): r["match"] and r["match"]["v"] for r in temporal.asof_or_first(left, right, ["k"], "t", "ts").collect()}
    assert got == {("a", 1): "none", ("a", 9): "five", ("b", 1): "six", ("c", 1): None, ("a", None): "none"}


def test_damping_grows_three_times(monkeypatch):
    tried = []

    def fail(a):
        tried.append(a[0, 0])
        raise np.linalg.LinAlgError

    monkeypatch.setattr(np.linalg, "cholesky", fail)
    fit.damped_direction(np.eye(2), np.ones(2), 1e-6)
    assert np.allclose(tried, [1 + 1e-6, 2.0, 1 + 1e6, 1 + 1e12])


def test_long_lists_go_by_ranges_and_grid(spark):
    rng = np.random.default_rng(4)
    b = spark.createDataFrame([(float(v),) for v in rng.integers(0, 50, 40)] + [(None,)], "z double")
    df = spark.createDataFrame([(n, float(v)) for n, v in enumerate(rng.integers(-3, 60, 80))] + [(99, None)], "id int, d double")
    few = {r["id"]: r["layer"] for r in joins.layer_of(df.dropna(), b, "z", "d").collect()}
    many = {r["id"]: r["layer"] for r in joins.layer_of(df, b, "z", "d", array_bytes=0).collect()}
    assert {k: v for k, v in many.items() if k != 99} == few and many[99] == 0
    refs = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(rng.integers(0, 30, (60, 2)))], "rid int, x double, y double")
    pts = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(rng.integers(-100, 130, (90, 2)))], "id int, x double, y double")
    got = [{r["id"]: (r["nearest_id"], r["distance"]) for r in joins.nearest(pts, refs, "rid", ["x", "y"], array_bytes=a).collect()} for a in (1 << 16, 0)]
    assert got[0].keys() == got[1].keys() and all(got[0][k] == pytest.approx(got[1][k]) for k in got[0])
