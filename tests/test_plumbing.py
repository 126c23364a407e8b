import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrane.functions import sampling
from terrane.plans import artifacts
from terrane.plans.settings import PRESETS, Settings, SettingsError
from terrane.sources import rsm, text_sinks


def test_array_text(spark):
    values = [1.5] * 6 + [2.0] * 3 + [1.5] + [0.0] * 100
    df = spark.createDataFrame([("PORO", i, v) for i, v in enumerate(values)], "attr string, pos int, v double")
    lines = text_sinks.array_text(df, ["attr"], "pos", "v").orderBy("line").collect()
    assert lines[0]["text"] == "6*1.5 2.0 2.0 2.0 1.5 100*0.0"


def test_table_text(spark):
    df = spark.createDataFrame([(1.0, 10.0, 1.1), (2.0, 20.0, 1.2), (2.0, 30.0, 1.1)], "rs double, p double, b double")
    got = [r["text"] for r in text_sinks.table_text(df, ["rs", "p", "b"], "rs").orderBy("line").collect()]
    assert got == ["1.000000 10.000000 1.100000 /", "2.000000 20.000000 1.200000", " 30.000000 1.100000 /"]
    day = spark.createDataFrame([(dt.datetime(2020, 7, 6),)], "t timestamp")
    assert day.select(text_sinks.date_text(F.col("t")).alias("d")).first()["d"] == "6 JLY 2020 /"


def test_rsm(spark, tmp_path):
    row = lambda *x: "".join(s.ljust(13) for s in x)
    body = "\n".join(["1 SUMMARY OF RUN A", " -----", row(" TIME", "WOPR", "WOPT"), row(" DAYS", "STB/DAY", "STB"), row("", "", "*10**3"), row("", "P1", "P1"), " -----", row(" 1.0", "5", "0.25"), row(" 2.0", "6", "0.5")])
    (tmp_path / "a.rsm").write_text(body)
    got = {(r["row"], r["name"]): (r["well"], r["value"]) for r in rsm.read(spark, str(tmp_path / "a.rsm")).collect()}
    assert got[(0, "WOPT")] == ("P1", 250.0) and got[(1, "WOPR")] == ("P1", 6.0) and got[(1, "TIME")] == (None, 2.0)


def test_artifacts(spark, tmp_path):
    f = tmp_path / "deck.txt"
    f.write_text("a")
    sign = lambda: artifacts.signature(spark, [str(f), str(tmp_path / "absent")])
    root, calls = str(tmp_path / "cache"), []

    def build():
        calls.append(1)
        return {"basis": spark.range(10).select(F.col("id").alias("mode"))}

    first = sign()
    for _ in range(2):
        t = artifacts.build_or_load(spark, root, first, build)
    assert len(calls) == 1 and artifacts.modes(t["basis"], 4).count() == 4
    f.write_text("ab")
    assert sign() != first and artifacts.load(spark, root, sign()) is None


def test_settings(spark):
    assert Settings().checked().digest() == Settings().digest() != PRESETS["large"].digest()
    assert Settings(log_every=3).problems()[1]
    with pytest.raises(SettingsError):
        Settings(encoding="other", width=0).checked()
    assert Settings().row(spark).first()["weight_pde"] == 1.0


def test_sampling(spark):
    assert sampling.positions(10, 4) == [0, 3, 6, 9] and sampling.positions(3, 9) == [0, 1, 2]
    assert sampling.strata(100.0, 25.0, 8) == [(0.0, 25.0, 2), (25.0, 100.0, 6)]
    t = [r["t"] for r in sampling.middle_times(spark, 0.0, 4.0, 4).orderBy("k").collect()]
    assert t == [0.5, 1.5, 2.5, 3.5]
    df = spark.range(50)
    one, two = (sorted(r["id"] for r in sampling.window(df.repartition(n), "id", 7, 3, False).collect()) for n in (1, 5))
    assert one == two and len(set(one)) == 7
    assert sampling.window(df, "id", 80, 3, True, 50).count() == 80
    assert sampling.capped(df, "id", 50, 3).count() == 3
