import datetime as dt
import math
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terrane.functions import arrays, sql_functions
from terrane.operators import tree
from terrane.sources import cases, deck, well_text
from terrane.streaming import messages, run_stream


def _text(spark, *lines, path="f"):
    return spark.createDataFrame([(path, n, t) for n, t in enumerate(lines)], "path string, line_no int, text string")


def test_tracks_end_at_slash_and_at_words(spark, tmp_path):
    f = tmp_path / "t.inc"
    f.write_text("WELLTRACK 'p1' -- a comment\n1 2 3 4\n5 6 7 8 9\nEND OF IT\n9 9 9 9\nWELLTRACK\tP2:1\n\n1 1 1 1 / rest\n2 2 2 2\nWELLTRACK P1\n7 7 7\n")
    got = [(r["well"], r["place"], r["x"], r["md"]) for r in well_text.tracks(well_text.lines(spark, str(f))).orderBy("track_no", "place").collect()]
    assert got == [("P1", 0, 1.0, 4.0), ("P1", 1, 5.0, 8.0), ("P2:1", 0, 1.0, 1.0)]


def test_event_table(spark):
    t = _text(spark, "'P1' 01.02.2020 PERF 10 20 2* 0.5", "P1 03.02.2020 SQUE 1 2", "P2 99.02.2020 PERF 1 2 0.1 1 1 BRANCH 3 CLOSE", "P1 05.02.2020 PROD OIL 100 BHPT x OIL 7", "ENDE", "P9 01.01.2021 PERF 1 1")
    p = well_text.perforations(t, ["L1", "L2", "RAD", "SKIN", "MULT"]).orderBy("line_no").collect()
    assert [(r["well"], r["l1"], r["rad"], r["skin"], r["mult"], r["close"]) for r in p] == [("P1", 10.0, 0.1524, 0.0, 0.5, False), ("P2:3", 1.0, 0.1, 1.0, 1.0, True)]
    assert p[0]["date"] == dt.datetime(2020, 2, 1) and p[1]["date"] is None
    c = well_text.control_events(t).collect()
    assert [(r["well"], r["mode"], r["oil"], r["bhpt"], r["gas"]) for r in c] == [("P1", "PROD", 7.0, None, None)]
    with pytest.raises(Exception, match="several modes"):
        well_text.control_events(_text(spark, "P1 05.02.2020 PROD INJE")).collect()
    h = well_text.history(_text(spark, "'P1' 01.02.2020 1 2.5 x", "/", "P2 01.02.2020 1 1 1"), ["QOIL", "QWAT", "QGAS"]).collect()
    assert [(r["well"], r["qoil"], r["qwat"], r["qgas"]) for r in h] == [("P1", 1.0, 2.5, None)]


def test_output_dates_and_restart(spark, tmp_path):
    f = tmp_path / "D.DATA"
    f.write_text("RUNSPEC\nRESTART\n 'BASE' 12 /\nSCHEDULE\nARRAY DATE\n01 JAN 2020\n15 JLY 2021\n/\n")
    r = deck.read(spark, str(f)).cache()
    assert [x["ts"] for x in deck.output_dates(r).orderBy("place").collect()] == [dt.datetime(2020, 1, 1), dt.datetime(2021, 7, 15)]
    assert [(x["name"], x["step"]) for x in deck.keyword_rows(r, "RESTART").collect()] == [("BASE", 12)]


def test_case_files(tmp_path):
    (tmp_path / "results" / "deep").mkdir(parents=True)
    for n in ("m.DATA", "results/M.egrid", "results/M.INIT", "results/deep/other.UNRST", "results/M.SMSPEC"):
        (tmp_path / n).write_text("x")
    c = cases.resolve(str(tmp_path / "m.DATA"))
    assert Path(c.egrid).name == "M.egrid" and Path(c.init).name == "M.INIT" and Path(c.unrst).name == "other.UNRST" and c.esmry is None and Path(c.summary).name == "M.SMSPEC"
    (tmp_path / "results" / "M.ESMRY").write_text("x")
    assert Path(cases.resolve(str(tmp_path / "m.DATA")).summary).suffix == ".ESMRY"
    (tmp_path / "results" / "M.egrid").unlink()
    with pytest.raises(FileNotFoundError):
        cases.resolve(str(tmp_path / "m.DATA"))


def test_uploads_and_archives(spark, tmp_path):
    chunks = lambda *rows: spark.createDataFrame(rows, "name string, part int, data binary")
    got = cases.uploaded(chunks(("a", 1, b"SPEC"), ("a", 0, b"RUN"), ("a", 1, b"SPEC"), ("b", 0, b"x"), ("b", 1, None)))
    assert {r["name"]: bytes(r["deck"]) for r in got.collect()} == {"a": b"RUNSPEC", "b": b"x"}
    for rows, why in (([("c", 0, b" \n")], "is empty"), ([("c", 0, b"12345"), ("c", 1, b"6")], "larger than 5")):
        with pytest.raises(Exception, match=why):
            cases.uploaded(chunks(*rows), 5).collect()
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("M.EGRID", "g")
    a = cases.unpacked(str(tmp_path / "r.zip"), str(tmp_path))
    assert (Path(a) / "M.EGRID").read_text() == "g" and cases.unpacked(str(tmp_path / "r.zip"), str(tmp_path)) == a
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out", "g")
    with pytest.raises(ValueError, match="leads out"):
        cases.unpacked(str(tmp_path / "bad.zip"), str(tmp_path))


def test_addresses_and_epochs(spark):
    a = spark.createDataFrame([("WOPR:P1",), ("WOPRH:P1",), ("FOPR",), ("P1/WOPR",), ("WOPR:P11",)], "address string")
    w = spark.createDataFrame([("WOPR", "P1"), ("WOPR", "P11"), ("WBHP", "P1")], "vector string, well string")
    got = {(r["vector"], r["well"]): (r["address"], r["score"]) for r in cases.best_addresses(a, w).collect()}
    assert got == {("WOPR", "P1"): ("WOPR:P1", 38), ("WOPR", "P11"): ("WOPR:P11", 38)}
    day = 1_600_000_000
    rows = [("s", n, day + n * 86400 * 2) for n in range(3)] + [("ms", n, (day + n) * 1000) for n in range(3)] + [("ns", n, (day + n) * 10**9) for n in range(3)] + [("bad", 0, 10**19 // 10), ("bad", 1, None)]
    d = {(r["k"], r["n"]): r["ts"] for r in cases.epoch_dates(spark.createDataFrame(rows, "k string, n int, raw long"), ["k"], "n", "raw").collect()}
    first = dt.datetime(2020, 9, 13, 12, 26, 40)
    assert d[("s", 0)] == d[("ms", 0)] == d[("ns", 0)] == first and d[("bad", 0)] is None
    s = spark.createDataFrame([(2020, 0, 3), (2020, 13, 1), (None, 1, 1)], "y int, m int, d int").select(cases.stamp(F.col("y"), F.col("m"), F.col("d")).alias("t")).collect()
    assert [r["t"] for r in s] == [dt.datetime(2020, 1, 3), None, None]


TREE = [("FIELD", None, "group"), ("G1", "FIELD", "group"), ("G2", "FIELD", "group"), ("G3", "G2", "group"), ("A", "G1", "well"), ("A1", "A", "well"), ("A2", "A1", "well"), ("B", "FIELD", "well")]


@pytest.fixture(scope="module")
def small_tree(spark):
    return spark.createDataFrame(TREE, "node string, parent string, kind string")


def _names(df):
    return {r["node"] for r in df.collect()}


def test_tree_orders(small_tree):
    t = tree.traversal(small_tree)
    assert [r["node"] for r in t.orderBy("pre").collect()] == ["FIELD", "B", "G1", "A", "A1", "A2", "G2", "G3"]
    assert [r["node"] for r in t.orderBy("post").collect()] == ["B", "A2", "A1", "A", "G1", "G3", "G2", "FIELD"]
    assert tree.rendered(small_tree).filter("node = 'A1'").first()["text"] == "            +-- A1"
    assert _names(tree.glob(small_tree, "G*")) == {"G1", "G2"} and _names(tree.glob(small_tree, "/G1/?/A*")) == {"A1"}


def test_tree_changes(spark, small_tree):
    assert _names(tree.dropped(small_tree, ["G1", "none"])) == {"FIELD", "G2", "G3", "B"}
    assert _names(tree.without_empty_groups(small_tree)) == {"FIELD", "G1", "A", "A1", "A2", "B"}
    g = {r["node"]: r["parent"] for r in tree.grouped(small_tree, ["A", "B"], "N", "FIELD").collect()}
    assert g["A"] == g["B"] == "N" and g["N"] == "FIELD"
    with pytest.raises(ValueError):
        tree.grouped(small_tree, ["A", "G1"], "N", "FIELD")
    blocks = spark.createDataFrame([("A2",)], "node string")
    out = {r["node"]: r["parent"] for r in tree.inside_wells(small_tree, blocks).collect()}
    assert out == {"FIELD": None, "G1": "FIELD", "G2": "FIELD", "G3": "G2", "A2": "G1"}
    assert _names(tree.inside_wells(small_tree, blocks, keep_ancestors=True)) == {"FIELD", "G1", "G2", "G3", "A", "A1", "A2"}
    have = spark.createDataFrame([("A", "WELLTRACK"), ("A", "PERF"), ("A1", "PERF"), ("B", "COMPDAT")], "node string, attribute string")
    assert _names(tree.complete_wells(small_tree, have, ["WELLTRACK", "PERF"])) == {"FIELD", "G1", "G2", "G3", "A", "B"}
    with pytest.raises(ValueError, match="cycle"):
        tree.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"), 5)


def test_array_actions(spark):
    g = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(2) for j in range(3)], "i int, j int, v double")
    at = lambda df, c="v": {(r["i"], r["j"]): r[c] for r in df.collect()}
    assert at(arrays.turned(g, "i", "j", 2, 3))[(2, 0)] == 0.0 and at(arrays.turned(g, "i", "j", 2, 3, 4)) == at(g)
    p = at(arrays.padded(g, {"i": 2, "j": 3}, {"i": 1}, {"j": 1}, ["v"], -1.0))
    assert len(p) == 12 and p[(1, 0)] == 0.0 and p[(0, 0)] == p[(2, 3)] == -1.0
    c = arrays.crops(g, {"i": 2, "j": 3}, {"i": 1, "j": 2}, 4, 7)
    assert c.groupBy("crop").count().filter("count <> 2").isEmpty() and c.count() == 8
    assert c.agg(F.max("i"), F.max("j")).first()[:] == (0, 1) and sorted(map(tuple, c.collect())) == sorted(map(tuple, arrays.crops(g, {"i": 2, "j": 3}, {"i": 1, "j": 2}, 4, 7).collect()))
    with pytest.raises(KeyError):
        arrays.project(g, ["i"], ["W"])
    assert arrays.project(g, ["i"], ["V"]).columns == ["i", "v"]
    doubled = arrays.apply_each_slice(g, lambda pdf: pdf.assign(v=pdf["v"] - pdf["v"].min()), "i", "i int, j int, v double")
    assert at(doubled)[(1, 2)] == 2.0
    new, changed = arrays.updated(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3), F.lit("c"), F.lit(4)))
    r = spark.range(1).select(new.alias("m"), changed.alias("c")).first()
    assert r["m"] == {"a": 1, "b": 3, "c": 4} and r["c"] == ["b"]


def _steps(run, n, n_iter=None, eta=None, failure=None):
    return [(run, k, float(100 - k), 1.0, 0.0, 0.0, 0.0, 0.5 * k, 0.0 if k == eta else 0.5, "no more" if k == failure else None, n_iter) for k in range(1, n + 1)]


@pytest.mark.parametrize(("n", "log", "snap"), [(10, 1, 5), (10, 3, 3), (7, 2, 4), (1, 1, 1), (12, 4, 6), (5, 2, 0)])
def test_a_run_sends_what_is_planned(spark, tmp_path, n, log, snap):
    plan = [(r["kind"], r["iteration"] if r["kind"] != "stage" else 0, r["slot"]) for r in run_stream.plan(spark, n, log, snap, 2).orderBy("seq").collect()]
    got = run_stream.replay(spark.createDataFrame(_steps("a", n + 3, n), run_stream.STEP), str(tmp_path / "r"), log_every=log, snapshot_every=snap, n_snapshots=2)
    assert [(r["kind"], r["iteration"], r["slot"]) for r in got.orderBy("step", "place").collect()] == plan


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, run_stream.STEP).coalesce(1).write.mode("append").parquet(src)

    def go():
        stream = spark.readStream.schema(run_stream.STEP).option("maxFilesPerTrigger", 1).parquet(src)
        run_stream.start(run_stream.messages_of(run_stream.follow(stream, adapt_every=4), 2, 4, 1), folder).awaitTermination()
        return spark.read.parquet(folder + "/messages").orderBy("run", "step", "place").collect()

    a, b = _steps("a", 9, 8), _steps("b", 9, None, eta=7) + _steps("c", 9, None, failure=3)
    put(a[:3] + b[:2])
    first = go()
    assert go() == first  # nothing new, nothing doubled
    put(a[3:5] + b[2:14])
    go()
    put(a[5:] + b[14:])
    got = go()
    assert [(r["step"], r["kind"]) for r in got if r["run"] == "a" and r["kind"] in ("loss", "state", "metrics")] == [(1, "state"), (2, "loss"), (4, "loss"), (4, "state"), (6, "loss"), (8, "loss"), (8, "state"), (8, "metrics")]
    assert [r["total"] for r in got if r["run"] == "a" and r["kind"] == "loss"] == [98.0, 96.0, 94.0, 92.0]
    stalled = [r for r in got if r["run"] == "b"]
    assert [r["kind"] for r in stalled][-5:] == ["loss", "stage", "state", "metrics", "stage"] and "after iteration 7" in stalled[-4]["payload"] and max(r["step"] for r in stalled) == 7
    assert [(r["run"], r["iteration"], r["message"]) for r in run_stream.failures(spark.createDataFrame(got)).collect()] == [("c", 3, "no more")]
    assert got[-1]["kind"] == "error"


def test_a_silent_run_beats(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(_steps("a", 2) + _steps("b", 2, 2), run_stream.STEP).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(run_stream.STEP).parquet(src)
    q = run_stream.start(run_stream.messages_of(run_stream.follow(stream, beat_ms=500), 1, 0, 0), str(tmp_path / "out"), processingTime="200 milliseconds")
    try:
        for _ in range(120):
            q.awaitTermination(1)
            rows = spark.read.schema("run string, place long, payload string").parquet(str(tmp_path / "out/messages")).filter("payload LIKE '%beat%'").collect() if (tmp_path / "out/messages/_spark_metadata").exists() else []
            if len(rows) >= 2:
                break
    finally:
        q.stop()
    assert {r["run"] for r in rows} == {"a"} and len({r["place"] for r in rows}) == len(rows) >= 2  # b has ended


def test_window_is_drawn_anew(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(_steps("a", 9), run_stream.STEP).coalesce(1).write.parquet(src)
    seen = []
    q = run_stream.follow(spark.readStream.schema(run_stream.STEP).parquet(src), adapt_every=4).writeStream.foreachBatch(lambda df, n: seen.extend(df.filter("redraw").collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["iteration"] for r in seen) == [5, 9]


def test_sql_functions_are_inlined(spark):
    sql_functions.register(spark)
    df = spark.sql("SELECT clean_name(\" 'p1' \") AS n, unlog_time(log_time(30D, 1D, 5D), 1D, 5D) AS t, cell_ordinal(1L, 2L, 3L, 4L, 5L) AS c, well_index(CAST(NULL AS DOUBLE), 10D, 100D, 100D, 20D, 0.25D, 0D) AS w")
    r = df.first()
    assert r["n"] == "P1" and r["t"] == pytest.approx(30) and r["c"] == 69 and r["w"] == pytest.approx(2 * math.pi * 10 * 100 / math.log(80))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_stream_keeps_the_last_of_each_kind(spark, tmp_path):
    src = tmp_path / "in"
    schema = "run string, kind string, iteration int, payload string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    put([("a", "loss", n, f"l{n}") for n in range(5)] + [("a", "state", 1, "s1"), ("b", "loss", 9, "l9"), ("a", "grid", 0, "g")])
    stream = spark.readStream.schema(schema).parquet(str(src))
    seen = {}

    def take(df, batch):
        seen[batch] = [tuple(r) for r in df.orderBy("run", "kind", "place").collect()]

    q = messages.with_last(stream, {"loss": 2, "state": 1}, 0).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck")).outputMode("update").start()
    try:
        q.processAllAvailable()
        put([("a", "loss", 5, "l5"), ("a", "state", 2, "s2")])
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen[0] == [("a", "loss", 4, "l4", 0), ("a", "loss", 3, "l3", 1), ("a", "state", 1, "s1", 0), ("b", "loss", 9, "l9", 0)]
    assert seen[1] == [("a", "loss", 5, "l5", 0), ("a", "loss", 4, "l4", 1), ("a", "state", 2, "s2", 0)]
