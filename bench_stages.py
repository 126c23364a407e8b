"""Times the stages of a model on grids of 300 and 9,375 cells: parse, mesh, operators, eigenpairs, wells, one step of a fit. One JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

GRIDS = {"300": (10, 10, 3), "9375": (25, 25, 15)}


def deck_text(nx: int, ny: int, nz: int) -> str:
    n = nx * ny * nz
    poro = " ".join(f"{0.1 + (c % 17) / 100:.3f}" for c in range(n))
    perm = " ".join(f"{10 + c % 400}" for c in range(n))
    wells = "".join(f"W{w} OPEN ORAT {100 + w} 4* 1000 /\n" for w in range(20))
    steps = "".join(f"WCONPROD\n{wells}/\nTSTEP\n30 /\n" for _ in range(24))
    return f"RUNSPEC\nDIMENS\n{nx} {ny} {nz} /\nMETRIC\nSTART\n1 JAN 2020 /\nGRID\nPORO\n{poro} /\nPERMX\n{perm} /\nSCHEDULE\n{steps}END\n"


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from terrane.operators import cells, fem, fit, mesh, wells
    from terrane.plans.storage import written
    from terrane.sources import deck

    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="terrane-bench-")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", work).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, dict[str, float]] = {}
    for name, (nx, ny, nz) in GRIDS.items():
        path, times = Path(work) / f"{name}.DATA", {}
        path.write_text(deck_text(nx, ny, nz))

        def timed(stage: str, f, times=times):
            began = time.perf_counter()
            value = f()
            times[stage] = round(time.perf_counter() - began, 2)
            return value

        records = timed("parse", lambda: written(deck.read(spark, str(path))))
        report = deck.clocked(records).filter("keyword = 'TSTEP' AND record_no = 0").select("ts").crossJoin(spark.range(20).select(F.concat(F.lit("W"), F.col("id")).alias("well")))
        timed("wells", lambda: wells.resolve_controls(report, deck.controls(records)).write.format("noop").mode("overwrite").save())
        grid = cells.grid(spark, nx, ny, nz).select("cell_id", (F.col("i") * 50.0).alias("x0"), (F.col("j") * 50.0).alias("y0"), (F.col("k") * 10.0).alias("z0"), F.lit(50.0).alias("dx"), F.lit(50.0).alias("dy"), F.lit(10.0).alias("dz"))
        corners = cells.corner_points(grid)

        def build(corners=corners, records=records):
            vertices, incidence = mesh.vertices_of(corners)
            box = corners.groupBy("cell_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.array("x", "y", "z").alias("p")))), lambda c: c["p"])).alias("corners"))
            ids = incidence.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "vertex_id"))), lambda c: c["vertex_id"]).alias("v"))
            k = deck.array(records, "PERMX").select(F.col("pos").cast("long").alias("cell_id"), F.col("value").alias("kx"))
            return vertices.count(), written(box.join(ids, "cell_id").join(k, "cell_id").withColumn("ky", F.col("kx")).withColumn("kz", F.col("kx") / 10))

        n, box = timed("mesh", build)
        a, m = timed("operators", lambda box=box: (written(fem.operator(box, "stiffness")), written(fem.operator(box, "mass"))))
        if n <= 4096:
            timed("eigenpairs", lambda n=n, a=a, m=m: fem.eigenpairs(fem.dense(a, n), fem.dense(m, n), 5))
        else:
            timed("eigenpairs", lambda n=n, a=a, m=m: fem.subspace_eigenpairs(a, m, n, 5))
        net = fit.Network(3, 4, 8, 1)
        rows = grid.select(*[(F.col(c) / s).alias(c) for c, s in (("x0", 1000.0), ("y0", 1000.0), ("z0", 100.0))], *[F.sin(F.col("x0") / 300 + q).alias(f"t{q}") for q in range(4)])
        timed("fit_step", lambda rows=rows, net=net: fit.step(rows, net, net.init(0), ["x0", "y0", "z0"], [f"t{q}" for q in range(4)]))
        out[name] = times
    print(json.dumps({"metric": "stage_seconds", "unit": "sec", "cores": int(cpus), "stages": out}))


if __name__ == "__main__":
    main()
