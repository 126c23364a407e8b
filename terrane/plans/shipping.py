"""Makes this package importable on the executors where it isn't installed there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the workers, once an application.

    Nothing is sent on a local master whose ``PYTHONPATH`` has it already; executors elsewhere always get it.
    """
    app = spark.sparkContext.applicationId
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    local = spark.sparkContext.master.split("[")[0] == "local"
    if app in _shipped or (local and str(ROOT) in paths):
        return
    target = Path(tempfile.mkdtemp(prefix="terrane-")) / "terrane.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((ROOT / "terrane").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
