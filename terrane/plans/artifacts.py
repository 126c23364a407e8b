"""Named tables kept with a manifest, and served only while their sources are unchanged.

The manifest is written last, as a one-row Parquet table, so a set that was cut short is
never served. A table with a ``mode`` column serves any smaller number of modes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def signature(spark: SparkSession, paths: list[str]) -> str:
    """Sizes and times of files, as one digest; absent files count as such."""
    rows = []
    for p in sorted(paths):
        try:
            rows += [(r["path"], r["length"], str(r["modificationTime"])) for r in spark.read.format("binaryFile").load(p).select("path", "length", "modificationTime").collect()]
        except AnalysisException:
            rows.append((p, -1, ""))
    df = spark.createDataFrame([(json.dumps(rows),)], "s string")
    return df.select(F.sha1("s")).first()[0]


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame], source: str) -> None:
    made = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{made}/{name}")
    manifest = json.dumps({"version": VERSION, "source": source, "at": made, "tables": sorted(tables)})
    spark.createDataFrame([(manifest,)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{root}/_manifest")


def load(spark: SparkSession, root: str, source: str) -> dict[str, DataFrame] | None:
    """The tables, or None if there are none or they are stale."""
    try:
        m = json.loads(spark.read.parquet(f"{root}/_manifest").first()[0])
    except AnalysisException:
        return None
    if (m["version"], m["source"]) != (VERSION, source):
        return None
    return {t: spark.read.parquet(f"{root}/{m['at']}/{t}") for t in m["tables"]}


def build_or_load(spark: SparkSession, root: str, source: str, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    found = load(spark, root, source)
    if found is None:
        save(spark, root, build(), source)
        found = load(spark, root, source)
    return found


def modes(basis: DataFrame, n: int) -> DataFrame:
    """The first ``n`` modes of a wider basis: a filter that reaches the scan."""
    return basis.filter(F.col("mode") < n)
