"""Written intermediates in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a finished query are deleted at its end; no garbage collection has to come by.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables up to so many bytes in memory may be broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the session's ``spark.checkpoint.dir``.

    Only where that is unset on a local master (tests on one machine) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="terrane-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/terrane-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts lineage, survives lost executors, and is compressed and column-pruned on
    reading, so it costs less disk than a checkpoint of rows. Values are written plainly:
    most are hashes, for which a dictionary only costs time.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.enable.dictionary", "false").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._terrane_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._terrane_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def memory_bytes(df: DataFrame) -> int:
    """Size in memory, measured: 16 bytes a value, and what texts and arrays hold."""
    total = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind == "array":
            total = total + 8 * F.greatest(F.size(f.name), F.lit(0))
    return df.agg(F.sum(total)).first()[0] or 0


def sized(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A table (a written one, as it is measured), marked for broadcast only if its measured size is at most ``max_bytes``.

    Beyond that it stays as it is, and Spark joins it by shuffle; the result is the same.
    """
    return F.broadcast(df) if memory_bytes(df) <= max_bytes else df
