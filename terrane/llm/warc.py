"""WARC revisit resolution: one response an equal payload, revisit records for the rest.

Headers (id, address, digest, length) are reduced by payload digest to the originals of
repeated payloads; digests that occur once need no decision. While the originals' measured
size is small they are broadcast to the payloads. Beyond, payloads join them in a shuffle by
digest and a salt of 32 values, so a payload that fills a third of the input is spread.

Nulls: a null payload is empty; null ids come last, so a record with a null id is only an
original if all of its group are, and its group then has no ``refers_to``. Rows that repeat
the original's id and payload are responses too, and records that are equal in id, address
and payload share a record id. An empty table writes no archive.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.warc_source import SCHEMA, WarcSource
from terrane.plans.shipping import ship
from terrane.plans.storage import BROADCAST_BYTES, memory_bytes, shared_dir, written

MIN_BYTES, SALTS = 100, 32


def resolve(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES, max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``warc_source.SCHEMA``, each a response or a revisit."""
    raw = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("target_uri"), raw.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "target_uri"))
    firsts = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), first.alias("o")).filter("n > 1")
    firsts = written(firsts.select("payload_digest", F.col("o.page_id").alias("o_id"), F.col("o.target_uri").alias("o_uri"), F.lit(True).alias("o_any")))
    small = memory_bytes(firsts) <= max_broadcast
    revisit = F.coalesce(F.col("o_any"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("o_id"))
    if small:
        joined = rows.join(F.broadcast(firsts), "payload_digest", "left")
    else:
        salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "target_uri", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "salt"], "left")
    return joined.select(
        "page_id", "target_uri", F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        F.when(revisit, F.col("o_id")).alias("refers_to"), F.when(revisit, F.col("o_uri")).alias("refers_to_uri"),
        "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(records: DataFrame, path: str) -> None:
    ship(records.sparkSession)
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).load()


def deduplicate(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the deduplicated archives of ``pages`` and read them back."""
    path = path or shared_dir(pages.sparkSession)
    write(resolve(pages, **options), path)
    return read(pages.sparkSession, path)


def digest(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


__all__ = ["MIN_BYTES", "SCHEMA", "deduplicate", "digest", "read", "resolve", "write"]
