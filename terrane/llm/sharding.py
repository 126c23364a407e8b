"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is a hash of its id and text; each shard owns the arcs before
its virtual nodes. Rows that meet a full shard go on clockwise to the next node with
room, so no shard passes its capacity and few rows move when the shards change.

The ring has ``ARCS`` slots. One pass counts rows by slot (a table of fixed size), the
driver fills the shards slot by slot from those counts alone, and a second pass gives
each row its rank in its slot and so its shard. Neither pass gathers rows anywhere.

Null ids and texts hash as such; equal ids with other texts lie elsewhere; repeated rows
are separate rows and each gets a slot of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ARCS = 1 << 16


@dataclass(frozen=True)
class Ring:
    """Virtual nodes of ``shards`` shards on a ring of ``ARCS`` slots."""

    shards: int
    virtual_nodes: int = 128

    def nodes(self) -> list[tuple[int, int]]:
        """(slot, shard), sorted."""
        place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()) % ARCS
        return sorted((place(s, v), s) for s in range(self.shards) for v in range(self.virtual_nodes))


def fill(counts: dict[int, int], ring: Ring, capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (slot, first rank, last rank + 1, shard, first place in the shard).

    Slots come in a fixed shuffled order, so that no part of the ring is always last.
    """
    if sum(capacity) < sum(counts.values()):
        raise ValueError("the shards have room for fewer rows than there are")
    nodes = ring.nodes()
    at = [p for p, _ in nodes]
    room, used, pieces = list(capacity), [0] * len(capacity), []
    for slot in sorted(counts, key=lambda a: (a * 40503 % ARCS, a)):
        left, rank, k = counts[slot], 0, bisect_left(at, slot) % len(nodes)
        while left:
            shard = nodes[k][1]
            if take := min(left, room[shard]):
                pieces.append((slot, rank, rank + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                rank += take
                left -= take
            k = (k + 1) % len(nodes)
    return pieces


def even_capacity(rows: int, shards: int) -> list[int]:
    """Room for exactly ``rows`` rows, counts at most one apart: the tightest bound on loads."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = 128, load_factor: float | None = None) -> DataFrame:
    """id, size, text_crc32, shard and slot of each row.

    ``load_factor`` c bounds each shard to ``ceil(c * rows / shards)``; None bounds it to
    the even share, so that counts are at most one apart.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("__h", F.xxhash64("__id", "text_crc32")).withColumn("__slot", F.shiftrightunsigned("__h", 48).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy("__slot").count().collect()}  # ARCS rows at most
    total = sum(counts.values())
    capacity = even_capacity(total, shards) if load_factor is None else [-int(-load_factor * total // shards)] * shards
    pieces = pd.DataFrame(fill(counts, Ring(shards, virtual_nodes), capacity), columns=["__slot", "__from", "__to", "shard", "__first"]).astype({"__slot": "int32", "shard": "int32", "__from": "int64", "__to": "int64", "__first": "int64"})
    table = spark.createDataFrame(pieces, "__slot int, __from long, __to long, shard int, __first long")  # under ARCS + shards * nodes rows
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__slot").orderBy("__h", "__id", "text_crc32", "size")) - 1)
    placed = ranked.join(F.broadcast(table), (ranked["__slot"] == table["__slot"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    return placed.select(F.col("__id").alias(id_col), "size", "text_crc32", "shard", (F.col("__first") + F.col("__rank") - F.col("__from")).cast("long").alias("slot"))
