"""A Spark data source for simulator result files: one row a section.

A section is a name of 8 characters, a count, a type, and data in blocks of 1000 numbers
or 105 strings, each between four-byte record marks; all numbers are big-endian. Only the
headers of sections that aren't asked for are read (option ``names``).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrane.operators.windows import sorted_ids
from terrane.plans.shipping import ship

SCHEMA = "path string, ordinal int, step int, name string, kind string, numbers array<double>, strings array<string>"
_SIZES = {"INTE": (4, ">i4"), "REAL": (4, ">f4"), "DOUB": (8, ">f8"), "LOGI": (4, ">i4")}


def _take(stream, n: int) -> bytes:
    raw = stream.read(n)
    if len(raw) != n:
        raise ValueError("a result file is cut short")
    return raw


def sections(stream, names: frozenset[str] | None = None) -> Iterator[tuple[str, str, np.ndarray | list[str] | None]]:
    """(name, type, data) of each section; data is None for names that aren't asked for."""
    while head := stream.read(4):
        if struct.unpack(">i", head)[0] != 16:
            raise ValueError("no section header where one should be")
        raw = _take(stream, 16)
        _take(stream, 4)
        name, count, kind = raw[:8].decode("latin-1").strip(), struct.unpack(">i", raw[8:12])[0], raw[12:].decode("latin-1")
        width, dtype = _SIZES.get(kind, (8 if kind in ("CHAR", "MESS") else int(kind[1:]) if re.match(r"C\d{3}", kind) else 0, ""))
        wanted, parts, left = names is None or name in names, [], count * width
        while left > 0:
            size = struct.unpack(">i", _take(stream, 4))[0]
            if wanted:
                parts.append(_take(stream, size))
            else:
                stream.seek(size, 1)
            _take(stream, 4)
            left -= size
        if not wanted:
            yield name, kind, None
        elif dtype:
            yield name, kind, np.frombuffer(b"".join(parts), dtype)
        else:
            data = b"".join(parts).decode("latin-1")
            yield name, kind, [data[i : i + width].strip() for i in range(0, len(data), width)] if width else []


def encoded(name: str, kind: str, data) -> bytes:
    """A section's bytes."""
    mark = lambda raw: struct.pack(">i", len(raw)) + raw + struct.pack(">i", len(raw))
    out = mark(name.ljust(8).encode() + struct.pack(">i", len(data)) + kind.encode())
    block = 105 if kind not in _SIZES else 1000
    for i in range(0, len(data), block):
        part = data[i : i + block]
        out += mark(np.asarray(part).astype(_SIZES[kind][1]).tobytes() if kind in _SIZES else b"".join(s.ljust(8)[:8].encode("latin-1") for s in part))
    return out


@dataclass
class ResultFile(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


class EclReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = options["path"].split(",")
        self.names = frozenset(options["names"].split(",")) if options.get("names") else None

    def partitions(self) -> list[ResultFile]:
        return [ResultFile(p) for p in self.paths]

    def read(self, partition: ResultFile) -> Iterator[tuple]:
        store, at = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        step, several = -1, re.search(r"\.[XF](\d{4})$", at)
        with store.open_input_file(at) as stream:
            for n, (name, kind, data) in enumerate(sections(stream, self.names)):
                step += name in ("SEQNUM", "SEQHDR")  # each begins a report step
                if data is None:
                    continue
                numbers = data.astype(float).tolist() if isinstance(data, np.ndarray) else None
                yield partition.path, n, int(several[1]) if several else max(step, 0), name, kind, numbers, None if numbers is not None else data


class EclSource(DataSource):
    """``format("ecl")``: options ``path`` (several by comma) and ``names`` (sections to read)."""

    @classmethod
    def name(cls) -> str:
        return "ecl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EclReader:
        return EclReader(self.options)


def read(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    ship(spark)
    spark.dataSource.register(EclSource)
    r = spark.read.format("ecl").option("path", path)
    return (r.option("names", names) if names else r).load()


def states(spark: SparkSession, path: str, attributes: tuple[str, ...] = ("PRESSURE", "SWAT", "SGAS", "RS")) -> DataFrame:
    """step, cell_id and one column an attribute, from a unified or several restart files."""
    rows = read(spark, path, ",".join(("SEQNUM", *attributes))).filter(F.col("name").isin(*attributes))
    cells = rows.select("path", "step", "name", F.posexplode("numbers").alias("cell_id", "v"))
    return cells.groupBy("step", "cell_id").pivot("name", list(attributes)).agg(F.first("v")).withColumnsRenamed({a: a.lower() for a in attributes})


def well_results(spark: SparkSession, specs: str, summary: str) -> DataFrame:
    """step, well, keyword and value: summary vectors of names that begin with a letter or digit."""
    s = read(spark, specs, "KEYWORDS,WGNAMES").groupBy().agg(F.max(F.when(F.col("name") == "KEYWORDS", F.col("strings"))).alias("k"), F.max(F.when(F.col("name") == "WGNAMES", F.col("strings"))).alias("w"))
    addresses = s.select(F.posexplode(F.arrays_zip("k", "w")).alias("pos", "a")).select("pos", F.col("a.k").alias("keyword"), F.upper("a.w").alias("well")).filter(F.col("keyword").startswith("W") & F.col("well").rlike("^[A-Za-z0-9]"))
    values = read(spark, summary, "PARAMS").select(F.col("ordinal").alias("step"), F.posexplode("numbers").alias("pos", "value"))
    return values.join(addresses, "pos").select("step", "well", "keyword", "value")


def dimensions(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(nx, ny, nz) out of a grid file's header."""
    head = read(spark, path, "GRIDHEAD").filter("name = 'GRIDHEAD'").select(F.slice("numbers", 2, 3)).first()
    if head is None:
        raise ValueError(f"{path} has no GRIDHEAD")
    return tuple(int(v) for v in head[0])


def pillars(spark: SparkSession, path: str) -> DataFrame:
    """pi, pj and both ends (x0, y0, z0, x1, y1, z1) of the pillars of a grid file."""
    nx, _, _ = dimensions(spark, path)
    rows = read(spark, path, "COORD").select(F.posexplode("numbers").alias("pos", "v"))
    at = F.floor(F.col("pos") / 6)
    names = ("x0", "y0", "z0", "x1", "y1", "z1")
    wide = rows.groupBy((at % (nx + 1)).cast("int").alias("pi"), F.floor(at / (nx + 1)).cast("int").alias("pj"))
    return wide.agg(*[F.max(F.when(F.col("pos") % 6 == n, F.col("v"))).alias(c) for n, c in enumerate(names)])


def corner_depths(spark: SparkSession, path: str) -> DataFrame:
    """cell_id, i, j, k, slot and z of the corners of a grid file; of both corners on an axis the near one comes first."""
    nx, ny, _ = dimensions(spark, path)
    rows = read(spark, path, "ZCORN").select(F.posexplode("numbers").alias("pos", "z"))
    x, rest = F.col("pos") % (2 * nx), F.floor(F.col("pos") / (2 * nx))
    y, z = rest % (2 * ny), F.floor(rest / (2 * ny))
    half = lambda c: F.floor(c / 2).cast("int")
    cells = rows.select(half(x).alias("i"), half(y).alias("j"), half(z).alias("k"), (x % 2 + 2 * (y % 2) + 4 * (z % 2)).cast("int").alias("slot"), "z")
    return cells.select((F.col("i") + nx * (F.col("j") + ny * F.col("k"))).cast("long").alias("cell_id"), "i", "j", "k", "slot", "z")


def active_cells(spark: SparkSession, path: str) -> DataFrame:
    """cell_id and ``rank`` (from 0) of the active cells of a grid file; without ACTNUM all are."""
    nx, ny, nz = dimensions(spark, path)
    own = read(spark, path, "ACTNUM").filter("name = 'ACTNUM'")
    if own.isEmpty():
        return spark.range(nx * ny * nz).select(F.col("id").alias("cell_id"), F.col("id").alias("rank"))
    rows = own.select(F.posexplode("numbers").alias("cell_id", "v")).filter("v > 0").select(F.col("cell_id").cast("long").alias("cell_id"))
    return sorted_ids(rows, ["cell_id"], "rank")


def initial(spark: SparkSession, grid: str, path: str, attributes: tuple[str, ...] = ("PORO", "PERMX", "PERMY", "PERMZ", "NTG")) -> DataFrame:
    """cell_id and one column an attribute (null in inactive cells) out of an INIT file; arrays are of all or of the active cells."""
    nx, ny, nz = dimensions(spark, grid)
    n = nx * ny * nz
    rows = read(spark, path, ",".join(attributes)).filter(F.col("name").isin(*attributes))
    whole = rows.filter(F.size("numbers") == n).select("name", F.posexplode("numbers").alias("cell_id", "v")).select("name", F.col("cell_id").cast("long").alias("cell_id"), "v")
    part = rows.filter(F.size("numbers") < n).select("name", F.posexplode("numbers").alias("rank", "v")).withColumn("rank", F.col("rank").cast("long"))
    live = active_cells(spark, grid)
    inside = part.join(live, "rank").select("name", "cell_id", "v")
    cells = whole.join(live, "cell_id", "left_semi").unionByName(inside)
    return cells.groupBy("cell_id").pivot("name", list(attributes)).agg(F.first("v")).withColumnsRenamed({a: a.lower() for a in attributes})
