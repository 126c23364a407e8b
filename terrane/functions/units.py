"""Unit systems. All tables are kept in FIELD units; a column's unit is in its metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One metric unit in field units.
METRIC_TO_FIELD = {
    "pressure": 14.503774,
    "length": 3.28084,
    "liquid": 6.28981,
    "gas": 0.0353147,
    "density": 0.062428,
    "none": 1.0,
}
FIELD_UNITS = {"pressure": "psia", "length": "ft", "liquid": "stb", "gas": "Mscf", "density": "lb/ft3"}


def factor(quantity: str, system: str) -> float:
    """To field units; ratios are ``gas/liquid`` and the like. LAB isn't supported."""
    if system == "FIELD":
        return 1.0
    if system != "METRIC":
        raise ValueError(f"unit system {system} is not supported")
    top, _, bottom = quantity.partition("/")
    return METRIC_TO_FIELD[top] / (METRIC_TO_FIELD[bottom] if bottom else 1.0)


def to_field(df: DataFrame, quantities: dict[str, str], system: str) -> DataFrame:
    """The columns named, scaled, with their unit in the metadata."""
    out = df
    for c, q in quantities.items():
        out = out.withColumn(c, F.col(c) * factor(q, system)).withMetadata(c, {"unit": FIELD_UNITS.get(q, q)})
    return out


def rate_to_field(rate: Column, phase: Column, system: str) -> Column:
    """A surface rate whose quantity depends on its phase (2: gas)."""
    return rate * F.when(phase == 2, factor("gas", system)).otherwise(factor("liquid", system))


def detect_system(lines: DataFrame, text: str = "text", order: str = "line_no") -> DataFrame:
    """One row: METRIC, FIELD or LAB from the first line that is just that word; FIELD if there is none."""
    word = F.upper(F.trim(F.substring_index(F.col(text), "--", 1)))
    found = lines.filter(word.isin("METRIC", "FIELD", "LAB")).agg(F.min_by(word, order).alias("u"))
    return found.select(F.coalesce("u", F.lit("FIELD")).alias("unit_system"))
