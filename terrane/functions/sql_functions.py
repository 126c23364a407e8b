"""The engine's expressions as SQL functions, inlined by Catalyst: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name to parameters, result and body.
FUNCTIONS = {
    "clean_name": ("s STRING", "STRING", "upper(btrim(s, '\\'\" '))"),
    "well_index": (
        "cf DOUBLE, h DOUBLE, k11 DOUBLE, k22 DOUBLE, r_e DOUBLE, r_w DOUBLE, skin DOUBLE",
        "DOUBLE",
        "coalesce(CASE WHEN cf > 0 THEN cf / 0.001127D END, 2 * pi() * h * sqrt(k11 * k22) / (ln(r_e / coalesce(r_w, 0.5D)) + coalesce(skin, 0D)))",
    ),
    "anchored_sigmoid": ("y DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "low + (high - low) / (1 + exp(-y))"),
    "log_time": ("t DOUBLE, t0 DOUBLE, scale DOUBLE", "DOUBLE", "log1p((t - t0) / scale)"),
    "unlog_time": ("tau DOUBLE, t0 DOUBLE, scale DOUBLE", "DOUBLE", "t0 + scale * expm1(tau)"),
    "log_radius": ("distance DOUBLE, r_w DOUBLE", "DOUBLE", "ln(greatest(distance, r_w) / r_w)"),
    "cell_ordinal": ("i BIGINT, j BIGINT, k BIGINT, nx BIGINT, ny BIGINT", "BIGINT", "i + nx * (j + ny * k)"),
    "in_place": ("volume DOUBLE, poro DOUBLE, saturation DOUBLE, fvf DOUBLE", "DOUBLE", "volume / 5.614583D * poro * saturation / fvf"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Register all functions for the session; returns their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {kind} RETURN {body}")
    return [prefix + n for n in FUNCTIONS]
