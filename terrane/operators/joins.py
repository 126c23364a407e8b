"""Range, nearest, ordered-multiset, prefix and signature joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.sampling import capped
from terrane.operators.aggregates import with_totals
from terrane.operators.windows import running_counts, sorted_ids
from terrane.plans.storage import memory_bytes, written

#: Lists that every row scans may take so many bytes.
ARRAY_BYTES = 64 << 10


def breakpoints(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the sorted breakpoints of a small function table as an array of (x, y)."""
    return table.agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("__t"))


def _segment(t: Column, q: Column, extrapolate: bool) -> Column:
    """Linear value at q: a binary choice isn't needed, tables are short and scanned in the row."""
    n = F.size(t)
    i = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(t, lambda p: p["x"] <= q))))
    a, b = F.get(t, i - 1), F.get(t, i)
    line = a["y"] + (b["y"] - a["y"]) * (q - a["x"]) / (b["x"] - a["x"])
    if extrapolate:
        return F.when(n == 1, F.get(t, F.lit(0))["y"]).otherwise(line)
    first, last = F.get(t, F.lit(0)), F.get(t, n - 1)
    return F.when((n == 1) | (q <= first["x"]), first["y"]).when(q >= last["x"], last["y"]).otherwise(line)


def interpolate(df: DataFrame, table: DataFrame, x: str, y: str, query: str, out: str, extrapolate: bool = False) -> DataFrame:
    """A function table at each row: held at its ends, or extended along its end segments. No shuffle of ``df``."""
    return df.crossJoin(F.broadcast(breakpoints(table, x, y))).withColumn(out, _segment(F.col("__t"), F.col(query).cast("double"), extrapolate)).drop("__t")


def interpolate_inverse(df: DataFrame, table: DataFrame, x: str, y: str, query: str, out: str) -> DataFrame:
    """1 / (linear interpolation of 1 / y), as for formation volume factors."""
    inv = table.withColumn("__inv", 1 / F.col(y))
    return interpolate(df, inv, x, "__inv", query, "__v").withColumn(out, 1 / F.col("__v")).drop("__v")


def layer_of(df: DataFrame, boundaries: DataFrame, boundary: str, depth: str, out: str = "layer", array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """Number of boundaries above each depth; null boundaries don't count.

    A list of up to ``array_bytes``, measured, travels as one array and is scanned in the row.
    Beyond, boundaries and depths are counted in one order, by ranges, and depths read their count.
    """
    own = boundaries.select(F.col(boundary).cast("double").alias("__v")).filter("__v IS NOT NULL")
    if memory_bytes(own) <= array_bytes:
        b = own.agg(F.collect_list("__v").alias("__b"))
        return df.crossJoin(F.broadcast(b)).withColumn(out, F.size(F.filter("__b", lambda x: x < F.col(depth)))).drop("__b")
    asked = df.select(F.col(depth).cast("double").alias("__v")).filter("__v IS NOT NULL").distinct().withColumn("__n", F.lit(0).cast("long"))
    counted = own.withColumn("__n", F.lit(1).cast("long")).unionByName(asked).groupBy("__v").agg(F.sum("__n").alias("__n"))
    above = running_counts(counted, ["__v"], "__n", "__end").select("__v", (F.col("__end") - F.col("__n")).cast("int").alias("__above"))
    return df.withColumn("__v", F.col(depth).cast("double")).join(above, "__v", "left").withColumn(out, F.coalesce("__above", F.lit(0))).drop("__v", "__above")


def nearest(df: DataFrame, references: DataFrame, id_col: str, columns: Sequence[str], out: str = "nearest_id", array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """Id of the nearest reference (ties: lowest id) and its ``distance``; null where there is none.

    References of up to ``array_bytes``, measured, travel as one array. Beyond, both sides meet in
    grid cells, whose width doubles for the rows that found none.
    """
    points = references.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    if memory_bytes(points) > array_bytes:
        return _nearest_by_grid(df, points, columns, out)
    refs = points.agg(F.sort_array(F.collect_list(F.struct("id", F.array(*columns).alias("p")))).alias("__refs"))
    here = F.array(*[F.col(c).cast("double") for c in columns])
    dist = F.transform("__refs", lambda r: F.struct(F.aggregate(F.zip_with(r["p"], here, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("d"), r["id"].alias("id")))
    return df.crossJoin(F.broadcast(refs)).withColumn("__m", F.array_min(dist)).withColumn(out, F.col("__m.id")).withColumn("distance", F.sqrt("__m.d")).drop("__m", "__refs")


def _nearest_by_grid(df: DataFrame, points: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Distinct places meet the references within one cell; a hit within its width is the nearest there is."""
    box = points.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in columns]).first()
    span = max(max(box[c] for c in columns), 1e-9)
    width = span / max(box["n"], 1) ** (1 / len(columns))
    left = written(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna().distinct())
    done = []
    for _ in range(256):
        if left.isEmpty():
            break
        places = left.withColumn("__key", F.struct(*columns))
        hit = written(nearest_in_grid(places, points, "id", columns, width, "__key", out).select(*[F.col(f"__key.{c}").alias(c) for c in columns], out, "distance"))
        done.append(hit)
        left = written(left.join(hit, list(columns), "left_anti"))
        width *= 2
    else:
        raise ValueError("a place is too far from all references")
    if not done:
        return df.withColumns({out: F.lit(None).cast(points.schema["id"].dataType), "distance": F.lit(None).cast("double")})
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    renamed = found.select(*[F.col(c).alias(f"__c_{c}") for c in columns], out, "distance")
    return df.join(renamed, [F.col(c).cast("double") == F.col(f"__c_{c}") for c in columns], "left").drop(*[f"__c_{c}" for c in columns])


def nearest_on_axis(df: DataFrame, references: DataFrame, id_col: str, column: str, ref_column: str, out: str = "nearest_id", buckets: int = 256) -> DataFrame:
    """Id of the nearest of any number of references along one axis (ties: lowest id); null where ``column`` is.

    Both sides meet in ranges of the axis: the nearest is the reference before or after a row,
    in its own range or at the edge of another. Ranges only spread the work.
    """
    ref = references.select(F.col(ref_column).cast("double").alias("__x"), F.col(id_col).alias("__id")).filter("__x IS NOT NULL AND __id IS NOT NULL")
    ref = ref.groupBy("__x").agg(F.min("__id").alias("__id")).select("__x", F.struct("__x", "__id").alias("__r"))
    rows = df.select(F.struct(*df.columns).alias("__l"), F.col(column).cast("double").alias("__x"))
    both = rows.unionByName(ref, allowMissingColumns=True)
    splits = both.agg(F.percentile_approx("__x", [i / buckets for i in range(1, buckets)], 10000).alias("__s"))
    place = F.size(F.filter(F.coalesce("__s", F.array().cast("array<double>")), lambda s: s <= F.col("__x")))
    edges = ref.crossJoin(F.broadcast(splits)).groupBy(place.alias("b")).agg(F.min("__r").alias("lo"), F.max("__r").alias("hi"))
    edges = edges.agg(F.collect_list(F.struct("b", "lo", "hi")).alias("__e"))  # one row of ``buckets`` entries at most
    both = both.crossJoin(F.broadcast(splits)).withColumn("__b", place).drop("__s")
    so_far = lambda order: F.last("__r", ignorenulls=True).over(Window.partitionBy("__b").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    near = both.withColumn("__before", so_far(F.asc("__x"))).withColumn("__after", so_far(F.desc("__x"))).filter("__l IS NOT NULL").crossJoin(F.broadcast(edges))
    before = F.coalesce("__before", F.array_max(F.transform(F.filter("__e", lambda e: e["b"] < F.col("__b")), lambda e: e["hi"])))
    after = F.coalesce("__after", F.array_min(F.transform(F.filter("__e", lambda e: e["b"] > F.col("__b")), lambda e: e["lo"])))
    two = F.filter(F.array(before, after), lambda r: r.isNotNull())
    dist = F.transform(two, lambda r: F.struct(((r["__x"] - F.col("__x")) * (r["__x"] - F.col("__x"))).alias("d"), r["__id"].alias("id")))
    near = near.withColumn("__m", F.when(F.col("__x").isNotNull(), F.array_min(dist)))
    return near.select("__l.*", F.col("__m.id").alias(out), F.sqrt("__m.d").alias("distance"))


def nearest_in_grid(df: DataFrame, references: DataFrame, id_col: str, columns: Sequence[str], cell: float, key: str, out: str = "nearest_id") -> DataFrame:
    """Nearest reference within ``cell`` of each row, for many references: both sides meet by grid cell and its neighbours."""
    ref = references.select(F.col(id_col).alias("__rid"), *[F.col(c).alias(f"__r_{c}") for c in columns])
    spread = ref
    for c in columns:
        spread = spread.withColumn(f"__g_{c}", F.explode(F.array(*[F.floor(F.col(f"__r_{c}") / cell) + d for d in (-1, 0, 1)])))
    gridded = df.select("*", *[F.floor(F.col(c) / cell).alias(f"__g_{c}") for c in columns])
    d2 = sum(((F.col(c) - F.col(f"__r_{c}")) * (F.col(c) - F.col(f"__r_{c}")) for c in columns), F.lit(0.0))
    near = gridded.join(spread, [f"__g_{c}" for c in columns]).withColumn("__d", d2).filter(F.col("__d") <= cell * cell)
    return near.groupBy(key).agg(F.min(F.struct("__d", "__rid")).alias("m")).select(key, F.col("m.__rid").alias(out), F.sqrt("m.__d").alias("distance"))


def match_multiset(left: DataFrame, right: DataFrame, key: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], value: str, out: str = "matched") -> DataFrame:
    """The k-th left row of a key with the k-th right row of it."""
    number = lambda df, order: df.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    r = number(right, right_order).select(*key, "__k", F.col(value).alias(out))
    return number(left, left_order).join(r, [*key, "__k"], "left").withColumnRenamed("__k", "k")


def match_or_default(left: DataFrame, right: DataFrame, group: Sequence[str], key: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], values: dict[str, object]) -> DataFrame:
    """Left rows with the ``values`` of the k-th right row of their key; a group with a row that matches none has the defaults in all its rows.

    ``values`` maps right columns to their defaults; ``complete`` tells which groups matched.
    """
    both = [*group, *key]
    number = lambda df, order: df.withColumn("__k", F.row_number().over(Window.partitionBy(*both).orderBy(*order)))
    r = number(right, right_order).select(*both, "__k", *values, F.lit(True).alias("__hit"))
    j = number(left, left_order).join(r, [*both, "__k"], "left")
    found = j.groupBy(*group).agg(F.bool_and(F.coalesce("__hit", F.lit(False))).alias("complete"))
    out = j.join(found, list(group))
    return out.withColumns({c: F.when(F.col("complete"), F.col(c)).otherwise(F.lit(v)) for c, v in values.items()}).drop("__k", "__hit")


def prefix_join(names: DataFrame, patterns: DataFrame, name: str, pattern: str, least: int) -> DataFrame:
    """Rows whose name starts with a pattern (a ``*`` at its end is dropped); patterns have ``least`` characters or more.

    Names meet patterns by their first ``least`` characters, so it is an equi-join at any size.
    """
    p = patterns.withColumn("__p", F.regexp_replace(pattern, r"\*$", "")).withColumn("__h", F.substring("__p", 1, least))
    n = names.withColumn("__h", F.substring(name, 1, least))
    return n.join(p, "__h").filter(F.col(name).startswith(F.col("__p"))).drop("__h", "__p")


def signature_diff(old: DataFrame, new: DataFrame, key: str, signature: str) -> DataFrame:
    """Keys whose signature changed, appeared or vanished."""
    a, b = old.select(F.col(key), F.col(signature).alias("__a")), new.select(F.col(key), F.col(signature).alias("__b"))
    j = a.join(b, key, "full_outer")
    why = F.when(F.col("__a").isNull(), "appeared").when(F.col("__b").isNull(), "vanished").when(F.col("__a") != F.col("__b"), "changed")
    return j.select(key, why.alias("reason")).filter("reason IS NOT NULL")


def even_subset(df: DataFrame, step: str, n: int) -> DataFrame:
    """Rows at ``n`` evenly spaced distinct steps, first and last included (halves round to even); steps are numbered by ranges."""
    steps = sorted_ids(df.select(step).filter(F.col(step).isNotNull()), [step], "__n")
    chosen = capped(steps, "__n", steps.count(), n).select(step)  # ``n`` rows
    return df.join(F.broadcast(chosen), step, "left_semi")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("F", "Window", "Column", "DataFrame", "Sequence", "annotations", "with_totals")]
