"""Windowed operators within a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.operators.aggregates import with_totals
from terrane.plans.storage import written

#: Parts that one task sorts hold so many bytes of shuffle at most, whatever the table's size.
PART_BYTES = 16 << 20
ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def running_tops(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str, out: str = "top") -> DataFrame:
    """Sum of the sizes before each row: the top of a layer."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0.0)))


def run_lengths(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of equal values: (by, run, value, n), numbered from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    marked = df.withColumn("__new", F.when(first, 1).otherwise(new)).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "run").agg(F.min(value).alias(value), F.count(F.lit(1)).alias("n"))


def _written_parts(df: DataFrame) -> DataFrame:
    """``df`` written, its shuffles in partitions of PART_BYTES."""
    conf = df.sparkSession.conf
    before = conf.get(ADVISED)
    conf.set(ADVISED, f"{PART_BYTES}b")
    try:
        return written(df)
    finally:
        conf.set(ADVISED, before)


def sorted_ids(df: DataFrame, key: Sequence[str], out: str, order: Sequence[str] | None = None) -> DataFrame:
    """Distinct keys numbered from 0 in their order (``order``: columns to go by instead, of a table that is distinct already).

    A range sort spreads the keys evenly whatever their values; its parts are written, so that
    counts and numbers come from the same ones, and numbered side by side.
    """
    rows = df.select(*key).distinct() if order is None else df
    by = list(order or key)
    parts = _written_parts(rows.repartitionByRange(*by).withColumn("__b", F.spark_partition_id()))
    sizes = parts.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))  # a row a part
    offsets = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    w = Window.partitionBy("__b").orderBy(*by)
    return parts.join(F.broadcast(offsets), "__b").withColumn(out, F.col("__before") + F.row_number().over(w) - 1).drop("__b", "__before")


def nested_ids(df: DataFrame, key: Sequence[str], outs: Sequence[str], once: bool = False) -> DataFrame:
    """Rows with the numbers (``outs``) from 0 of their distinct first, first two, ... columns of ``key`` in order, nulls last.

    With ``once``, of rows with equal keys one is kept. Rows are sorted in parts by range and numbered there, and parts
    are shifted by what is before them: nothing is joined to the rows but a number a part. An outer key
    may go on from one part to the next.
    """
    by = [F.col(k).asc_nulls_last() for k in key]
    w = Window.partitionBy("__b")
    whole = F.struct(*key)
    rows = df.repartitionByRange(*by).withColumn("__b", F.spark_partition_id())
    rows = rows.withColumns({outs[-1]: F.dense_rank().over(w.orderBy(*by)), "__again": whole.eqNullSafe(F.lag(whole).over(w.orderBy(*by)))})
    for n, out in reversed(list(enumerate(outs[:-1], 1))):  # the longest order first: one sort serves all
        rows = rows.withColumn(out, F.dense_rank().over(w.orderBy(*by[:n])))
    parts = _written_parts((rows.filter("NOT __again") if once else rows).drop("__again"))

    ends = {out: F.struct(*[c for k in key[:n] for c in (F.isnull(k), F.col(k))]) for n, out in enumerate(outs, 1)}
    last = parts.groupBy("__b").agg(F.max(outs[-1]).alias("__last"))  # a row a part; of the rows, the first and the last of each go on
    edges = parts.join(F.broadcast(last), "__b").filter((F.col(outs[-1]) == 1) | (F.col(outs[-1]) == F.col("__last")))
    sizes = edges.groupBy("__b").agg(*[f(c).alias(f"__{f.__name__}_{out}") for out, c in ends.items() for f in (F.min, F.max)], *[F.max(out).alias(f"__n_{out}") for out in outs])
    o = Window.orderBy("__b")  # a row a part
    goes_on = lambda out: F.coalesce((F.col(f"__min_{out}") == F.lag(f"__max_{out}").over(o)).cast("int"), F.lit(0))
    sizes = sizes.withColumns({f"__on_{out}": goes_on(out) for out in outs})
    offsets = sizes.select("__b", *[(F.sum(F.col(f"__n_{out}") - F.col(f"__on_{out}")).over(o) - F.col(f"__n_{out}")).alias(f"__before_{out}") for out in outs])
    return parts.join(F.broadcast(offsets), "__b").withColumns({out: F.col(f"__before_{out}") + F.col(out) - 1 for out in outs}).select(*df.columns, *outs)


def running_counts(df: DataFrame, key: Sequence[str], count: str, out: str) -> DataFrame:
    """Rows with the sum of ``count`` up to and with them in the order of distinct ``key``, over the whole table: by range, in parts."""
    parts = _written_parts(df.repartitionByRange(*key).withColumn("__b", F.spark_partition_id()))
    sizes = parts.groupBy("__b").agg(F.sum(count).alias("__s"))  # a row a part
    offsets = sizes.select("__b", (F.sum("__s").over(Window.orderBy("__b")) - F.col("__s")).alias("__before"))
    w = Window.partitionBy("__b").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(F.broadcast(offsets), "__b").withColumn(out, F.col("__before") + F.sum(count).over(w)).drop("__b", "__before")


def first_appearance_ids(df: DataFrame, key: Sequence[str], position: Column, out: str = "vertex_id") -> DataFrame:
    """Distinct keys numbered from 0 by their first position."""
    firsts = df.groupBy(*key).agg(F.min(position).alias("first_pos"))
    return sorted_ids(firsts, key, out, ["first_pos", *key])


def softmax(df: DataFrame, by: Sequence[str], value: Column, out: str = "weight") -> DataFrame:
    """``exp(v - max) / sum`` within a key."""
    w = Window.partitionBy(*by)
    z = df.withColumn("__z", value).withColumn("__z", F.exp(F.col("__z") - F.max("__z").over(w)))
    return z.withColumn(out, F.col("__z") / F.sum("__z").over(w)).drop("__z")


def normalized(df: DataFrame, by: Sequence[str], value: Column, out: str = "share") -> DataFrame:
    """Partition of unity: each value over its key's sum."""
    return df.withColumn("__v", value).withColumn(out, F.col("__v") / F.sum("__v").over(Window.partitionBy(*by))).drop("__v")


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x - mean) / (std + 1e-8)`` with the population std."""
    t = with_totals(df, *[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return t.select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-8)).alias(c) for c in columns])


def retain_last(df: DataFrame, by: Sequence[str], order: Sequence[str], limits: dict[str, int], kind: str, default: int) -> DataFrame:
    """The last rows of each kind, up to the kind's limit."""
    n = F.lit(default)
    for k, v in limits.items():
        n = F.when(F.col(kind) == k, v).otherwise(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def path_difference(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str = "slope") -> DataFrame:
    """Central differences along a path, one-sided at its ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn(out, F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2))
