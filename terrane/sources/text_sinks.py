"""Deck text written back: arrays with repeat counts, function tables, dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.operators.windows import run_lengths
from terrane.sources.deck_source import SECTIONS

PER_LINE = 40


def array_text(df: DataFrame, by: Sequence[str], order: str, value: str, fmt: str = "%s") -> DataFrame:
    """by, line and text of arrays: runs over 4 as ``n*v``, PER_LINE items a line.

    Runs are found by a window over each array's key; an array is one attribute of one model.
    """
    runs = run_lengths(df, by, [order], value)
    shown = F.format_string(fmt, F.col(value)) if fmt != "%s" else F.col(value).cast("string")
    items = runs.withColumn("__i", F.when(F.col("n") > 4, F.array(F.concat(F.col("n").cast("string"), F.lit("*"), shown))).otherwise(F.array_repeat(shown, F.col("n").cast("int"))))
    each = items.select(*by, "run", F.posexplode("__i").alias("__p", "__t"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("run", "__p")) - 1
    lined = each.withColumn("line", F.floor(place / PER_LINE)).withColumn("__at", place)
    return lined.groupBy(*by, "line").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("__at", "__t"))), lambda x: x["__t"])).alias("text"))


def table_text(df: DataFrame, columns: Sequence[str], outer: str | None = None) -> DataFrame:
    """line and text of a function table; a repeated outer key is blank and a group ends with a slash."""
    w = Window.orderBy(*columns)  # a function table is small
    shown = [F.format_string("%.6f", F.col(c).cast("double")) for c in columns]
    end = F.lit("")
    if outer is not None:
        same = F.col(outer).eqNullSafe(F.lag(outer).over(w)) & (F.row_number().over(w) > 1)
        shown[list(columns).index(outer)] = F.when(same, F.lit("")).otherwise(shown[list(columns).index(outer)])
        end = F.when(~F.col(outer).eqNullSafe(F.lead(outer).over(w)) | F.lead(F.lit(1)).over(w).isNull(), " /").otherwise("")
    return df.select((F.row_number().over(w) - 1).alias("line"), F.concat(F.concat_ws(" ", *shown), end).alias("text"))


def date_text(ts: Column) -> Column:
    """A DATES record; July is JLY."""
    return F.concat(F.regexp_replace(F.upper(F.date_format(ts, "d MMM yyyy")), "JUL", "JLY"), F.lit(" /"))


def dump_arrays(df: DataFrame, path: str, attrs: Sequence[str], order: str, fmt: str = "%f") -> None:
    """Array keywords as text, a folder ``attr=NAME`` with one file for each: header, lines with repeat counts, a slash.

    Truth values are written as 0 and 1. A keyword's lines have one order, so one task writes
    them; the finding of runs before it is spread by attribute.
    """
    kinds = dict(df.dtypes)
    value = lambda a: (F.col(a).cast("int") if kinds[a] == "boolean" else F.col(a)).cast("double")
    each = F.explode(F.array(*[F.struct(F.lit(a.upper()).alias("attr"), value(a).alias("v")) for a in attrs]))
    long = df.select(order, each.alias("e")).select(order, "e.attr", "e.v")
    body = array_text(long, ["attr"], order, "v", fmt).select("attr", "line", "text")
    names = df.sparkSession.createDataFrame([(a.upper(),) for a in attrs], "attr string")
    edges = names.select("attr", F.lit(-1).cast("long").alias("line"), F.col("attr").alias("text")).unionByName(names.select("attr", F.lit((1 << 62)).alias("line"), F.lit("/").alias("text")))
    body.unionByName(edges).repartition("attr").sortWithinPartitions("attr", "line").select("attr", F.col("text").alias("value")).write.mode("overwrite").partitionBy("attr").text(path)


def dump_tables(tables: dict[str, DataFrame], root: str, only_active: str | None = None, single: bool = False) -> None:
    """A model's tables as Parquet, one folder each; ``only_active`` names the flag to filter by where a table has it, ``single`` halves doubles."""
    for name, df in tables.items():
        out = df.filter(F.col(only_active)) if only_active is not None and only_active in df.columns else df
        if single:
            out = out.withColumns({c: F.col(c).cast("float") for c, t in out.dtypes if t == "double"})
        out.write.mode("overwrite").parquet(f"{root}/{name}")


def load_tables(spark: SparkSession, root: str, names: Sequence[str], attrs: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Tables that ``dump_tables`` wrote; ``attrs`` are the columns to read where a table has them."""
    out = {n: spark.read.parquet(f"{root}/{n}") for n in names}
    return out if attrs is None else {n: df.select(*[c for c in df.columns if c in attrs]) for n, df in out.items()}


def main_deck(title: str, dims: Sequence[int], units: str, start: str, includes: dict[str, Sequence[str]]) -> str:
    """The text of a deck that includes a model's parts by section, in the order of sections."""
    lines = ["RUNSPEC", "TITLE", title, "DIMENS", f"{' '.join(str(d) for d in dims)} /", units, "START", f"{start} /"]
    for section in SECTIONS[1:]:
        parts = includes.get(section, ())
        if parts or section in ("GRID", "PROPS", "SOLUTION", "SCHEDULE"):
            lines += [section, *[x for part in parts for x in ("INCLUDE", f"'{part}' /")]]
    return "\n".join([*lines, "END", ""])


def array_date_text(dates: DataFrame, ts: str) -> DataFrame:
    """line and text of an ARRAY DATE list, in order of time; a list of report dates is short."""
    w = Window.orderBy(ts)
    rows = dates.select(F.row_number().over(w).alias("line"), F.upper(F.date_format(ts, "dd MMM yyyy")).alias("text"))
    end = rows.agg((F.coalesce(F.max("line"), F.lit(0)) + 1).alias("line"))
    return dates.sparkSession.createDataFrame([(0, "ARRAY DATE")], "line int, text string").unionByName(rows).unionByName(end.select("line", F.lit("/").alias("text")))
