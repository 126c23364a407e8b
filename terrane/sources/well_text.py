"""Well tracks, event tables and history tables out of text lines, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.scalars import expand_repeats

#: What a defaulted item of a perforation is, the modes and the named values of a control line.
DEFAULTS = {"RAD": 0.1524, "DIAM": 0.3048, "SKIN": 0.0, "MULT": 1.0}
MODES = ("PROD", "INJE", "STOP")
VALUES = (
    "BHPT THPT DRAW ETAB OPT GPT WPT LPT VPT OIT GIT WIT HOIL HGAS HWAT HLIQ HBHP HTHP HWEF "
    "GOPT GGPT GWPT GLPT GGIT GWIT OIL GAS WAT LIQ BHP THP GOR OGR WCT WOR WGR DREF"
).split()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no and text of files, comments off, blank lines left out."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "text"))
    return text.withColumn("text", F.trim(F.substring_index("text", "--", 1))).filter("text <> ''")


def _in_order() -> Window:
    return Window.partitionBy("path").orderBy("line_no")


def tracks(text: DataFrame) -> DataFrame:
    """path, well, place, x, y, z and md: rows of numbers after a WELLTRACK line, up to a slash or the first line that isn't four numbers.

    A track that is named again goes on with its own rows apart (``track_no``).
    """
    head = F.upper("text").rlike(r"\bWELLTRACK\b")
    named = F.upper(F.btrim(F.trim(F.regexp_replace("text", r"(?i)\bWELLTRACK\b", "")), F.lit("'\" \t")))
    x = text.withColumn("__head", head).withColumn("track_no", F.count(F.when(F.col("__head"), 1)).over(_in_order().rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("path", "track_no").orderBy("line_no")
    x = x.withColumn("well", F.first(F.when(F.col("__head"), named), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))).filter("track_no > 0 AND NOT __head")
    items = F.split(F.trim(F.substring_index("text", "/", 1)), r"\s+")
    x = x.withColumn("__v", F.transform(F.slice(items, 1, 4), lambda t: t.try_cast("double")))
    bad = (F.size("__v") < 4) | F.exists("__v", lambda v: v.isNull())
    before, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    ended = F.coalesce(F.bool_or(F.col("text").contains("/")).over(before), F.lit(False)) | F.bool_or(bad).over(upto)
    rows = x.withColumn("__ended", ended).filter("NOT __ended").withColumn("place", F.row_number().over(own) - 1)
    return rows.select("path", "track_no", "well", "place", *[F.get("__v", n).alias(c) for n, c in enumerate(("x", "y", "z", "md"))])


def _table(text: DataFrame, ends: Sequence[str]) -> DataFrame:
    """Lines of a table with their tokens, up to its end."""
    over = F.col("text") == "/"
    for e in ends:
        over = over | F.upper("text").contains(e)
    past = F.bool_or(over).over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    kept = text.withColumn("__past", past).filter("NOT __past").drop("__past")
    raw = F.regexp_extract_all("text", F.lit(r"'[^']*'|\"[^\"]*\"|\S+"), F.lit(0))
    return kept.withColumn("__raw", raw).withColumn("__t", F.transform("__raw", lambda t: F.upper(t)))


def _well() -> Column:
    return F.btrim(F.get("__raw", 0), F.lit("'\""))


def day(text: Column) -> Column:
    """``DD.MM.YYYY``; what is none is null."""
    return F.try_to_timestamp(F.btrim(text, F.lit("'\"")), F.lit("dd.MM.yyyy")).cast("timestamp_ntz")


def perforations(text: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of an event table that perforate: well (``well:branch`` of a branch), date, the columns and ``close``.

    ``columns`` are the table's names after well and date. ``n*`` is n defaults, and items after it count on.
    """
    t = _table(text, ["ENDE"]).filter(F.upper("text").contains("PERF"))
    branch = F.get("__t", F.array_position("__t", "BRANCH").cast("int"))
    well = F.when(F.array_contains("__t", "BRANCH"), F.concat_ws(":", _well(), branch)).otherwise(_well())
    items = expand_repeats(F.slice("__t", 4, 1 << 20))
    value = lambda n, c: F.coalesce(F.get(items, n).try_cast("double"), F.lit(DEFAULTS.get(c.upper())).cast("double"))
    return t.select("path", "line_no", well.alias("well"), day(F.get("__raw", 1)).alias("date"), *[value(n, c).alias(c.lower()) for n, c in enumerate(columns)], F.array_contains(F.slice("__t", 4, 1 << 20), "CLOSE").alias("close"))


def control_events(text: DataFrame, values: Sequence[str] = VALUES) -> DataFrame:
    """The other rows of an event table: well, date, mode and the named values; squeezes are passed over, two modes are an error."""
    t = _table(text, ["ENDE"]).filter(~F.upper("text").contains("PERF") & ~F.upper("text").contains("SQUE"))
    modes = F.filter(F.slice("__t", 3, 1 << 20), lambda k: k.isin(*MODES))
    mode = F.when(F.size(modes) > 1, F.raise_error(F.concat(F.lit("several modes: "), F.col("text"))).cast("string")).otherwise(F.get(modes, 0))
    pairs = F.arrays_zip(F.slice("__t", 3, 1 << 20).alias("k"), F.slice("__t", 4, 1 << 20).alias("v"))
    t = t.withColumn("__p", pairs)
    last = lambda k: F.get(F.filter("__p", lambda p: p["k"] == k), F.greatest(F.size(F.filter("__p", lambda p: p["k"] == k)) - 1, F.lit(0)))["v"].try_cast("double")
    return t.select("path", "line_no", _well().alias("well"), day(F.get("__raw", 1)).alias("date"), mode.alias("mode"), *[last(k).alias(k.lower()) for k in values])


def history(text: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of a history table: well, date and the columns after them."""
    t = _table(text, ["ENDE", "ENDH"])
    return t.select("path", "line_no", _well().alias("well"), day(F.get("__raw", 1)).alias("date"), *[F.get("__t", n + 2).try_cast("double").alias(c.lower()) for n, c in enumerate(columns)])
