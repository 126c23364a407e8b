"""Loaders over deck records: arrays, function tables, keyword rows, the schedule clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.operators.temporal import running_clock
from terrane.plans.shipping import ship
from terrane.sources.deck_source import DeckSource

#: Columns of the keywords, in the order of a record; d: number, i: whole number, s: text.
KEYWORDS = {
    "WELSPECS": "well:s group:s i:i j:i dref:d phase:s",
    "WELSPECL": "well:s group:s lgr:s i:i j:i dref:d phase:s",
    "COMPDAT": "well:s i:i j:i k1:i k2:i status:s sat:i cf:d diam:d kh:d skin:d dfac:d dir:s ro:d",
    "COMPDATL": "well:s lgr:s i:i j:i k1:i k2:i status:s sat:i cf:d diam:d kh:d skin:d dfac:d dir:s ro:d",
    "WCONPROD": "well:s mode:s control:s orat:d wrat:d grat:d lrat:d resv:d bhpt:d thpt:d",
    "WCONINJE": "well:s phase:s mode:s control:s rate:d resv:d bhpt:d thpt:d",
    "WCONHIST": "well:s mode:s control:s orat:d wrat:d grat:d vfp:i alq:d thpt:d bhpt:d",
    "WELOPEN": "well:s mode:s",
    "WEFAC": "well:s factor:d",
    "FAULTS": "name:s i1:i i2:i j1:i j2:i k1:i k2:i face:s",
    "MULTFLT": "name:s mult:d",
    "GRUPTREE": "node:s parent:s",
    "AQUANCON": "aquifer:i i1:i i2:i j1:i j2:i k1:i k2:i face:s",
    "AQUCT": "aquifer:i datum:d pressure:d perm:d poro:d compr:d radius:d thickness:d angle:d",
    "EQUALS": "target:s value:d i1:i i2:i j1:i j2:i k1:i k2:i",
    "MULTIPLY": "target:s value:d i1:i i2:i j1:i j2:i k1:i k2:i",
    "ADD": "target:s value:d i1:i i2:i j1:i j2:i k1:i k2:i",
    "COPY": "source:s target:s i1:i i2:i j1:i j2:i k1:i k2:i",
    "COMPDATMD": "well:s branch:i mdu:d mdl:d md_tvd:s status:s sat:d cf:d diam:d kh:d skin:d nd:d mult:d type:s",
    "WFRAC": "well:s i1:i j1:i k1:i i2:i j2:i k2:i azimuth:d zenith:d half_length:d width:d proppant:s flow:s phase:s",
    "WFRACP": "well:s i1:i j1:i k1:i i2:i j2:i k2:i azimuth:d zenith:d l1:d l2:d h1:d h2:d width:d proppant:s flow:s phase:s",
    "AQCO": "kind:s aquifer:i i1:i i2:i j1:i j2:i k1:i k2:i face:s",
    "AQCT": "kind:s aquifer:i datum:d perm:d poro:d compr:d radius:d angle:d thickness:d pressure:d viscosity:d equilibrium:s",
    "RESTART": "name:s step:i",
    "RESTARTDATE": "name:s step:i day:i month:s year:i",
}
#: Columns of the function tables; the first is the domain.
TABLES = {
    "SWOF": ("sw", "krw", "krow", "pcow"),
    "SGOF": ("sg", "krg", "krog", "pcgo"),
    "PVDG": ("p", "fvf", "visc"),
    "PVDO": ("p", "fvf", "visc"),
    "PVTW": ("p", "fvf", "compr", "visc", "viscosibility"),
    "PVCDO": ("p", "fvf", "compr", "visc", "viscosibility"),
    "ROCK": ("p", "compr"),
    "DENSITY": ("oil", "water", "gas"),
    "RSVD": ("depth", "rs"),
}
#: What a default of a table's column is, in METRIC and in FIELD; pressures and what is per pressure by 14.6959.
DEFAULTS = {
    "PVTW": {"p": (1.0, 14.6959), "fvf": (1.0, 1.0), "compr": (4e-5, 4e-5 / 14.6959), "visc": (0.3, 0.3), "viscosibility": (0.0, 0.0)},
    "PVCDO": {"viscosibility": (0.0, 0.0)},
    "SWOF": {"pcow": (0.0, 0.0)},
    "SGOF": {"pcgo": (0.0, 0.0)},
    "ROCK": {"p": (1.0132, 1.0132 * 14.6959), "compr": (4.934e-5, 4.934e-5 / 14.6959)},
    "DENSITY": {"oil": (600.0, 37.457), "water": (999.014, 62.366), "gas": (1.0, 0.062428)},
}
CLOSED = ("SHUT", "STOP", "CLOSED", "CLOSE")


def read(spark: SparkSession, path: str, missing: str = "error") -> DataFrame:
    """Deck records: path, seq, section, keyword, record_no, line_no, tokens."""
    ship(spark)
    spark.dataSource.register(DeckSource)
    return spark.read.format("deck").option("path", path).option("missing", missing).load()


def array(records: DataFrame, keyword: str) -> DataFrame:
    """path, pos (0-based, in deck order) and value of an array keyword."""
    return records.filter((F.col("keyword") == keyword) & (F.col("record_no") == 0)).select("path", F.posexplode("tokens").alias("pos", "t")).select("path", "pos", F.col("t").try_cast("double").alias("value"))


def keyword_rows(records: DataFrame, keyword: str, columns: str | None = None) -> DataFrame:
    """Records of a keyword as typed columns; defaults are null. Names are upper-cased."""
    kinds = {"s": lambda c: F.upper(c), "d": lambda c: F.regexp_replace(c, "[dD]", "E").try_cast("double"), "i": lambda c: c.try_cast("double").cast("int")}
    spec = [x.split(":") for x in (columns or KEYWORDS[keyword]).split()]
    rows = records.filter((F.col("keyword") == keyword) & (F.col("record_no") >= 0))
    return rows.select("path", "seq", *[kinds[k](F.get("tokens", n)).alias(name) for n, (name, k) in enumerate(spec)])


def function_table(records: DataFrame, keyword: str, region: int = 1, units: str | None = None) -> DataFrame:
    """Rows of one region of a function table; a default, or what is no number, is null.

    With ``units`` (METRIC or another) the defaults of DEFAULTS are filled in; a record that is too short has them too.
    """
    names = TABLES[keyword]
    own = records.filter((F.col("keyword") == keyword) & (F.col("record_no") == region - 1))
    flat = own.select("path", F.posexplode("tokens").alias("p", "t")).select("path", F.floor(F.col("p") / len(names)).alias("row"), (F.col("p") % len(names)).alias("c"), F.col("t").try_cast("double").alias("v"))
    out = flat.groupBy("path", "row").agg(*[F.max(F.when(F.col("c") == n, F.col("v"))).alias(name) for n, name in enumerate(names)]).drop("row")
    if units is None:
        return out
    return out.withColumns({c: F.coalesce(c, F.lit(v[0 if units == "METRIC" else 1])) for c, v in DEFAULTS.get(keyword, {}).items()})


def live_oil(records: DataFrame, keyword: str = "PVTO") -> DataFrame:
    """Groups of PVTO (rs, p, fvf, visc) or PVTG (p, rv, fvf, visc), and whether the row is the saturated one, its group's first."""
    outer, inner = ("p", "rv") if keyword == "PVTG" else ("rs", "p")
    own = records.filter((F.col("keyword") == keyword) & (F.col("record_no") >= 0))
    rest = F.slice("tokens", 2, 1 << 20)
    rows = own.select("path", "record_no", F.get("tokens", 0).try_cast("double").alias(outer), F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size(rest) / 3).cast("int") - 1), lambda n: F.slice(rest, n * 3 + 1, 3))).alias("n", "r"))
    return rows.select("path", outer, *[F.get("r", k).try_cast("double").alias(c) for k, c in enumerate((inner, "fvf", "visc"))], (F.col("n") == 0).alias("saturated"))


def dry_gas(wet: DataFrame) -> DataFrame:
    """PVTG rows as a PVDG table: of each pressure the row that holds the most oil."""
    return wet.groupBy("path", "p").agg(F.max_by(F.struct("fvf", "visc"), "rv").alias("r")).select("path", "p", "r.fvf", "r.visc")


def eclipse_date(tokens: Column) -> Column:
    """``6 NOV 1997`` (JLY is July); what doesn't parse is null."""
    month = F.regexp_replace(F.initcap(F.get(tokens, 1)), "^Jly$", "Jul")
    return F.try_to_timestamp(F.concat_ws(" ", F.get(tokens, 0), month, F.get(tokens, 2)), F.lit("d MMM yyyy")).cast("timestamp_ntz")


def clocked(records: DataFrame) -> DataFrame:
    """Schedule records with the clock they are read at: START, then DATES sets it and TSTEP adds days."""
    t = F.col("tokens")
    start = F.when((F.col("keyword") == "START") & (F.col("record_no") == 0), eclipse_date(t))
    dates = F.when((F.col("keyword") == "DATES") & (F.col("record_no") >= 0), eclipse_date(t))
    day = 86400.0
    reset = F.coalesce(start, dates)
    step = F.when((F.col("keyword") == "TSTEP") & (F.col("record_no") == 0), F.aggregate(F.transform("tokens", lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x) * day)
    out = running_clock(records, ["path"], ["seq"], F.unix_seconds(reset.cast("timestamp")).cast("double"), step)
    return out.withColumn("ts", F.timestamp_micros((F.col("clock") * 1e6).cast("long")).cast("timestamp_ntz")).drop("clock")


def controls(records: DataFrame) -> DataFrame:
    """Schedule control rows of all sources with their time: well, ts, seq, source, mode, control, phase, rate, bhpt."""
    rows = clocked(records).filter("section = 'SCHEDULE' AND record_no >= 0")
    out = None
    nothing = F.lit(None)
    for source in ("WCONPROD", "WCONINJE", "WCONHIST", "WELOPEN"):
        spec = dict(x.split(":") for x in KEYWORDS[source].split())
        typed = keyword_rows(rows, source).join(rows.filter(F.col("keyword") == source).select("path", "seq", "ts"), ["path", "seq"])
        has = lambda c, kind, spec=spec: F.col(c) if c in spec else nothing.cast(kind)
        targets = F.coalesce(*[F.when(F.col("control") == k.upper(), F.col(k)) for k in ("orat", "wrat", "grat", "lrat", "resv") if k in spec], *([F.col("rate")] if "rate" in spec else [])) if "control" in spec else nothing.cast("double")
        head = has("bhpt", "double")
        if source == "WCONHIST":  # its targets are the three rates; which one counts goes by the control
            three = [F.col(c) for c in ("orat", "wrat", "grat")]
            kind = F.col("control")
            targets = F.when(kind == "ORAT", three[0]).when(kind == "WRAT", three[1]).when(kind == "GRAT", three[2]).when(kind.isin("LRAT", "RESV", "RATE"), F.coalesce(*three))
            targets = -F.abs(targets)
            head = F.when(kind.isin("BHP", "BHPT", "THP", "THPT"), F.coalesce(*three, "bhpt")).otherwise(head)
        one = typed.select("path", "well", "ts", "seq", F.lit(source).alias("source"), has("mode", "string").alias("mode"), has("control", "string").alias("control"), has("phase", "string").alias("phase"), targets.alias("rate"), head.alias("bhpt"))
        out = one if out is None else out.unionByName(one)
    return out


def completions(records: DataFrame) -> DataFrame:
    """COMPDAT rows a layer, I and J from WELSPECS where defaulted: well, ts, seq, i, j, k, status, cf, diam, skin."""
    rows = clocked(records)
    typed = keyword_rows(rows, "COMPDAT").join(rows.filter("keyword = 'COMPDAT' AND record_no >= 0").select("path", "seq", "ts"), ["path", "seq"])
    heads = keyword_rows(records, "WELSPECS").groupBy("path", "well").agg(F.max_by(F.struct("i", "j"), "seq").alias("h"))
    j = typed.join(heads, ["path", "well"], "left")
    place = lambda c: F.coalesce(F.when(F.col(c) > 0, F.col(c)), F.col(f"h.{c}"))
    layer = F.explode(F.sequence(F.least("k1", "k2"), F.greatest("k1", "k2")))
    return j.filter("k1 IS NOT NULL AND k2 IS NOT NULL").select("path", "well", "ts", "seq", place("i").alias("i"), place("j").alias("j"), layer.alias("k"), F.coalesce("status", F.lit("OPEN")).alias("status"), "cf", F.coalesce("diam", F.lit(1.0)).alias("diam"), F.coalesce("skin", F.lit(0.0)).alias("skin"))


def open_blocks(completed: DataFrame, ts: Column) -> DataFrame:
    """The latest row of each (well, i, j, k) at a time, without those shut."""
    w = Window.partitionBy("path", "well", "i", "j", "k").orderBy(F.desc("ts"), F.desc("seq"))
    return completed.filter(F.col("ts").isNull() | (F.col("ts") <= ts)).withColumn("__r", F.row_number().over(w)).filter((F.col("__r") == 1) & ~F.col("status").isin(*CLOSED)).drop("__r")


def output_dates(records: DataFrame) -> DataFrame:
    """path, place and ts of an ARRAY DATE list; arrays of another kind are passed over."""
    own = records.filter((F.col("keyword") == "ARRAY") & (F.col("record_no") == 0) & (F.upper(F.get("tokens", 0)) == "DATE"))
    n = F.floor((F.size("tokens") - 1) / 3).cast("int")
    groups = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice("tokens", k * 3 + 2, 3))
    rows = own.filter(n > 0).select("path", F.posexplode(groups).alias("place", "t"))
    return rows.select("path", "place", eclipse_date(F.col("t")).alias("ts"))


def unit_system(records: DataFrame) -> DataFrame:
    """path and METRIC, FIELD or LAB: the first bare keyword of the three, else FIELD."""
    found = records.groupBy("path").agg(F.min_by(F.when(F.col("keyword").isin("METRIC", "FIELD", "LAB"), F.col("keyword")), F.when(F.col("keyword").isin("METRIC", "FIELD", "LAB"), F.col("seq"))).alias("u"))
    return found.select("path", F.coalesce("u", F.lit("FIELD")).alias("unit_system"))


def oil_model(records: DataFrame) -> DataFrame:
    """path and stone1, stone2 or default: STONE and STONE1 go before STONE2."""
    has = lambda *k: F.bool_or(F.col("keyword").isin(*k))
    return records.groupBy("path").agg(F.when(has("STONE", "STONE1"), "stone1").when(has("STONE2"), "stone2").otherwise("default").alias("oil_model"))


def deck_kind(records: DataFrame) -> DataFrame:
    """path and standard, restart or fragment."""
    has = lambda k: F.bool_or(F.col("keyword") == k)
    return records.groupBy("path").agg(F.when(has("RESTART"), "restart").when(has("RUNSPEC") | has("DIMENS"), "standard").otherwise("fragment").alias("kind"))


def tree_parents(records: DataFrame) -> DataFrame:
    """Node and parent, the last statement of each node winning: GRUPTREE for groups, WELSPECS for wells."""
    g = keyword_rows(records, "GRUPTREE").select("path", "seq", "node", "parent")
    w = keyword_rows(records, "WELSPECS").select("path", "seq", F.col("well").alias("node"), F.col("group").alias("parent"))
    return g.unionByName(w).groupBy("path", "node").agg(F.max_by("parent", "seq").alias("parent"))


def wells_matching(names: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose well is a pattern like ``P*``, once for each well with that prefix; patterns are few and broadcast if small."""
    pattern = rows.filter(F.col("well").endswith("*"))
    plain = rows.filter(~F.col("well").endswith("*"))
    hit = pattern.join(names.select("path", F.col("well").alias("__w")), "path").filter(F.col("__w").startswith(F.expr("substring(well, 1, length(well) - 1)")))
    return plain.unionByName(hit.withColumn("well", F.col("__w")).select(*rows.columns))
