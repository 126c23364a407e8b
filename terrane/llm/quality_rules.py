"""Quality rules: a threshold table compiled into one projection of native expressions.

Every measure is a count of one text, so a rule ``low/per <= count/total <= high/per``
is compared in whole numbers and no document needs a shuffle. A null text counts as
an empty one; rows that repeat are judged alike; extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import SPACE_CHARS, bind, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Very common words of English, German, French and Spanish, as written within and at the start of a sentence.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "au ce dans de des du elle en est et il la le les ne pas pour que qui un une "
    "con de del el en es la las los no por que se su un una y"
).split()
STOP_WORDS = tuple(sorted({form for x in STOP_WORDS for form in (x, x.capitalize())}))


@dataclass(frozen=True)
class Rule:
    """``low * total <= per * count`` and ``per * count <= high * total``; None: no bound."""

    name: str
    count: str
    total: str
    per: int
    low: int | None = None
    high: int | None = None

    def ok(self, counts: Column) -> Column:
        scaled = counts[self.count] * self.per
        parts = []
        if self.low is not None:
            parts.append(scaled >= counts[self.total] * self.low)
        if self.high is not None:
            parts.append(scaled <= counts[self.total] * self.high)
        return parts[0] if len(parts) == 1 else parts[0] & parts[1]

    def sql(self) -> str:
        parts = [] if self.low is None else [f"{self.per} * {self.count} >= {self.low} * {self.total}"]
        parts += [] if self.high is None else [f"{self.per} * {self.count} <= {self.high} * {self.total}"]
        return "(" + " AND ".join(parts) + ")"


#: The production table: mean word length 2.5 to 12, at most 1 symbol in 10 words,
#: 1 stop word in 50 words at least, 2 of 5 lines repeated at most.
RULES = (
    Rule("word_length", "word_chars", "n_words", 10, 25, 120),
    Rule("symbols", "n_symbols", "n_words", 10, None, 1),
    Rule("stop_words", "n_stop_words", "n_words", 50, 1, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 5, None, 2),
)


def _window_hashes(words: Column) -> Column:
    """One 64-bit hash a 5-word window, built by doubling from hashes of single words."""
    rest = 1 << 30
    single = F.transform(words, lambda x: F.xxhash64(x))

    def from_words(one: Column) -> Column:
        two = F.zip_with(one, F.slice(one, 2, rest), lambda a, b: F.xxhash64(a, b))
        return bind(two, lambda p: bind(F.zip_with(p, F.slice(p, 3, rest), lambda a, b: F.xxhash64(a, b)), lambda q: F.zip_with(F.slice(q, 1, F.greatest(F.size(q) - 4, F.lit(0))), F.slice(one, 5, rest), lambda a, b: F.xxhash64(a, b))))

    return bind(single, from_words)


def _repeat_words(words: Column) -> Column:
    """Words inside any 5-word window that the text holds twice or more.

    Hashes only show that no window repeats; texts where one may are compared by the words themselves.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    grams = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("g"), i.alias("i"))))

    def covered(g: Column) -> Column:
        twice = F.filter(g, lambda x, k: ((k > 0) & (F.get(g, k - 1)["g"] == x["g"])) | F.coalesce(F.get(g, k + 1)["g"] == x["g"], F.lit(False)))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    return F.when(F.size(words) < WINDOW, 0).otherwise(bind(_window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bind(grams, covered))))


def counts_of(text: Column) -> Column:
    """Struct of all counts of a text (bigint)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(SPACE_CHARS)) != "")

    def measure(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    return bind(words_of(text), measure)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 10) -> DataFrame:
    """One row a document: its counts, ``base_failed``, the names of failed rules, ``kept``.

    ``base_failed``: under ``min_words`` words, or over 20 % of the words in repeated windows.
    """
    c = docs.select(F.col(id_col).alias(id_col), counts_of(F.col(text_col)).alias("__c")).select(id_col, F.col("__c"), F.col("__c.lines.n").alias("__n"), F.col("__c.lines.dup").alias("__d"))
    flat = c.select(id_col, "__c.n_words", "__c.word_chars", "__c.n_symbols", F.col("__d").alias("n_dup_lines"), "__c.n_repeat_words", "__c.n_stop_words", F.col("__n").alias("n_lines"))
    here = {k: F.col(k) for k in flat.columns}
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    failed = F.array_compact(F.array(*[F.when(~r.ok(here), F.lit(r.name)) for r in rules]))
    return flat.select("*", base.alias("base_failed"), failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 10) -> DataFrame:
    """The documents that pass, with the columns they came with; one pass, no join."""
    key = "__terrane_counts"
    c = docs.withColumn(key, counts_of(F.col(text_col)))
    inner = F.col(key)
    at = {k: inner[k] for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words")} | {"n_lines": inner["lines"]["n"], "n_dup_lines": inner["lines"]["dup"]}
    ok = (at["n_words"] >= min_words) & (at["n_repeat_words"] * 100 <= at["n_words"] * 20)
    for r in rules:
        ok = ok & r.ok(at)
    return c.filter(ok).drop(key)
