"""Line dedup: an exact set-similarity join of all lines, in native expressions only.

A line's set is its distinct words. A line goes if an earlier line (by document id, then
place) has a set with a Jaccard similarity of 0.8 or more, whether or not that line stays.

1. Words, known by hashes, are counted in a table of 2^16 hash buckets, which gives their
   order of rarity. The table only orders: any total order gives the same result.
2. Lines with equal sets form a class by its size, a 64-bit digest and a parity of 64 bits, 128 for more than 64 words; its first line stands
   for it, so a line that fills a third of the corpus is one row from there on.
3. Each set's prefix - the rarest words of which a similar set must hold one - is joined
   by word, in a semi join that keeps a row once it finds one candidate: lengths, the
   places of the word, and the parity of the words bound the overlap. However many
   lines are alike, each makes one row a prefix word at most.
4. Candidates, by then few, are verified on their full sets, again in semi joins with the
   earlier ones: first at each set's rarest word, then for sets still open at the others.

Sets of up to three words are similar to their equals only, so their classes are the answer
and they have no prefix rows. Every line that has a word takes part. Null and blank texts
have no lines; null ids are left as they are. Rows with one id are one document: equal
lines at one place of both are one line, other lines at one place don't match each other, and a
place that goes goes from all of them. Ids are integers.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import SPACE_CHARS
from terrane.plans.storage import discard, sized, written

BUCKETS = 1 << 16
#: Sets of more words have a parity of 128 bits; of up to so many, 64 tell as much and cost half.
NARROW = 64
KEY = ["doc", "line", "n", "s0", "s1"]
CLASS = ["h1", "n", "s0", "s1"]


def _split(text: Column) -> Column:
    """Words of a text, with an empty one where blanks stand side by side or at an end.

    One blank as the separator is split without a regular expression; a search for the rare ones is cheaper than replacing them.
    """
    rare = SPACE_CHARS.replace(" ", "").replace("\n", "")
    blank = lambda t, chars: reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), chars, t)
    return F.split(F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in rare]), blank(text, rare)).otherwise(text), " ")


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BUCKETS - 1))


def rarity(docs: DataFrame, text_col: str) -> bytes:
    """For each bucket a class that grows with its words' count, 4 classes a doubling."""
    words = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("t")).select(F.explode(_split(F.col("t"))).alias("w"))
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).count()
    table = counts.select("b", F.least(F.ceil(F.log2("count") * 4) + 1, F.lit(126)).cast("int").alias("c")).toPandas()  # BUCKETS rows at most
    classes = np.ones(BUCKETS + 1, np.uint8)
    classes[table["b"].to_numpy()] = table["c"].to_numpy()
    classes[1] = max(classes[:2])  # a substring from 0 is one from 1: buckets 0 and 1 share a class
    return classes[1:].tobytes()


def _rank(hashed: Column, classes: bytes) -> Column:
    """One number by which words are ordered and known: the bucket's class in the top byte, the hash below."""
    own = F.ascii(F.substring(F.lit(classes), _bucket(hashed).cast("int"), F.lit(1)).cast("string")).cast("long")
    return F.call_function("shiftleft", own, F.lit(56)).bitwiseOR(F.call_function("shiftrightunsigned", hashed, F.lit(8)))


def lines_of(docs: DataFrame, id_col: str, text_col: str, only: DataFrame | None = None) -> DataFrame:
    """doc, line, t of each line that isn't empty, or of those in ``only``; the sets of blank ones are empty (n = 0)."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "t"))
    rows = rows.filter("t <> ''")
    return rows if only is None else rows.join(only, ["doc", "line"], "left_semi")


def sketched(lines: DataFrame, classes: bytes) -> DataFrame:
    """doc, line, n, h1 (digest), s0, s1 (parity of the words), r (ranks of the distinct words, rarest first) of each line."""
    none = _rank(F.xxhash64(F.lit("")), classes)
    ranks = F.transform(F.transform(_split(F.col("t")), lambda w: F.xxhash64(w)), lambda h: _rank(h, classes))
    rows = lines.select("doc", "line", F.sort_array(F.array_remove(F.array_distinct(ranks), none)).alias("r"))
    shift = lambda name, x, n: F.call_function(name, x, n)
    one = lambda x, by: shift("shiftleft", by, x.bitwiseAND(F.lit(63)).cast("int"))
    zero, unit = F.lit(0).cast("long"), F.lit(1).cast("long")
    fold = lambda merge: F.aggregate("r", zero, merge)
    all_ = fold(lambda a, x: a.bitwiseXOR(one(x, unit)))
    high = F.when(F.size("r") > NARROW, fold(lambda a, x: F.when(x.bitwiseAND(F.lit(64)) == 0, a).otherwise(a.bitwiseXOR(one(x, unit))))).otherwise(zero)
    rows = rows.select("doc", "line", F.size("r").alias("n"), F.xxhash64("r").alias("h1"), all_.alias("s"), high.alias("s1"), "r")
    return rows.select("doc", "line", "n", "h1", F.col("s").bitwiseXOR(F.col("s1")).alias("s0"), "s1", "r")


def prefix_rows(sets: DataFrame) -> DataFrame:
    """One row a set and prefix word: the set's KEY, the word, and ``most``, the size of the largest set alike if the word is the first in common.

    From place i on (from 0) both sets must hold 4/9 of the sum of their sizes, so the
    other's size is 5/4 n - 9/4 i at most; at i = 0 that is the bound of lengths.
    """
    rows = sets.select(*KEY, F.posexplode("prefix").alias("i", "word"))
    return rows.select(*KEY, F.expr("(5 * n - 9 * i) div 4").cast("int").alias("most"), "word")


def _of(k: str, x: str) -> Column:
    return F.col(f"{x}.{k}")


def _earlier(b: str, a: str) -> Column:
    return (_of("doc", b) < _of("doc", a)) | ((_of("doc", b) == _of("doc", a)) & (_of("line", b) < _of("line", a)))


def _candidate(a: str, b: str) -> Column:
    """Whether lengths, places and parity allow two sets at one word a similarity of 4/5."""
    s0, s1 = (_of(k, a).bitwiseXOR(_of(k, b)) for k in ("s0", "s1"))
    # s0 xor s1 is the 64-bit parity of a set, whatever its size
    differ = F.when((_of("n", a) > NARROW) & (_of("n", b) > NARROW), F.bit_count(s0) + F.bit_count(s1)).otherwise(F.bit_count(s0.bitwiseXOR(s1)))
    return (_of("n", b) <= _of("most", a)) & (_of("n", a) <= _of("most", b)) & (differ * 9 <= _of("n", a) + _of("n", b))


def _verified(chosen: DataFrame, rows: DataFrame, full: DataFrame) -> DataFrame:
    """KEY of the sets in ``chosen`` (prefix rows) that an earlier set of ``rows`` at the same word is similar to."""
    same_word = F.col("a.word") == F.col("b.word")
    others = rows.alias("b").join(chosen.alias("a"), same_word & _candidate("a", "b") & _earlier("b", "a"), "left_semi")
    a, b = chosen.join(full, KEY).alias("a"), others.join(full, KEY).alias("b")
    same = F.size(F.array_intersect(F.col("a.r"), F.col("b.r"))) * 9 >= (F.col("a.n") + F.col("b.n")) * 4
    return written(a.join(b, same_word & _candidate("a", "b") & _earlier("b", "a") & same, "left_semi").select(*KEY).distinct())


def late_sets(docs: DataFrame, sets: DataFrame, classes: bytes, id_col: str, text_col: str) -> DataFrame:
    """KEY of the sets that an earlier set is similar to."""
    rows = prefix_rows(sets)
    same_word = F.col("a.word") == F.col("b.word")
    other = (_of("doc", "a") != _of("doc", "b")) | (_of("line", "a") != _of("line", "b"))
    live = written(rows.alias("a").join(rows.alias("b"), same_word & _candidate("a", "b") & other, "left_semi"))

    ids = written(live.select("doc", "line").distinct())
    some = docs.join(sized(written(ids.select(F.col("doc").alias("__doc")).distinct())), F.col(id_col) == F.col("__doc"), "left_semi")
    # two sets at one place may have one KEY; and whole rows are hashed, where a first array of each KEY would be sorted for
    full = written(sketched(lines_of(some, id_col, text_col, sized(ids)), classes).select(*KEY, "r").distinct())

    open_ = written(live.alias("a").join(live.alias("b"), same_word & _candidate("a", "b") & _earlier("b", "a"), "left_semi"))
    first = written(open_.groupBy(*KEY).agg(F.max("most").alias("most"), F.max_by("word", "most").alias("word")))
    late = _verified(first, live, full)
    rest = written(open_.join(sized(late), KEY, "left_anti"))
    more = _verified(rest, live, full)
    out = written(late.unionByName(more))
    discard(live, ids, full, open_, first, late, rest, more)
    return out


def later_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc and its lines that go (sorted array of places from 0), for documents that lose any; a written table."""
    docs = docs.select(id_col, text_col)
    classes = rarity(docs, text_col)
    prefix = F.when(F.col("n") > 3, F.slice("r", F.lit(1), F.col("n") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1)).alias("prefix")
    lines = written(sketched(lines_of(docs, id_col, text_col), classes).select(*KEY, "h1", prefix))

    # a line's place is one number, so that lines of a class combine in a hash table
    two32 = F.lit(1 << 32).cast("decimal(10,0)")
    place = F.col("doc").cast("decimal(20,0)") * two32 + F.col("line").cast("decimal(10,0)")
    sets = lines.filter("n > 0").groupBy(*CLASS).agg(F.min(place).alias("f"), F.count("*").alias("m")).filter("m > 1")
    sets = sets.withColumn("f_line", F.pmod("f", two32).cast("int")).withColumn("f_doc", F.floor((F.col("f") - F.col("f_line")) / two32).cast("long"))
    sets = written(sets.select(*CLASS, "f_doc", "f_line"))
    again = lines.select(*KEY, "h1").join(sized(sets), CLASS).filter("doc <> f_doc OR line <> f_line")
    again = written(again.select("doc", "line", "h1"))  # what stands for no class
    # sets of up to three words are similar to their equals only
    late = late_sets(docs, lines.filter("n > 3").join(sized(again), ["doc", "line", "h1"], "left_anti").select(*KEY, "prefix"), classes, id_col, text_col)

    gone = lines.select(*KEY, "h1").join(sized(late), KEY, "left_semi").select(*CLASS).distinct()
    gone = lines.select(*KEY, "h1").join(sized(written(gone)), CLASS, "left_semi").select("doc", "line")
    out = written(gone.unionByName(again.select("doc", "line")).groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("gone")))
    discard(lines, sets, again, late)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their later matches, with the columns they came with.

    Adds ``__n_lines`` and ``__n_removed``; an untouched text is left byte for byte.
    """
    gone = later_matches(docs, id_col, text_col)
    gone = gone.select(F.col("doc").alias("__doc"), F.col("gone").alias("__gone"))
    joined = docs.join(sized(gone), F.col(id_col) == F.col("__doc"), "left")
    parts = F.split(F.col(text_col), "\n")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    n_lines = F.size(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.ltrim(x, F.lit(SPACE_CHARS)) != ""))
    joined = joined.withColumn("__n_lines", n_lines).withColumn("__n_removed", F.coalesce(F.size("__gone"), F.lit(0)))
    joined = joined.withColumn("__n_removed", F.greatest("__n_removed", F.lit(0)))
    return joined.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(left)).drop("__doc", "__gone")
