"""Near-duplicate documents: banded MinHash, odd sketches, and exact confirmation.

1. Each document's distinct five-word shingles give 160 MinHash samples. Bands of five
   name its buckets; all samples, hashed to bits and folded by parity, make its odd sketch
   (512 bits). The ones in the XOR of two sketches estimate how many samples differ.
2. Documents with equal sets form a class by a 128-bit digest; classes are numbered, and one
   document of each goes on under that number, so an id that comes with several texts is in as many classes.
3. In each bucket every member is checked against the bucket's smallest class: lengths and
   sketches first, then the full sets. That takes one check a member, however large the bucket.
4. Buckets whose other members those links don't bring together are checked pair by pair,
   leaving out pairs that the links join already, and those within the bucket's largest
   part. Such a bucket is cut into blocks of bounded size and its pairs of blocks spread
   over tasks; within one, links that join nothing new aren't confirmed or returned.
5. Links, and classes that share an id, give the components; each is named by its smallest id.

So every pair that shares a bucket is either linked exactly, joined by exact links, refuted,
or thrown out by its sketches. Pairs at 0.85 share none of the 25 buckets with a chance of
4e-7, and fail the sketch check with one of 2e-8 (computed for random odd sketches).

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than five words has
its whole sequence as its one shingle. Null and wordless texts are linked with nothing.
Rows with equal ids count as linked, whatever their texts (all with one of words); rows with a null id are
kept and linked with nothing. Ids are integers; others are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import textnp
from terrane.operators.graph import connected_components
from terrane.plans.shipping import ship
from terrane.plans.storage import discard, sized, written

U64 = np.uint64
SAMPLES, ROWS, BANDS, BITS = 160, 5, 25, 512
#: Percent of the union that the intersection must reach.
PERCENT = 85
#: Sketches may differ in the bits of this estimate; pairs at 0.85 fall below it with a chance of 2e-8.
SLACK = 0.65
BLOCK, PART = 1024, 4096
_rng = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = _rng.integers(1, 1 << 63, SAMPLES, dtype=U64) * U64(2) + U64(1)
_ADD = _rng.integers(1, 1 << 63, SAMPLES, dtype=U64)


def most_bits(slack: float = SLACK) -> int:
    """Ones in the XOR of two sketches at an estimate of ``slack``."""
    differing = 2 * SAMPLES * (1 - slack)
    return int(BITS * (1 - np.exp(-2 * differing / BITS)) / 2)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    best = np.full(SAMPLES, ~U64(0))
    for a in range(0, len(shingles), 2048):
        best = np.minimum(best, (shingles[a : a + 2048, None] * _MULTIPLY + _ADD).min(0))
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of (place, sample) pairs, as 8 signed numbers."""
    h = textnp.mix(samples + np.arange(SAMPLES, dtype=U64) * textnp._PLACE[0])
    bits = np.bincount((h >> U64(55)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def band_keys(samples: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = textnp.mix(samples[: ROWS * bands].reshape(bands, ROWS)) * textnp._PLACE[:ROWS]
    return textnp.mix(rows.sum(1, dtype=U64) + np.arange(bands, dtype=U64) * textnp._PLACE[6]).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the threshold, counted exactly."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.searchsorted(b, a).clip(max=len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return tuple(int(textnp.mix(s ^ textnp._PLACE[k]).sum(dtype=U64).view(np.int64)) for k in (1, 2))


def signatures(docs: DataFrame, id_col: str, text_col: str, n_bands: int = BANDS) -> DataFrame:
    """id, n (set size), d1, d2 (digest), sketch, bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textnp.blocks(batch, "t"):
                n, d1, d2, sketches, bands = [], [], [], [], []
                for s in textnp.shingle_sets(*textnp.utf8(block.column("t"))):
                    n.append(len(s))
                    a, b = digest(s)
                    d1.append(a)
                    d2.append(b)
                    if len(s):
                        samples = minhashes(s)
                        sketches.append(odd_sketch(samples).tolist())
                        bands.append(band_keys(samples, n_bands).tolist())
                    else:
                        sketches.append(None)
                        bands.append(None)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([block.column("i"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sketches, longs), pa.array(bands, longs)], ["id", "n", "d1", "d2", "sketch", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, n long, d1 long, d2 long, sketch array<long>, bands array<long>")


def full_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k and sorted shingles (binary) of the classes (k, rep, n, d1, d2), out of the documents that stand for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textnp.blocks(batch, "t"):
                found: dict = {}  # equal rows of a block go on once
                for i, x in zip(block.column("i").to_pylist(), textnp.shingle_sets(*textnp.utf8(block.column("t"))), strict=True):
                    found.setdefault((i, len(x), *digest(x)), x)
                i, n, d1, d2 = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (i, n, d1, d2)), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["rep", "n", "d1", "d2", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    rows = rows.join(sized(written(classes.select(F.col("rep").alias("i")).distinct())), "i", "left_semi").mapInArrow(run, "rep long, n long, d1 long, d2 long, shingles binary")
    return rows.join(sized(classes), ["rep", "n", "d1", "d2"]).select("k", "shingles").dropDuplicates(["k"])


def _differing(a: str, b: str):
    """Ones in the XOR of two sketch columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def confirm_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    Each pair meets its b first and its a last, in parts of up to PART pairs of one a, so that
    a hot a's set is shipped once a part and its pairs lie in many tasks.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    first = sets.select(F.col("k").alias("a"), F.col("shingles").alias("x")).join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("a", "part", "x")
    second = sets.select(F.col("k").alias("b"), F.col("shingles").alias("y"))
    pairs = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            ok = [linked(np.frombuffer(p.as_buffer(), U64), np.frombuffer(q.as_buffer(), U64), percent) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(second, "b").join(first, ["a", "part"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def check_block(table: pa.Table, percent: int, bits: int) -> tuple[list[int], list[int]]:
    """New links among rows of one pair of blocks (k, label, major, n, sketch, shingles, cross).

    In a ``cross`` unit only pairs of a major and another row count. Pairs of one label are joined already.
    """
    ids, label, n = (np.array(table.column(c).to_pylist(), np.int64) for c in ("k", "label", "n"))
    major = np.array(table.column("major").to_pylist(), bool)
    sketch = np.array(table.column("sketch").to_pylist(), np.int64).view(U64).reshape(len(ids), -1)  # counts of ones are of unsigned numbers
    sets = [np.frombuffer(x.as_buffer(), U64) for x in table.column("shingles")]
    names, at = np.unique(label, return_inverse=True)
    root = list(range(len(names)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    cross = bool(table.column("cross")[0].as_py())
    a, b = [], []
    rows = np.flatnonzero(~major) if cross else np.arange(len(ids))
    for x in rows.tolist():
        others = np.flatnonzero(major) if cross else np.arange(x + 1, len(ids))
        others = others[(at[others] != at[x]) & (100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x]))]
        far = np.bitwise_count(sketch[others] ^ sketch[x]).sum(1)
        near = others[far <= bits]
        for y in near[np.argsort(far[far <= bits], kind="stable")].tolist():
            p, q = find(int(at[x])), find(int(at[y]))
            if p != q and linked(sets[x], sets[y], percent):
                root[p] = q
                a.append(int(ids[x]))
                b.append(int(ids[y]))
    return a, b


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, slack: float | None = None, bands: int = BANDS) -> DataFrame:
    """id, n_shingles, component_id (its smallest id) and kept (id is component_id) of every row.

    ``slack`` and ``bands`` (up to SAMPLES / ROWS) are made for the default ``percent``; a lower one needs others.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids are integers; {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    ship(docs.sparkSession)
    bits = most_bits(SLACK if slack is None else slack)
    sig = written(signatures(docs, id_col, text_col, bands))
    some = sig.filter("n > 0 AND id IS NOT NULL")
    classes = some.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"))
    classes = written(classes.withColumn("k", F.monotonically_increasing_id()))
    chosen = classes.withColumnRenamed("rep", "id")
    reps = written(some.join(chosen, ["id", "n", "d1", "d2"]).select("k", "n", "sketch", "bands").dropDuplicates(["k"]))

    # buckets of two or more; those with the very same members count once
    rows = reps.select("k", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("k").alias("p"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("k")).alias("x1"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("x2")).filter("c > 1")
    buckets = sized(written(buckets.groupBy("p", "c", "x1", "x2").agg(F.min("key").alias("key")).select("key", "p", "c")))
    members = written(rows.join(buckets, "key"))

    facts = reps.select("k", "n", "sketch")
    one, two = (facts.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    stars = members.filter("k <> p").select(F.col("p").alias("a"), F.col("k").alias("b")).distinct()
    stars = stars.join(one, "a").join(two, "b").filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_differing("sa", "sb") <= bits))
    stars = written(stars.select("a", "b"))
    need = written(classes.join(sized(written(stars.select(F.explode(F.array("a", "b")).alias("k")).distinct())), "k", "left_semi"))
    sets = written(full_sets(docs, need, id_col, text_col))
    links = written(confirm_pairs(stars, sets, percent).unionByName(same_ids(some, classes)))
    discard(sets, stars, need)
    labels = written(connected_components(links, "a", "b"))

    # what the star checks left open
    open_ = members.filter("c > 2 AND k <> p").join(labels.withColumnRenamed("id", "k"), "k", "left").select("key", "k", F.coalesce("component", "k").alias("label"))
    open_ = written(open_)
    parts = open_.groupBy("key", "label").agg(F.count("*").alias("m"))
    split = parts.groupBy("key").agg(F.max(F.struct("m", "label")).alias("big"), F.sum("m").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    split = written(split.select("key", F.col("big.label").alias("major_label"), F.col("big.m").alias("m"), (F.col("all") - F.col("big.m")).alias("r")))
    if not split.isEmpty():
        blocks = split.select("key", "major_label", F.ceil(F.col("r") / BLOCK).cast("int").alias("nr"), F.ceil(F.col("m") / BLOCK).cast("int").alias("nm"))
        left = open_.join(sized(blocks), "key").withColumn("major", F.col("label") == F.col("major_label"))
        left = written(left.select("key", "k", "label", "major", "nr", "nm"))
        own = F.when(F.col("major"), F.pmod(F.xxhash64("k"), F.col("nm"))).otherwise(F.pmod(F.xxhash64("k"), F.col("nr"))).cast("int")
        unit = lambda cross, i, j: F.struct(F.lit(cross).alias("cross"), i.alias("i"), j.alias("j"))
        to = lambda n: F.sequence(F.lit(0), n - 1)
        here = F.col("own")
        of_major = F.transform(to(F.col("nr")), lambda i: unit(True, i, here))
        of_rest = F.concat(F.transform(to(F.col("nm")), lambda j: unit(True, here, j)), F.transform(to(F.col("nr")), lambda j: unit(False, F.least(here, j), F.greatest(here, j))))
        units = left.withColumn("own", own).select("key", "k", "label", "major", F.explode(F.when(F.col("major"), of_major).otherwise(of_rest)).alias("u"))
        need = written(classes.join(sized(written(left.select("k").distinct())), "k", "left_semi"))
        more = written(full_sets(docs, need, id_col, text_col))
        loaded = units.select("key", "u.cross", "u.i", "u.j", "k", "label", "major").join(facts, "k").join(more, "k")

        def run(table: pa.Table) -> pa.Table:
            a, b = check_block(table, percent, bits)
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        links = links.unionByName(written(loaded.groupBy("key", "cross", "i", "j").applyInArrow(run, "a long, b long")))
        discard(left, need, more)
        labels = written(connected_components(links, "a", "b"))

    # a component's smallest id, for the classes that are linked with others
    linked_ = written(classes.select("k", "rep").join(labels.withColumnRenamed("id", "k"), "k"))
    names = linked_.groupBy("component").agg(F.min("rep").alias("name"))
    named = classes.join(linked_.join(names, "component").select("k", "name"), "k", "left").select("n", "d1", "d2", F.coalesce("name", "rep").alias("component"))
    named = written(named)
    discard(classes, reps, members, open_, split, labels, linked_)
    named = sized(named)
    out = sig.select("id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def same_ids(some: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): the classes of an id that is in more than one."""
    again = some.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id")
    rows = some.select("id", "n", "d1", "d2").join(sized(written(again)), "id", "left_semi").join(classes.select("n", "d1", "d2", "k"), ["n", "d1", "d2"])
    rows = written(rows.select("id", "k").distinct())
    firsts = rows.groupBy("id").agg(F.min("k").alias("a"))
    return rows.join(sized(written(firsts)), "id").filter("a <> k").select("a", F.col("k").alias("b"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that are kept, with the columns they came with; rows with a kept id all stay."""
    gone = sized(written(near_duplicates(docs, id_col, **options).filter("NOT kept").select(F.col(id_col).alias("__gone")).distinct()))
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
