"""Target-distribution importance resampling of documents by hashed n-grams.

1. Equal texts are grouped by their full text, so each is read and weighed once, with the number
   of its documents beside it.
2. Features are all runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo
   ``buckets``. A run's CRC comes from its words' by shifting, so no run is ever built. Bucket
   counts of the corpus add each text's as often as it has documents; those of the target likewise.
3. A bucket's gain is the scaled logarithm of its smoothed share in the target over that in the corpus; a
   text's weight is the sum over its features.
4. Weights go back to the documents by the text's digest; then each gets its own Gumbel noise,
   and the highest scores among documents of ``least_words`` are drawn, ranked by range and
   not in one task.

A-Z is lower-cased, nothing else; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null, empty and
wordless texts have no features, weight 0, and are never drawn. Repeated rows are
ranked one after the other. A null id takes the noise of an empty one and comes last among ties. Empty tables
give no rows; an empty target still gives gains by smoothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import textnp
from terrane.operators.windows import sorted_ids
from terrane.plans.shipping import ship
from terrane.plans.storage import discard, sized, written

BUCKETS, RUN = 10_000, 3
LEAST_WORDS, DRAWN_PERCENT, SEED = 20, 5, 42
U32 = np.uint32
#: Words of more bytes are hashed one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    """State after one byte, for the low byte of the state before."""
    state = np.arange(256, dtype=U32)
    for _ in range(8):
        state = np.where(state & U32(1), (state >> U32(1)) ^ U32(0xEDB88320), state >> U32(1))
    return state


_TABLE = _crc_table()
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = U32(zlib.crc32(b" "))


def _applied(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as the images of single bits, on numbers."""
    return np.bitwise_xor.reduce(np.where((x[:, None] >> np.arange(32, dtype=U32)) & U32(1), columns, U32(0)), axis=1)


def _past_zeros(length: int) -> np.ndarray:
    """Four tables of 256, by byte: where a CRC goes to when ``length`` zero bytes are read after it, without their own part.

    With it ``crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)``. The map is linear, so powers of it are squared.
    """
    bits = np.left_shift(U32(1), np.arange(32, dtype=U32))
    total, step = bits, _TABLE[bits & U32(255)] ^ (bits >> U32(8))
    while length:
        if length & 1:
            total = _applied(step, total)
        step = _applied(step, step)
        length >>= 1
    return np.stack([_applied(total, np.arange(256, dtype=U32) << U32(8 * k)) for k in range(4)])


class _Shifts:
    """``_past_zeros`` of the lengths seen so far, stacked."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.tables = np.zeros((0, 4, 256), U32)

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        kinds, which = np.unique(length, return_inverse=True)
        new = [n for n in kinds.tolist() if n not in self.at]
        if len(self.at) + len(new) > 4096:
            self.__init__()
            new = kinds.tolist()
        if new:
            self.at |= {n: len(self.at) + k for k, n in enumerate(new)}
            self.tables = np.concatenate([self.tables, np.stack([_past_zeros(n) for n in new])])
        row = np.array([self.at[n] for n in kinds.tolist()])[which]
        out = self.tables[row, 0, crc & U32(255)]
        for k in range(1, 4):
            out ^= self.tables[row, k, (crc >> U32(8 * k)) & U32(255)]
        return out


_shift = _Shifts()


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text) of the words of lower-cased bytes; words never cross texts."""
    word = _IN_WORD[data]
    before = np.append(False, word[:-1]) if len(data) else word
    after = np.append(word[1:], False) if len(data) else word
    edge = off[1:-1]
    before[edge[edge < len(data)]] = False
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(start, off)


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span: short ones byte by byte side by side."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    state = np.full(len(start), ~U32(0), U32)
    long_ = int(np.searchsorted(-length[order], -_LONG, "left"))  # spans of more than _LONG bytes
    left = order[long_:]
    sizes = length[left]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        left = left[: int(np.searchsorted(-sizes[: len(left)], -k, "left"))]  # spans of more than k bytes
        s = state[left]
        state[left] = _TABLE[(s ^ data[start[left] + k]) & U32(255)] ^ (s >> U32(8))
    out = ~state
    for w in order[:long_].tolist():
        out[w] = zlib.crc32(data[start[w] : end[w]].tobytes())
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every feature of a block of texts, repeats included, and the words of each text."""
    data, off = textnp.utf8(texts)
    data = _LOWER[data]
    start, end, first = word_spans(data, off)
    n = len(start)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    crc, length = word_crcs(data, start, end), end - start
    runs, which = [crc], [text]
    spaced = _shift(np.full(n, _SPACE), length) ^ crc if n else crc  # of a space and the word
    run = crc
    for k in range(1, RUN):
        if n <= k:
            break
        run = _shift(run[: n - k], length[k:] + 1) ^ spaced[k:]
        whole = text[k:] == text[: n - k]
        runs.append(run[whole])
        which.append(text[: n - k][whole])
    return np.concatenate(runs) % U32(buckets), np.concatenate(which), np.diff(first)


def bucket_counts(texts: DataFrame, text_col: str, times_col: str | None = None, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs, each text counted ``times_col`` times: ``buckets`` sums, whatever the corpus."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in textnp.blocks(batch, "t"):
                bucket, text, _ = features(block.column("t"), buckets)
                times = block.column("m").to_numpy().astype(float)  # sums of a block stay far below 2^53, so they are exact
                total += np.bincount(bucket, times[text], buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("t"), (F.lit(1) if times_col is None else F.col(times_col)).cast("long").alias("m")).filter("t IS NOT NULL")
    counted = rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # a row a bucket
    out = np.zeros(buckets, np.int64)
    out[counted["bucket"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))`` of each bucket, in doubles."""
    all_s, all_t, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(texts: DataFrame, text_col: str, gain: np.ndarray) -> DataFrame:
    """__digest (of the text), __n_features, __n_words, __weight of each row."""
    shared = texts.sparkSession.sparkContext.broadcast(gain)  # a number a bucket
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textnp.blocks(batch, "t"):
                bucket, text, n_words = features(block.column("t"), buckets)
                order = np.argsort(text, kind="stable")
                number = np.bincount(text, minlength=block.num_rows)
                upto = np.append(0, np.cumsum(shared.value[bucket[order]]))
                ends = np.cumsum(number)
                yield pa.RecordBatch.from_arrays([block.column("d"), pa.array(number.astype(np.int64)), pa.array(n_words.astype(np.int64)), pa.array(upto[ends] - upto[ends - number])], ["__digest", "__n_features", "__n_words", "__weight"])

    rows = texts.select(_digest(text_col).alias("d"), F.col(text_col).cast("string").alias("t")).filter("t IS NOT NULL")
    return rows.mapInArrow(run, "__digest binary, __n_features long, __n_words long, __weight long")


def _digest(text_col: str):
    return F.unhex(F.sha2(F.col(text_col).cast("string").cast("binary"), 256))


def noise(id_col: str, seed: int = SEED):
    """``floor(-1000 ln(-ln((h + 0.5) / 2^32)))``, h the first 32 bits of sha256 of ``seed:id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The documents with ``__n_features``, ``__weight``, ``__score`` and ``__rank`` (from 1; null if not drawn).

    Of the N documents with at least ``least_words`` words, ``floor(percent * N / 100)`` are drawn.
    """
    texts = written(docs.select(F.col(text_col).cast("string").alias("t")).filter("t IS NOT NULL").groupBy("t").agg(F.count(F.lit(1)).alias("m")))
    gain = gains(bucket_counts(texts, "t", "m", buckets), bucket_counts(target, target_text_col, None, buckets))
    weights = written(weigh(texts, "t", gain))
    discard(texts)

    keyed = docs.withColumn("__digest", _digest(text_col)).join(sized(weights), "__digest", "left").drop("__digest")
    keyed = keyed.fillna(0, ["__n_features", "__n_words", "__weight"])
    scored = written(keyed.withColumn("__score", F.col("__weight") + noise(id_col, seed)).withColumn("__row", F.monotonically_increasing_id()))
    discard(weights)
    some = scored.filter(F.col("__n_words") >= least_words)
    drawn = percent * some.count() // 100
    order = some.select((-F.col("__score")).alias("__down"), F.col(id_col).isNull().alias("__none"), F.col(id_col).alias("__id"), F.col("__row").alias("__at"))
    ranked = sorted_ids(order, ["__at"], "__place", ["__down", "__none", "__id", "__at"]).filter(F.col("__place") < drawn)
    ranked = written(ranked.select("__at", (F.col("__place") + 1).alias("__rank")))
    out = scored.join(sized(ranked), F.col("__row") == F.col("__at"), "left")
    return out.select(*docs.columns, "__n_features", "__weight", "__score", "__rank")
