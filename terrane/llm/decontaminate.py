"""Benchmark decontamination by greedy string tiling.

Seeds are the five-word runs that a text and a benchmark item share. For each pair with
seeds, the longest common run of unmarked words is found and marked in both, again and
again, until no common run of five words is left; at each length the windows are compared
by running Karp-Rabin hashes. Coverage is the share of an item's words that got marked,
so an item whose passages stand in another order is caught as well. A pair is a leak if
coverage is at least ``threshold``.

The benchmark goes to the executors in blocks of up to ``BLOCK_WORDS`` words, each run
over all documents, so a broadcast has a fixed bound at any size of benchmark.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Null and empty texts match nothing;
items with fewer than five words have no seeds and match nothing; repeated rows are each
reported; empty tables give no leaks. For ``remove_leaks`` rows with one id are one document:
if one of them leaks, all go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terrane.llm import textnp
from terrane.plans.shipping import ship
from terrane.plans.storage import sized, written

WIDTH = 5
THRESHOLD = 0.8
BLOCK_WORDS = 1_000_000
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)


class Benchmark:
    """Items as word hashes, and an index from their five-word runs to (item, place)."""

    def __init__(self, texts: list[str]) -> None:
        data, off = textnp.utf8(pa.array(texts, pa.large_string()))
        start, end, self.first = textnp.word_spans(data, off)
        self.words = textnp.span_hashes(data, start, end, True)
        self.item_of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        runs = textnp.window_hashes(self.words, WIDTH)
        whole = np.flatnonzero(self.item_of[: len(runs)] == self.item_of[WIDTH - 1 : WIDTH - 1 + len(runs)])
        order = np.argsort(runs[whole], kind="stable")
        self.places = whole[order]
        self.seeds, self.at, self.number = np.unique(runs[whole][order], return_index=True, return_counts=True)
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.seeds >> U64(44)).astype(np.int64)] = True

    def item(self, k: int) -> np.ndarray:
        return self.words[self.first[k] : self.first[k + 1]]

    def lookup(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``runs``, numbers of their seeds)."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.flags[(runs >> U64(44)).astype(np.int64)])
        at = np.searchsorted(self.seeds, runs[maybe]).clip(max=len(self.seeds) - 1)
        hit = self.seeds[at] == runs[maybe]
        return maybe[hit], at[hit]


def _prefix_hash(words: np.ndarray) -> np.ndarray:
    """Running hash: h[i + 1] = sum of word k * base^(k + 1) for k up to i."""
    powers = np.cumprod(np.full(len(words) + 1, _BASE, U64), dtype=U64)
    return np.concatenate([np.zeros(1, U64), np.cumsum(words * powers[:-1], dtype=U64)]), powers


def _windows(prefix: np.ndarray, powers: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words at ``at``, shifted to one common power."""
    return (prefix[at + size] - prefix[at]) * powers[len(powers) - 1 - at]


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Places of the runs of ``size`` words none of which is marked."""
    before = np.append(0, np.cumsum(marked))
    return np.flatnonzero(before[size:] == before[:-size]) if size <= len(marked) else np.zeros(0, np.int64)


def tile(item: np.ndarray, text: np.ndarray, width: int = WIDTH, used: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length); words of the text that are ``used`` are marked from the start.

    The longest common run of free words is found by bisection over its length, as a common
    run has common parts; at each length the windows of both sides are compared by running
    Karp-Rabin hashes. Time grows with the words, not with the pairs of equal places, however
    often a run repeats. Ties go to the first place in the item, then in the text.
    """
    in_item, in_text = np.zeros(len(item), bool), np.zeros(len(text), bool) if used is None else used.copy()
    size = max(len(item), len(text))
    # one power for both sides, so that equal runs hash alike wherever they stand
    pad = lambda w: np.concatenate([w, np.zeros(size - len(w), U64)])
    a, powers = _prefix_hash(pad(item))
    b, _ = _prefix_hash(pad(text))

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places in item and text of free windows that both have, each with its hash."""
        i, j = _free(in_item, length), _free(in_text, length)
        ha, hb = _windows(a, powers, i, length), _windows(b, powers, j, length)
        own = np.unique(ha)
        both = np.zeros(len(hb), bool) if not len(own) else own[np.searchsorted(own, hb).clip(max=len(own) - 1)] == hb
        also = np.isin(ha, hb[both])
        return i[also], ha[also], j[both], hb[both]

    tiles, most = [], min(len(item), len(text))
    while most >= width and len(common(width)[0]):
        low, high = width, most
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        first, ha, second, hb = common(low)
        where: dict[int, list[int]] = {}
        for h, y in zip(hb[::-1].tolist(), second[::-1].tolist(), strict=True):
            where.setdefault(h, []).append(y)
        for x, h in zip(first.tolist(), ha.tolist(), strict=True):
            if in_item[x : x + low].any():
                continue
            places = where[h]
            while places and (in_text[places[-1] : places[-1] + low].any() or not np.array_equal(item[x : x + low], text[places[-1] : places[-1] + low])):
                places.pop()  # what is marked stays marked
            if places:
                y = places.pop()
                in_item[x : x + low] = in_text[y : y + low] = True
                tiles.append((x, y, low))
        most = low - 1  # no free pair of this length is left
    return tiles


#: Places of seeds looked at together; one text has the benchmark block's at most.
_PLACES_AT_ONCE = 1 << 20


def _candidates(text: np.ndarray, seed: np.ndarray, bench: Benchmark, threshold: float) -> Iterator[tuple[int, int]]:
    """(text, item) whose shared seeds cover enough of the item; ``text`` and ``seed`` are distinct pairs, sorted.

    A seed counts once a text, so its work is its places in the benchmark, however often the text repeats it.
    """
    work = np.cumsum(bench.number[seed])
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + _PLACES_AT_ONCE, "right")))
        to = int(np.searchsorted(text, text[to - 1], "right"))  # whole texts
        t, s = text[at:to], seed[at:to]
        number = bench.number[s]
        place = bench.places[np.repeat(bench.at[s] - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))]
        t = np.repeat(t, number)
        order = np.lexsort((place, t))
        t, place = t[order], place[order]
        item = bench.item_of[place]
        head = np.flatnonzero(np.append(True, (np.diff(t) != 0) | (np.diff(item) != 0)))
        reach = np.minimum(np.append(np.diff(place), WIDTH), WIDTH)
        reach[np.append(head[1:], len(t)) - 1] = WIDTH
        covered = np.add.reduceat(reach, head)
        ok = head[covered >= threshold * np.diff(bench.first)[item[head]]]  # no tiling covers more
        yield from zip(t[ok].tolist(), item[ok].tolist(), strict=True)
        at = to


def leaks_in(data: np.ndarray, off: np.ndarray, bench: Benchmark, threshold: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, tiles, words covered, words of the item) of each leak."""
    start, end, first = textnp.word_spans(data, off)
    words = textnp.span_hashes(data, start, end, True)
    at, seed = bench.lookup(textnp.window_hashes(words, WIDTH))
    text = np.searchsorted(first, at, "right") - 1
    whole = at + WIDTH <= first[text + 1]
    at, seed, text = at[whole], seed[whole], text[whole]
    if not len(at):
        return
    order = np.lexsort((seed, text))
    new = np.append(True, (np.diff(text[order]) != 0) | (np.diff(seed[order]) != 0))
    for t, k in _candidates(text[order][new], seed[order][new], bench, threshold):
        own = bench.item(k)
        a, b = np.searchsorted(text, [t, t + 1])
        here = at[a:b][np.isin(bench.seeds[seed[a:b]], textnp.window_hashes(own, WIDTH))] - first[t]
        # the text's words in shared seeds, with a marked word between parts that don't touch
        reach = np.zeros(int(here[-1]) + WIDTH + 1, np.int64)
        reach[here] += 1
        reach[here + WIDTH] -= 1
        place = np.flatnonzero(np.cumsum(reach)[:-1] > 0)
        part = np.cumsum(np.append(0, np.diff(place) > 1))
        short, used = np.zeros(len(place) + int(part[-1]), U64), np.ones(len(place) + int(part[-1]), bool)
        short[np.arange(len(place)) + part] = words[first[t] + place]
        used[np.arange(len(place)) + part] = False
        tiles = tile(own, short, WIDTH, used)
        covered = sum(n for _, _, n in tiles)
        if covered >= threshold * len(own):
            yield t, k, len(tiles), covered, len(own)


def benchmark_blocks(bench: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of blocks of up to BLOCK_WORDS words, an item at least."""
    ids, texts, size = [], [], 0
    for r in bench.select(F.col(id_col), F.col(text_col)).filter(F.col(text_col).isNotNull()).toLocalIterator():
        n = len(r[1].split())
        if texts and size + n > BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0]), texts.append(r[1])
        size += n
    if texts:
        yield ids, texts


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a leak: document, item, n_tiles, covered_words, item_words, coverage."""
    spark = docs.sparkSession
    ship(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), bench.schema[item_col].dataType.simpleString()
    schema = f"i {kind}, k {item_kind}, n_tiles int, covered_words int, item_words int, coverage double"
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    item_type = to_arrow_type(bench.schema[item_col].dataType)
    found = []
    for ids, texts in benchmark_blocks(bench, item_col, item_text_col):
        shared = spark.sparkContext.broadcast((ids, Benchmark(texts)))  # BLOCK_WORDS words at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, index = shared.value
            for batch in batches:
                for block in textnp.blocks(batch, "t"):
                    hits = list(leaks_in(*textnp.utf8(block.column("t")), index, threshold))
                    if hits:
                        t, k, n, c, w = (list(x) for x in zip(*hits, strict=True))
                        yield pa.RecordBatch.from_arrays([block.column("i").take(pa.array(t)), pa.array([names[x] for x in k], item_type), pa.array(n, pa.int32()), pa.array(c, pa.int32()), pa.array(w, pa.int32()), pa.array([x / y for x, y in zip(c, w, strict=True)])], ["i", "k", "n_tiles", "covered_words", "item_words", "coverage"])

        found.append(rows.mapInArrow(run, schema))
    if not found:
        found = [spark.createDataFrame([], schema)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("i", id_col).withColumnRenamed("k", item_col)


def remove_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without a leak, with the columns they came with. Null ids stay."""
    dirty = sized(written(leaks(docs, bench, id_col, **options).select(F.col(id_col).alias("__leak")).filter("__leak IS NOT NULL").distinct()))
    return docs.join(dirty, F.col(id_col) == F.col("__leak"), "left_anti")
