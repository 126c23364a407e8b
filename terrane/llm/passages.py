"""Substring dedup: words go if they lie in a passage that an earlier document also holds.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window that covers
it has a word sequence that also starts in a document with a smaller id; windows are
judged on the input, so what went elsewhere doesn't matter.

1. Anchors are runs of ``window - PERIOD + 1`` words, hashed only where the place of their first
   word modulo PERIOD is in COVER. COVER is a difference cover: any two places have a common
   shift below PERIOD that brings both onto it, so two equal windows share an anchor at the same
   shift, wherever they start. That hashes 3 of 7 places.
2. Anchors are dealt out by hash; those of two documents or more go back to their documents.
3. A shared anchor is extended to the windows that hold it at each shift; these, known by 128
   bits, are dealt out in turn, and the documents that aren't the window's first get it back.
   So an anchor that thousands of documents share costs each of them its windows, never a pair.
4. Each document drops the words that its windows cover.

Before anything is dealt out, a task brings together what it has read: a hash that several of its
documents share is settled among them, and one row goes on. A passage that fills a third of the
corpus is a row a task. What is dealt out goes to parts of about PART_BYTES of text, so a
task's memory doesn't grow with the corpus. What documents get back grows with the corpus too, so it meets
them by a shuffle at every size.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null, empty and short texts have no windows and lose
nothing; a null text stays null. Rows with equal ids are one document: none of them is earlier than
another. Rows with a null id are neither earlier nor later than any; they lose nothing. Ids
are integers; others are an error. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import textnp
from terrane.plans.shipping import ship
from terrane.plans.storage import discard, written

U64 = np.uint64
WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
#: Text bytes behind one part; hashes that a task gathers before it deals them out.
PART_BYTES, GATHERED = 16 << 20, 1 << 20
_rng = np.random.Generator(np.random.PCG64(1311))
_PLACES = _rng.integers(1, 1 << 63, (2, 64), dtype=U64) * U64(2) + U64(1)
PARTS = "part int, h1 binary, h2 binary, docs binary"


def run_hashes(words: np.ndarray, at: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of the ``width`` words from each place in ``at`` on."""
    total = np.full(len(at), U64(width), U64)
    for k in range(width):
        total += words[at + k] * _PLACES[which, k % 64] + U64(k // 64)
    return textnp.mix(total)


class Words:
    """Word hashes of a block of texts, and each word's text and place in it."""

    def __init__(self, texts: pa.Array) -> None:
        start, end, self.first = textnp.word_spans(*(both := textnp.utf8(texts)))
        self.hashes = textnp.span_hashes(both[0], start, end, False)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.place = np.arange(len(self.hashes)) - self.first[self.text]
        self.left = self.first[1:][self.text] - np.arange(len(self.hashes))

    def anchors(self, window: int) -> np.ndarray:
        """Places of the anchors, in texts that hold a window."""
        long_enough = np.diff(self.first)[self.text] >= window
        return np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= window - PERIOD + 1) & long_enough)

    def windows(self, anchors: np.ndarray, window: int) -> np.ndarray:
        """Places of the windows that hold one of the anchors at a shift below PERIOD."""
        n = len(self.hashes)
        near = np.zeros(n + 1, np.int64)
        near[anchors + 1] = 1  # anchors up to a place, from there on
        upto = np.cumsum(near)
        at = np.arange(n)
        return np.flatnonzero((self.left >= window) & (upto[np.minimum(at + PERIOD, n)] > upto[at]))


def _known(hashes: np.ndarray, text: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which hashes are in their text's list (binary, 64 bits each)."""
    data, off = textnp.utf8(lists)
    own = np.frombuffer(data.tobytes(), U64)
    salt = lambda t: textnp.mix(t.astype(U64) + U64(1))
    listed = own ^ salt(np.repeat(np.arange(len(lists)), np.diff(off) // 8))
    return np.isin(hashes ^ salt(text), listed)


def _groups(h1: np.ndarray, h2: np.ndarray | None, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, number of the group of each row in that order, heads) of rows by hash, then document; equal rows come once."""
    order = np.lexsort((docs, h1) if h2 is None else (docs, h2, h1))
    same = h1[order][1:] == h1[order][:-1]
    if h2 is not None:
        same &= h2[order][1:] == h2[order][:-1]
    once = np.append(True, ~(same & (docs[order][1:] == docs[order][:-1])))
    group = np.cumsum(np.append(True, ~same)) - 1
    order, group = order[once], group[once]
    return order, group, np.flatnonzero(np.append(True, group[1:] != group[:-1]))


def _settled(h1: np.ndarray, h2: np.ndarray | None, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that these rows settle, rows that stand for their hash).

    Anchors (no ``h2``) are settled for every document if there are two; windows for all but the first document.
    """
    if not len(h1):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, group, head = _groups(h1, h2, docs)
    if h2 is None:
        return order[np.repeat(np.diff(np.append(head, len(order))) > 1, np.diff(np.append(head, len(order))))], order[head]
    later = np.ones(len(order), bool)
    later[head] = False
    return order[later], order[head]


def _dealt(part: np.ndarray, h1: np.ndarray, h2: np.ndarray | None, docs: np.ndarray) -> Iterator[tuple]:
    """A row a part, its documents side by side."""
    order = np.lexsort((docs, part))
    part, h1, docs = part[order], h1[order], docs[order]
    head = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(head.tolist(), np.append(head[1:], len(part)).tolist()[: len(head)], strict=True):
        yield int(part[a]), h1[a:b].tobytes(), None if h2 is None else h2[order[a:b]].tobytes(), docs[a:b].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    part, h1, h2, docs = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in (h1, h2, docs))], ["part", "h1", "h2", "docs"])


def _home(docs: np.ndarray, parts: int) -> np.ndarray:
    """Parts beyond ``parts`` are the documents' own."""
    return parts + (textnp.mix(docs.astype(U64)) % U64(parts)).astype(np.int64)


def _sent(found: list[tuple[np.ndarray, ...]], parts: int) -> pa.RecordBatch:
    """What a task has gathered, (h1, h2 or None, docs) each: settled rows go to their documents' part, one of each hash to the hash's."""
    h1, docs = np.concatenate([x[0] for x in found]), np.concatenate([x[2] for x in found])
    h2 = None if found[0][1] is None else np.concatenate([x[1] for x in found])
    settled, rest = _settled(h1, h2, docs)
    rows = list(_dealt(_home(docs[settled], parts), h1[settled], None, docs[settled]))
    rows += _dealt((h1[rest] % U64(parts)).astype(np.int64), h1[rest], None if h2 is None else h2[rest], docs[rest])
    return _batch(rows)


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])


def _per_document(hashes: DataFrame, parts: int) -> DataFrame:
    """(__doc, __hashes): the hashes that each document gets back, a written table."""

    def settle(table: pa.Table) -> pa.Table:
        h1, docs = _column(table, "h1", U64), _column(table, "docs", np.int64)
        if table.column("part")[0].as_py() < parts:
            h2 = _column(table, "h2", U64) if table.column("h2").null_count == 0 else None
            settled, _ = _settled(h1, h2, docs)
            h1, docs = h1[settled], docs[settled]
        return pa.Table.from_batches([_batch(list(_dealt(_home(docs, parts), h1, None, docs)))]).select(["part", "h1", "docs"])

    def gather(table: pa.Table) -> pa.Table:
        h1, docs = _column(table, "h1", U64), _column(table, "docs", np.int64)
        order = np.lexsort((h1, docs))
        h1, docs = h1[order], docs[order]
        once = np.append(True, (h1[1:] != h1[:-1]) | (docs[1:] != docs[:-1]))
        h1, docs = h1[once], docs[once]
        head = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        lists = [h1[a:b].tobytes() for a, b in zip(head.tolist(), np.append(head[1:], len(docs)).tolist(), strict=True)]
        return pa.table({"__doc": pa.array(docs[head], pa.int64()), "__hashes": pa.array(lists, pa.binary())})

    settled = hashes.groupBy("part").applyInArrow(settle, "part int, h1 binary, docs binary")
    return written(settled.groupBy("part").applyInArrow(gather, "__doc long, __hashes binary"))


def _hashed(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], parts: int) -> DataFrame:
    """PARTS of what ``hashes_of`` finds in blocks of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for block in textnp.blocks(batch, "t"):
                found.append(hashes_of(block))
                size += len(found[-1][0])
                if size >= GATHERED:
                    yield _sent(found, parts)
                    found, size = [], 0
        if found:
            yield _sent(found, parts)

    return rows.mapInArrow(run, PARTS)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(__doc, __hashes): of each document the hashes of its windows that an earlier document holds; a written table."""
    if not PERIOD < window <= 64:
        raise ValueError(f"a window has {PERIOD + 1} to 64 words")
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids are integers; {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    parts = (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // PART_BYTES + 1

    def anchors_of(block: pa.RecordBatch) -> tuple[np.ndarray, None, np.ndarray]:
        words = Words(block.column("t"))
        at = words.anchors(window)
        return run_hashes(words.hashes, at, window - PERIOD + 1), None, block.column("i").to_numpy()[words.text[at]]

    def windows_of(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Words(block.column("t"))
        at = words.anchors(window)
        at = at[_known(run_hashes(words.hashes, at, window - PERIOD + 1), words.text[at], block.column("__hashes"))]
        at = words.windows(at, window)
        return run_hashes(words.hashes, at, window), run_hashes(words.hashes, at, window, 1), block.column("i").to_numpy()[words.text[at]]

    shared = _per_document(_hashed(rows, anchors_of, parts), parts)
    some = rows.join(shared, F.col("i") == F.col("__doc")).select("i", "t", "__hashes")
    late = _per_document(_hashed(some, windows_of, parts), parts)
    discard(shared)
    return late


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with what is left of their words, joined by one space, and the columns they came with.

    Adds ``__n_words`` (of the input) and ``__n_removed``.
    """
    late = repeated_windows(docs, id_col, text_col, window)
    joined = docs.withColumn(text_col, F.col(text_col).cast("string")).join(late, F.col(id_col) == F.col("__doc"), "left").drop("__doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textnp.blocks(batch, text_col):
                column = block.column(text_col)
                texts = [None if t is None else t.split() for t in column.cast(pa.binary()).to_pylist()]  # bytes split at [\x20\x09-\x0D]
                n_words, gone = [len(t or ()) for t in texts], [0] * len(texts)
                valid = lambda c: c.is_valid().to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(valid(block.column("__hashes")) & valid(column))
                if len(hit):
                    words = Words(column.take(pa.array(hit)))
                    at = np.flatnonzero(words.left >= window)
                    at = at[_known(run_hashes(words.hashes, at, window), words.text[at], block.column("__hashes").take(pa.array(hit)))]
                    edges = np.zeros(len(words.hashes) + 1, np.int64)
                    edges[at] += 1
                    edges[at + window] -= 1
                    stays = np.cumsum(edges)[:-1] == 0
                    for k, a, b in zip(hit.tolist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                        texts[k] = [w for w, s in zip(texts[k], stays[a:b].tolist(), strict=True) if s]
                        gone[k] = n_words[k] - len(texts[k])
                left = pa.array([None if t is None else b" ".join(t) for t in texts], pa.binary()).cast(pa.string())
                columns = [left if name == text_col else block.column(name) for name in block.schema.names if name != "__hashes"]
                names = [name for name in block.schema.names if name != "__hashes"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(gone, pa.int64())], [*names, "__n_words", "__n_removed"])

    schema = joined.drop("__hashes").withColumn("__n_words", F.lit(0).cast("long")).withColumn("__n_removed", F.lit(0).cast("long")).schema
    return joined.mapInArrow(run, schema)
