"""SentencePiece segmentation over the piece lattice, and decoding.

The lattice of a text has a node at each character boundary and an edge for each piece
that matches there, weighted by the piece's score in the model; a character that is no
piece by itself also gets an edge of its UTF-8 bytes with the unknown score. The best
segmentation is the best path (Viterbi, forward). The N best come from an A-star search
backward from the end: the forward score of a node is exactly what the rest of the path
will add, so paths leave the queue in order of their total score.

No piece holds a space after another character, so the lattice of a text is a chain of
the lattices of its chunks (a run of spaces and the word after it). Equal chunks are
solved once, many at a time; the N best of a text combine its chunks' N best.

A space is put before every text that isn't empty and taken away in decoding; decoding an
encoded text gives the text back, byte for byte. A null text has no ids and a null score;
an empty text has no ids and score 0. Repeated rows are encoded alike; extra columns are not
read. Ties between equal totals go to the longer last piece.

The scores of a BPE model are the ranks of its merges, not log probabilities: its best path
is not what merging gives, and its ids are longer. ``encode_merges`` gives the model's own
ids, those that a network trained with that vocabulary expects.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import textnp
from terrane.plans.shipping import ship

#: How much the unknown score lies below the least score of a piece.
UNKNOWN_BELOW = 10.0
U64 = np.uint64
WIDE = 48
#: Scores are multiples of one part of this, so sums are exact and equal totals are equal numbers.
SCORE_STEPS = 1 << 20


class Pieces:
    """Pieces of a model file: scores, bytes, and a hash table of normal pieces."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.raw: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        self.ids: dict[bytes, int] = {}
        self.score = np.zeros(len(proto.pieces))
        for i, p in enumerate(proto.pieces):
            self.score[i] = round(p.score * SCORE_STEPS) / SCORE_STEPS
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.raw.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (1, 4):
                self.raw.append(p.piece.replace("▁", " ").encode())
                self.ids[self.raw[-1]] = i
            else:
                self.raw.append(b"")
        self.unknown = min(self.score[i] for i in self.ids.values()) - UNKNOWN_BELOW
        if any(b" " in r.lstrip(b" ") for r in self.ids):
            raise ValueError("a piece has a space after another character")
        #: For each last byte the lengths of the pieces that end with it.
        self.sizes: list[list[int]] = [[] for _ in range(256)]
        for last, size in sorted({(r[-1], len(r)) for r in self.ids}):
            self.sizes[last].append(size)
        #: Longest piece that isn't spaces alone.
        self.longest_word = max(len(r) for r in self.ids if r.strip(b" "))

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted hashes, their ids, 2^20 flags of hashes' top bits)."""
        raw = list(self.ids)
        data, length = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
        end = np.cumsum(length)
        keys, ids = textnp.span_hashes(data, end - length, end, False), np.array([self.ids[r] for r in raw])
        order = np.argsort(keys)
        flags = np.zeros(1 << 20, bool)
        flags[(keys >> U64(44)).astype(np.int64)] = True
        return keys[order], ids[order], flags

    def edges(self, chunk: bytes) -> Callable[[int], list[tuple[int, int, float]]]:
        """A function of an end position to its edges: (start, piece or -1 for bytes, score), shortest piece first."""
        known, score, sizes = self.ids, self.score, self.sizes

        def into(end: int) -> list[tuple[int, int, float]]:
            out, start = [], end - 1
            while start > 0 and chunk[start] & 0xC0 == 0x80:
                start -= 1
            p = known.get(chunk[start:end])
            out.append((start, -1, self.unknown) if p is None else (start, p, score[p]))
            for size in sizes[chunk[end - 1]]:
                if end - size < start and size <= end and (p := known.get(chunk[end - size : end])) is not None:
                    out.append((end - size, p, score[p]))
            return out

        return into

    def nbest(self, chunk: bytes, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best (score, ids) of a chunk: forward Viterbi, then A-star from the end.

        Of equal totals the newest path goes on, so a chunk with very many equal paths, as a
        long run of one letter, costs its length and not their number.
        """
        into = self.edges(chunk)
        ahead = [0.0] + [-np.inf] * len(chunk)
        for end in range(1, len(chunk) + 1):
            if end == len(chunk) or chunk[end] & 0xC0 != 0x80:
                ahead[end] = max([ahead[start] + score for start, _, score in into(end)])
        found, tick = [], 0
        queue = [(-ahead[-1], 0, len(chunk), 0.0, None)]
        while queue and len(found) < n:
            total, _, at, behind, path = heapq.heappop(queue)
            if at == 0:
                ids = []
                while path is not None:
                    (start, end, p), path = path
                    ids += [p] if p >= 0 else self.byte_id[np.frombuffer(chunk[start:end], np.uint8)].tolist()
                found.append((-total, ids))
                continue
            for start, p, score in into(at):
                tick -= 1
                heapq.heappush(queue, (-(ahead[start] + score + behind), tick, start, behind + score, ((start, at, p), path)))
        return found

    def solve(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best score, loss of the second best, ids end to end, number of ids) of many chunks.

        The loss is infinite if a chunk has one segmentation only.
        """
        n = len(chunks)
        length = np.array([len(c) for c in chunks], np.int64)
        best, loss, out = np.zeros(n), np.full(n, np.inf), [[]] * n
        plain = np.array([not c.startswith(b"  ") for c in chunks], bool) & (length <= WIDE)
        order = np.flatnonzero(plain)[np.argsort(length[plain], kind="stable")]
        for a in range(0, len(order), 8192):
            rows = order[a : a + 8192]
            best[rows], loss[rows], ids = self._solve_even([chunks[i] for i in rows])
            for i, x in zip(rows.tolist(), ids, strict=True):
                out[i] = x
        for i in np.flatnonzero(~plain).tolist():
            found = self.nbest(chunks[i], 2)
            best[i], out[i] = found[0]
            if len(found) > 1:
                loss[i] = found[0][0] - found[1][0]
        count = np.array([len(x) for x in out], np.int64)
        return best, loss, np.fromiter(chain.from_iterable(out), np.int32, int(count.sum())), count

    def _solve_even(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Viterbi both ways over chunks of like length: one vector operation for each place of an edge."""
        n, length = len(chunks), np.array([len(c) for c in chunks], np.int64)
        width = int(length.max())
        data = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in chunks), np.uint8).reshape(n, width).T.copy()
        border = np.vstack([(data & 0xC0) != 0x80, np.ones(n, bool)])
        border[np.minimum(length, width), np.arange(n)] = True
        after = np.zeros((width, n), np.int64)
        following = np.full(n, width)
        for at in range(width - 1, -1, -1):
            following = np.where(border[at + 1], at + 1, following)
            after[at] = following
        keys, ids, flags = self.table
        value, power = textnp._BYTE[data], textnp.powers(width + 1)
        ahead = np.full((width + 1, n), -np.inf)
        ahead[0] = 0
        back, piece = np.zeros((width + 1, n), np.int64), np.full((width + 1, n), -1, np.int64)
        edges: list[tuple[np.ndarray, int, object, object]] = []
        for start in range(width):
            open_ = border[start] & (length > start)
            if not open_.any():
                continue
            known = ~open_
            h = np.zeros(n, U64)
            for end in range(start + 1, min(width, start + self.longest_word) + 1):
                h += value[end - 1] * power[end - 1 - start]
                salt = U64((end - start) * int(textnp._PLACE[7]) & 0xFFFFFFFFFFFFFFFF)
                key = textnp.mix(h + salt)
                maybe = np.flatnonzero(flags[(key >> U64(44)).view(np.int64)] & open_ & border[end] & (length >= end))
                if not len(maybe):
                    continue
                at = np.searchsorted(keys, key[maybe]).clip(max=len(keys) - 1)
                hit = keys[at] == key[maybe]
                r, p = maybe[hit], ids[at[hit]]
                known[r[after[start, r] == end]] = True
                edges.append((r, start, end, self.score[p]))
                new = ahead[start, r] + self.score[p]
                up = new > ahead[end, r]
                r, p = r[up], p[up]
                ahead[end, r], back[end, r], piece[end, r] = new[up], start, p
            r = np.flatnonzero(~known)
            if len(r):
                end = after[start, r]
                edges.append((r, start, end, self.unknown))
                new = ahead[start, r] + self.unknown
                up = new > ahead[end, r]
                ahead[end[up], r[up]], back[end[up], r[up]], piece[end[up], r[up]] = new[up], start, -1
        every = np.arange(n)
        best = ahead[length, every]
        rest = np.full((width + 1, n), -np.inf)
        rest[length, every] = 0
        for r, a, b, score in reversed(edges):
            rest[a, r] = np.maximum(rest[a, r], score + rest[b, r])
        taken, steps, at = np.zeros((width + 1, n), bool), [], length.copy()
        while (r := np.flatnonzero(at > 0)).size:
            taken[at[r], r] = True
            before = back[at[r], r]
            steps.append((r.tolist(), before.tolist(), at[r].tolist(), piece[at[r], r].tolist()))
            at[r] = before
        second = np.full(n, -np.inf)
        for r, a, b, score in edges:
            total = ahead[a, r] + score + rest[b, r]
            total[taken[b, r] & (back[b, r] == a)] = -np.inf
            second[r] = np.maximum(second[r], total)  # an edge's place holds a row once
        paths: list[list[int]] = [[] for _ in range(n)]
        for step in reversed(steps):
            for i, x, y, q in zip(*step, strict=True):
                if q >= 0:
                    paths[i].append(q)
                else:
                    paths[i] += self.byte_id[np.frombuffer(chunks[i][x:y], np.uint8)].tolist()
        return best, best - second, paths

    def decode(self, ids) -> bytes:
        """The text of ids, without the space put before it."""
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:]


def chunk_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first chunk of each document): cut before each space that follows another character."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        cut[1 : len(data)] = (data[1:] == 0x20) & (data[:-1] != 0x20)
    cut[off[:-1]] = True
    cut[len(data)] = False
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], len(data)), np.searchsorted(start, off)


#: (first place, number of ids that go, ids that come)
Change = tuple[int, int, list[int]]
_OTHERS = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


class Encoder:
    """Encodes columns of texts, keeping the solutions of ``room`` recent chunks."""

    def __init__(self, pieces: Pieces, room: int = 300_000) -> None:
        self.pieces, self.room = pieces, room
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.best, self.loss, self.count = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.ways: dict[tuple[bytes, int], list[tuple[float, list[int]]]] = {}

    def _add(self, keys: list[int], chunks: list[bytes]) -> None:
        best, loss, ids, count = self.pieces.solve(chunks)
        self.known.update(zip(keys, range(len(self.best), len(self.best) + len(keys)), strict=True))
        self.first = np.append(self.first, len(self.ids) + np.cumsum(count) - count)
        self.best, self.loss, self.count, self.ids = np.append(self.best, best), np.append(self.loss, loss), np.append(self.count, count), np.append(self.ids, ids)

    def texts(self, column: pa.Array, n: int = 2) -> Iterator[tuple[np.ndarray, float, list[tuple[float, list[Change]]]]]:
        """For each text its ids, score, and the next best up to the ``n``-th: (score, changes of the ids)."""
        data, off = with_space(*textnp.utf8(column))
        start, end, first = chunk_spans(data, off)
        keys = textnp.span_hashes(data, start, end, False)
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > self.room:
            self._clear()
        names, raw = distinct.tolist(), data.tobytes()
        new = [i for i, k in enumerate(names) if k not in self.known]
        if new:
            where = at[new]
            self._add([names[i] for i in new], [raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
        rows = np.array([self.known[k] for k in names], np.int64)[back] if len(names) else np.zeros(0, np.int64)
        size = self.count[rows]
        place = np.cumsum(size) - size
        ids = self.ids[np.arange(int(size.sum())) - np.repeat(place - self.first[rows], size)]
        edge = np.append(place, len(ids))[first]
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            own = rows[a:b]
            score = float(self.best[own].sum())
            spans = lambda c, a=a, i=i: (int(place[a + c] - edge[i]), int(size[a + c]), raw[start[a + c] : end[a + c]])
            yield ids[edge[i] : edge[i + 1]], score, self._next(own, score, n, spans)

    def _ways(self, chunk: bytes, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best of a chunk, kept for short ones."""
        if len(chunk) > WIDE:
            return self.pieces.nbest(chunk, n)
        if (chunk, n) not in self.ways:
            if len(self.ways) >= self.room:
                self.ways.clear()
            self.ways[chunk, n] = self.pieces.nbest(chunk, n)
        return self.ways[chunk, n]

    def _next(self, rows: np.ndarray, score: float, n: int, spans) -> list[tuple[float, list[Change]]]:
        """The second to n-th best of a chain of chunks.

        The i-th best loses by at least the i smallest second-best losses, so only the
        ``n - 1`` chunks with the least loss can change; their alternatives are combined.
        """
        if n < 2 or not len(rows):
            return []
        loss = self.loss[rows]
        few = np.argpartition(loss, n - 2)[: n - 1] if len(loss) > n - 1 else np.arange(len(loss))
        few = few[np.isfinite(loss[few])]
        few = few[np.lexsort((few, loss[few]))]
        best = [(0.0, [])]
        for c in few.tolist():
            first, size, raw = spans(c)
            ways = self._ways(raw, n)
            both = [(lost + ways[0][0] - s, [*changes, (first, size, ids)] if k else changes) for lost, changes in best for k, (s, ids) in enumerate(ways)]
            best = heapq.nsmallest(n, both, key=lambda x: x[0])
        return [(score - lost, sorted(changes)) for lost, changes in best[1:]]


def changed(ids: list[int], changes: list[Change]) -> list[int]:
    """The ids of another segmentation: at each change's first place, so many ids give way to its own."""
    out, at = [], 0
    for first, size, own in changes:
        out += [*ids[at:first], *own]
        at = first + size
    return [*out, *ids[at:]]


def with_space(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before each text that isn't empty."""
    full = np.diff(off) > 0
    shift = np.append(0, np.cumsum(full))
    out = np.full(len(data) + int(shift[-1]), 0x20, np.uint8)
    mask = np.ones(len(out), bool)
    mask[(off + shift)[:-1][full]] = False
    out[mask] = data
    return out, off + shift


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", n: int = 2) -> DataFrame:
    """id, ids, score, ``others`` and ``restored`` (decoding gives the text).

    ``others`` holds the second to ``n``-th best segmentations, each its score and its changes
    to the ids (``changed`` applies them): whole texts differ in a few chunks only.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_file, "rb") as f:
        raw = f.read()
    shared, key = spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()  # a model file: its size is fixed
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrane.llm import workers

        encoder = workers.kept(("lattice", key), lambda: Encoder(Pieces(shared.value)))
        for batch in batches:
            for block in textnp.blocks(batch, "t"):
                data, off = textnp.utf8(block.column("t"))
                raw, absent = data.tobytes(), block.column("t").is_null().to_pylist()
                ids, scores, others, same = [], [], [], []
                for i, (own, score, after) in enumerate(encoder.texts(block.column("t"), n)):
                    ids.append(own)
                    scores.append(None if absent[i] else score)
                    others.append([{"score": s, "changes": [{"first": f, "size": z, "ids": x} for f, z, x in c]} for s, c in after])
                    same.append(encoder.pieces.decode(own.tolist()) == raw[off[i] : off[i + 1]])
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([block.column("i"), lists, pa.array(scores, pa.float64()), pa.array(others, _OTHERS), pa.array(same)], ["i", "ids", "score", "others", "restored"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"i {kind}, ids array<int>, score double, others array<struct<score:double,changes:array<struct<first:int,size:int,ids:array<int>>>>>, restored boolean").withColumnRenamed("i", id_col)


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of ids."""
    spark = encoded.sparkSession
    ship(spark)
    with open(model_file, "rb") as f:
        raw = f.read()
    shared, key = spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrane.llm import workers

        pieces = workers.kept(("pieces", key), lambda: Pieces(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if ids is None else pieces.decode(ids).decode("utf-8", "replace") for ids in part.column("x").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(texts, pa.string())], ["i", "text"])

    return encoded.select(F.col(id_col).alias("i"), F.col(ids_col).alias("x")).mapInArrow(run, f"i {kind}, text string").withColumnRenamed("i", id_col)


def encode_merges(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids as the model's own algorithm cuts the text (merges for BPE); null texts have null ids."""
    spark = docs.sparkSession
    ship(spark)
    with open(model_file, "rb") as f:
        raw = f.read()
    shared, key = spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        from terrane.llm import workers

        processor = workers.kept(("merges", key), lambda: SentencePieceProcessor(model_proto=shared.value))
        for batch in batches:
            for block in textnp.blocks(batch, "t"):
                ids = [None if t is None else processor.encode(t, num_threads=1) for t in block.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([block.column("i"), pa.array(ids, pa.list_(pa.int32()))], ["i", "ids"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"i {kind}, ids array<int>").withColumnRenamed("i", id_col)
