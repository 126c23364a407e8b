"""Token ids packed into rows of a fixed length, best fit decreasing.

Documents are dealt to shards by a hash of id, text and place in the input, so that a row
that repeats a million times is spread too; the number of shards follows the table's bytes,
so a shard stays small at any size. Within a shard every document's ids
(with the end id after them) are cut into segments of at most a row's length; the longest
segment goes first, into the row with the least room that still takes it. The rows' room
is kept in a segment tree over capacities, so a search takes ``log2(length)`` steps.

A packed row holds the padded id row, the cumulative segment lengths, the positions
(which start again at 0 with each segment), and each segment's document and place in it,
so documents can be put together again. Null and empty texts become the end id alone;
repeated rows are packed once each; an empty table gives no rows. Ids and positions that
the output's number type can't hold are an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.plans.shipping import ship

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_BYTES = 8 << 20
_TWO_SPACES = re.compile(r"\s\s|^\s|\s$")


class Tokenizer:
    """Byte-level BPE from a ranks file; the distinct words of many texts are encoded once.

    Between a character that is no space, one space, and another that is none, the pattern
    always cuts before the space, so words parted by single blanks are encoded apart.
    """

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1
        self.sizes = np.zeros(self.end, np.int64)
        self.sizes[list(table.values())] = list(map(len, table))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in one piece, each with a blank before it, and how many each has."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = np.array(self.encoding.encode_ordinary(" " + joined), np.int64)
        sizes = pc.binary_length(words).to_numpy().astype(np.int64) + 1
        starts, places = np.cumsum(sizes) - sizes, np.cumsum(self.sizes[ids]) - self.sizes[ids]
        first = np.searchsorted(places, starts)
        if (places[first] != starts).any():
            raise ValueError("an id reaches over a blank between words")
        return ids, np.diff(first, append=len(ids))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in one piece, the end id after each, and how many each has (its end id too)."""
        parts = pc.split_pattern(texts, " ")
        heads, coded = parts.offsets.to_numpy()[:-1], parts.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        text_of = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
        # a text with blanks side by side or at an end has such a word
        odd = pc.match_substring_regex(words, r"^$|[^\x21-\x7E]").to_numpy(zero_copy_only=False).copy()
        odd[odd] = [not w or _TWO_SPACES.search(w) is not None for w in words.filter(pa.array(odd)).to_pylist()]
        whole = np.zeros(len(texts), bool)
        whole[text_of[odd[codes]]] = True
        alone = [self.encoding.encode_ordinary(texts[k].as_py() if whole[k] else words[codes[h]].as_py()) for k, h in enumerate(heads)]

        inner = ~whole[text_of]
        inner[heads] = False
        used = np.zeros(len(words), bool)
        used[codes[inner]] = True
        found, counts = self._words(words.filter(pa.array(used)))
        of_word = np.cumsum(used) - 1
        ids = np.concatenate([found, np.fromiter(chain.from_iterable(alone), np.int64), [self.end]])
        # pieces in order: the head (or the whole text), its other words, the end id
        at = np.arange(len(codes)) + text_of
        starts, sizes = (np.zeros(len(codes) + len(texts), np.int64) for _ in range(2))
        starts[at[inner]], sizes[at[inner]] = (np.cumsum(counts) - counts)[of_word[codes[inner]]], counts[of_word[codes[inner]]]
        own = np.fromiter(map(len, alone), np.int64, len(alone))
        starts[at[heads]], sizes[at[heads]] = len(found) + np.cumsum(own) - own, own
        ends = np.append(at[heads][1:], len(starts)) - 1
        starts[ends], sizes[ends] = len(ids) - 1, 1
        places = np.cumsum(sizes)
        return ids[np.repeat(starts - places + sizes, sizes) + np.arange(places[-1])], np.diff(places[ends], prepend=0)


class Rooms:
    """Rows by the room they have left: a segment tree over capacities 0 to ``length``."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) with the least room of at least ``need``, taken out; None if there is none."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of segment numbers, by best fit decreasing; ties in order."""
    rooms, rows = Rooms(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = rooms.take(lengths[k])
        if found is None:
            found = len(rows), capacity
            rows.append([])
        rows[found[0]].append(k)
        rooms.put(found[0], found[1] - lengths[k])
    return rows


def pack_ids(ids: list[np.ndarray], length: int, pad: int) -> list[dict]:
    """Packed rows of id lists: ids, cu_seqlens, positions, docs (numbers of the lists) and starts."""
    segments = [(d, a, min(a + length, len(x))) for d, x in enumerate(ids) for a in range(0, len(x), length)]
    out = []
    for row in best_fit([b - a for _, a, b in segments], length):
        own = [segments[k] for k in row]
        sizes = np.array([b - a for _, a, b in own])
        flat, positions = np.full(length, pad), np.zeros(length, np.int64)
        ends = np.cumsum(sizes)
        flat[: ends[-1]] = np.concatenate([ids[d][a:b] for d, a, b in own])
        positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        out.append({"ids": flat, "positions": positions, "cu_seqlens": [0, *ends.tolist()], "docs": [d for d, _, _ in own], "starts": [a for _, a, _ in own]})
    return out


def pack(docs: DataFrame, ranks_file: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> DataFrame:
    """shard, row, n_tokens, ids (binary, ``length`` numbers), cu_seqlens, positions (binary), doc_ids, starts."""
    spark = docs.sparkSession
    ship(spark)
    with open(ranks_file, "rb") as f:
        raw = f.read()
    most = max(int(line.split()[1]) for line in raw.splitlines()) + 1
    if max(most, length - 1) > np.iinfo(dtype).max:
        raise ValueError(f"ids up to {most} and positions up to {length - 1} don't fit {dtype}")
    shared, key = spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()  # a vocabulary file: its size is fixed
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    # the place in the input is the same whenever a lost task reads its part again
    rows = rows.withColumn("s", F.pmod(F.xxhash64("i", F.crc32(F.col("t").cast("binary")), F.monotonically_increasing_id()), F.lit(size // SHARD_BYTES + 1)))

    def run(table: pa.Table) -> pa.Table:
        from terrane.llm import workers

        tokenizer = workers.kept(("bpe", key), lambda: Tokenizer(shared.value))
        table = table.sort_by([("i", "ascending"), ("t", "ascending")])
        flat, counts = tokenizer.ids(pa.concat_arrays(table.column("t").chunks))
        ids = np.split(flat, np.cumsum(counts)[:-1])
        names = table.column("i").to_pylist()
        out = pack_ids(ids, length, tokenizer.end)
        as_bytes = lambda k: pa.array([r[k].astype(dtype).tobytes() for r in out], pa.binary())
        columns = [pa.array([table.column("s")[0].as_py()] * len(out), pa.int64()), pa.array(range(len(out)), pa.int32()), pa.array([r["cu_seqlens"][-1] for r in out], pa.int32()), as_bytes("ids"), pa.array([r["cu_seqlens"] for r in out], pa.list_(pa.int32())), as_bytes("positions"), pa.array([[names[d] for d in r["docs"]] for r in out], pa.list_(table.schema.field("i").type)), pa.array([r["starts"] for r in out], pa.list_(pa.int32()))]
        return pa.Table.from_arrays(columns, ["shard", "row", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "starts"])

    return rows.groupBy("s").applyInArrow(run, f"shard long, row int, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<{kind}>, starts array<int>")


def unpack(rows: Iterator[dict], dtype: str = "<u2") -> dict:
    """Ids of each document (with its end id), from packed rows in any order."""
    parts: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype)
        for d, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            parts.setdefault(d, []).append((start, ids[a:b]))
    return {d: np.concatenate([x for _, x in sorted(p, key=lambda y: y[0])]) for d, p in parts.items()}


def write(packed: DataFrame, path: str) -> None:
    """Binary output: one Parquet row a packed row, files by shard range."""
    packed.write.parquet(path)


def matrix(rows: list[dict], column: str = "ids", dtype: str = "<u2") -> np.ndarray:
    """The id (or position) matrix of packed rows."""
    return np.stack([np.frombuffer(r[column], dtype) for r in rows])
