"""Language identification by word-first backoff.

A word that the model knows scores its log frequency in each language. Any other word
falls back to its longest character n-grams that the model knows, 5 down to 1, and scores
their mean. A text's language is the one with the highest sum over its words.

Fitting reads a hash sample of about ``per_language`` labelled documents a language (a
documented bound; rows are chosen by their id's hash, whole texts are used) and keeps all
words and n-grams of the sample, so the sample bounds the model.

Null and letterless texts are ``und`` with score 0, as is every text if there is nothing
to learn from. Ties go to the first language by name. Null ids are held in and learnable.
Repeated rows are judged alike; rows that share an id are in the sample together or not at all.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm import textnp
from terrane.plans.shipping import ship
from terrane.plans.storage import discard, written

LONGEST = 5
#: Labelled documents of a language to learn from, about.
PER_LANGUAGE = 1000
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


@dataclass(frozen=True)
class Model:
    """Features by their rows in a table of log frequencies, a column a language."""

    languages: tuple[str, ...]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray

    def longest(self, word: str) -> list[int]:
        """Rows of the longest n-grams of a word that the model knows."""
        marked, get = f" {word} ", self.grams.get
        for n in range(LONGEST, 0, -1):
            found = [k for i in range(len(marked) - n + 1) if (k := get(marked[i : i + n])) is not None]
            if found:
                return found
        return []

    def scores(self, words: list[list[str]]) -> np.ndarray:
        """Of each list the sum of its words' log frequencies, by the word or else by the mean of its longest known n-grams."""
        out = np.zeros((len(words), len(self.languages)))
        known, owner, grams, sizes, gram_owner = [], [], [], [], []
        for k, parts in enumerate(words):
            for word in parts:
                if (row := self.words.get(word)) is not None:
                    known.append(row)
                    owner.append(k)
                elif found := self.longest(word):
                    grams += found
                    sizes.append(len(found))
                    gram_owner.append(k)
        np.add.at(out, owner, self.word_logs[known])
        if grams:
            first = np.cumsum([0, *sizes[:-1]])
            np.add.at(out, gram_owner, np.add.reduceat(self.gram_logs[grams], first).astype(float) / np.array(sizes)[:, None])
        return out


def words_in(text: str) -> list[str]:
    """The runs of letters (with their marks) of a text, lower-cased; fitting and scoring both split with this."""
    bare = text.strip(".,;:!?()")
    if bare.isalpha():  # one word: no need to look for its ends
        return [unicodedata.normalize("NFC", bare).lower()]
    return [w for w in _NOT_LETTERS.split(unicodedata.normalize("NFC", text).lower()) if w]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(rows: DataFrame, features: Callable[[str], Iterable[str]]) -> DataFrame:
    """l, f, n: how often each feature of ``t`` stands in a language, ``n`` times each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text, n in zip(*(batch.column(c).to_pylist() for c in ("l", "t", "n")), strict=True):
                own = counts.setdefault(lang, Counter())
                for f in features(text):
                    own[f] += n
            for lang, own in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["l", "f", "n"])

    return rows.select("l", "t", F.col("n").cast("long").alias("n")).mapInArrow(run, "l string, f string, n long").groupBy("l", "f").agg(F.sum("n").alias("n"))


def _grams(word: str) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + k] for k in range(1, LONGEST + 1) for i in range(len(marked) - k + 1)]


def _logs(counts: pd.DataFrame, languages: tuple[str, ...], by_length: bool) -> tuple[dict[str, int], np.ndarray]:
    """Smoothed log frequencies of (l, f, n); those of n-grams among the n-grams of their length."""
    names = sorted(set(counts["f"]))
    at = {f: k for k, f in enumerate(names)}
    table = np.zeros((len(names), len(languages)))
    table[counts["f"].map(at).to_numpy(int), counts["l"].map(languages.index).to_numpy(int)] = counts["n"]
    size = np.array([len(f) if by_length else 0 for f in names], int)
    totals = np.zeros((LONGEST + 1, len(languages)))
    np.add.at(totals, size, table)
    number = np.bincount(size, minlength=LONGEST + 1)[:, None]
    return at, np.log((table + 0.5) / (totals[size] + 0.5 * number[size])).astype(np.float32)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from labelled rows that are not held out; one scan reads the sample of all languages."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).filter(F.col("l").isNotNull() & ~held_out(F.col("i")))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}  # one row a language
    languages = tuple(sorted(counts))
    if not languages:
        return Model((), {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    scale = 1 << 30
    share = F.lit(0)
    for lang in languages:
        share = F.when(F.col("l") == lang, min(scale, scale * per_language // counts[lang])).otherwise(share)
    sample = rows.filter(F.col("t").isNotNull() & (F.pmod(F.xxhash64("i", F.lit("fit")), F.lit(scale)) < share))
    words = written(_counted(sample.withColumn("n", F.lit(1)), words_in))
    grams = _counted(words.withColumnRenamed("f", "t"), _grams).toPandas()  # bounded by the sample, as are the words
    model = Model(languages, *_logs(words.toPandas(), languages, by_length=False), *_logs(grams, languages, by_length=True))
    discard(words)
    return model


class Scorer:
    """Scores of texts, with the scores of ``room`` recent words kept."""

    def __init__(self, model: Model, room: int = 400_000) -> None:
        self.model, self.room = model, room
        self.rows: dict[int, int] = {}
        self.scores = np.zeros((room, len(model.languages)))
        self.letters = np.zeros(room, bool)

    def _add(self, keys: list[int], raw: list[bytes]) -> None:
        at = len(self.rows)
        self.rows.update(zip(keys, range(at, at + len(keys)), strict=True))
        words = [words_in(x.decode("utf-8", "replace")) for x in raw]
        self.letters[at : at + len(keys)] = [any(ch.isalpha() for p in parts for ch in p) for parts in words]
        self.scores[at : at + len(keys)] = self.model.scores(words)

    def texts(self, column: pa.Array) -> tuple[list[str], list[float]]:
        data, off = textnp.utf8(column)
        start, end, first = textnp.word_spans(data, off)
        keys = textnp.span_hashes(data, start, end, False)
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(distinct) > self.room:
            self.scores, self.letters = np.zeros((len(distinct), self.scores.shape[1])), np.zeros(len(distinct), bool)
            self.rows, self.room = {}, len(distinct)
        if len(self.rows) + len(distinct) > self.room:
            self.rows = {}
        raw = data.tobytes()
        names = distinct.tolist()
        new = [i for i, k in enumerate(names) if k not in self.rows]
        self._add([names[i] for i in new], [raw[a:b] for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
        rows = np.array([self.rows[k] for k in names], np.int64)
        rows = rows[back] if len(rows) else rows
        doc = np.repeat(np.arange(len(column)), np.diff(first))
        n = len(column)
        total = np.stack([np.bincount(doc, self.scores[rows, j], n) for j in range(len(self.model.languages))], 1) if len(rows) else np.zeros((n, len(self.model.languages)))
        letters = np.bincount(doc, self.letters[rows], n) if len(rows) else np.zeros(n)
        names, scores = [], []
        for t, k in zip(total, letters, strict=True):
            if k:
                best = int(np.argmax(t))
                names.append(self.model.languages[best])
                scores.append(float(1 / np.exp((t - t[best]) / k).sum()))
            else:
                names.append("und")
                scores.append(0.0)
        return names, scores


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score (0 to 1) of every whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # of the size that the sample bounds
    rows = docs.select(F.col(id_col).alias("i"), held_out(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value.languages else None
        for batch in batches:
            for block in textnp.blocks(batch, "t"):
                names, scores = scorer.texts(block.column("t")) if scorer else (["und"] * block.num_rows, [0.0] * block.num_rows)
                yield pa.RecordBatch.from_arrays([block.column("i"), block.column("h"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["i", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"i {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("i", id_col)
