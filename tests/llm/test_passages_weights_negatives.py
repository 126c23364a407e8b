"""Substring dedup, importance resampling and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, rows_of, rows_of_sql
from pyspark.sql import functions as F

from terrane.llm import hard_negatives, importance, passages
from terrane.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op13_hard_negatives"])
def test_queries_match_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), ORACLE[name])


# ---- substring dedup

def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def kept_words(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, None if t is None else " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "gathered", "part"), [(13, 1 << 20, 1 << 24), (13, 50, 2000), (8, 200, 4000), (20, 1 << 20, 900)])
def test_passages_match_brute_force(spark, monkeypatch, window, gathered, part):
    monkeypatch.setattr(passages, "GATHERED", gathered)
    monkeypatch.setattr(passages, "PART_BYTES", part)
    rng = random.Random(window + gathered)
    shared = [[f"s{rng.randrange(30)}" for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) - 1)
            w += p[a : a + rng.randint(1, 60)] + [f"u{rng.randrange(9)}" for _ in range(rng.randint(0, 9))]
        rows.append((rng.randint(0, 100), rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    rows += [(7, "a " * 3000), (8, "b" + " a" * 2000), (5, None), (6, ""), (9, " \n "), (None, rows[0][1]), (None, None), (101, "É é" * 9), rows[3], rows[3]]
    df = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, __row long, words string").repartition(5)
    got = passages.dedup_passages(df, window=window)
    assert got.columns == [*df.columns, "__n_words", "__n_removed"]
    assert sorted(((r["doc_id"], r["text"], r["__n_words"], r["__n_removed"]) for r in got.collect()), key=repr) == kept_words(rows, window)


def test_passages_edges(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert passages.dedup_passages(df.limit(0)).count() == 0
    with pytest.raises(TypeError, match="integers"):
        passages.dedup_passages(df.withColumn("doc_id", F.lit("a")))
    with pytest.raises(ValueError, match="window"):
        passages.dedup_passages(df, window=7)
    ints = spark.createDataFrame([(2, "w " * 13), (1, "w " * 14)], "doc_id int, text string")
    assert sorted((r["doc_id"], r["__n_removed"]) for r in passages.dedup_passages(ints).collect()) == [(1, 0), (2, 13)]


def test_cover_meets_every_pair_of_places():
    meets = lambda i, j: any((i + s) % passages.PERIOD in passages.COVER and (j + s) % passages.PERIOD in passages.COVER for s in range(passages.PERIOD))
    assert all(meets(i, j) for i in range(passages.PERIOD) for j in range(passages.PERIOD))


# ---- importance resampling

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def feature_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWERED))


def buckets_of(t, n):
    w = feature_words(t)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target, n, least, percent):
    s, t = np.zeros(n), np.zeros(n)
    for _, x in docs:
        for b in buckets_of(x, n):
            s[b] += 1
    for x in target:
        for b in buckets_of(x, n):
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + n) / ((a + 1) * (t.sum() + n)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, x in docs:
        own = buckets_of(x, n)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(feature_words(x))])
    some = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(some[: percent * len(some) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_crcs_match_zlib():
    texts = ["", None, "a", "Ab-cd e9_f", "é ü x", "z" * 70 + " " + "y" * 5000 + " q", "x " * 300, "\x00a\x7fb", "日本語 テキスト" * 3]
    bucket, text, n_words = importance.features(pa.array(texts), 1 << 31)
    for k, t in enumerate(texts):
        assert sorted(bucket[text == k].tolist()) == sorted(b % (1 << 31) for b in buckets_of(t, 1 << 31)) and n_words[k] == len(feature_words(t))


@pytest.mark.parametrize("buckets", [10_000, 7])
def test_resampling_matches_brute_force(spark, buckets):
    rng = random.Random(buckets)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "Straße", "x1"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(40)] + [(300, None), (301, ""), (302, "..."), (None, docs[0][1]), (303, "q" * 3000 + " r" * 40)]
    target = [" ".join(rng.choices(vocabulary[:10], k=30)) for _ in range(5)] + [None, ""]
    df = spark.createDataFrame([(i, t, 1, b"k") for i, t in docs], "doc_id long, text string, m int, __none binary").repartition(3)
    out = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), buckets=buckets, percent=30)
    assert out.columns == [*df.columns, "__n_features", "__weight", "__score", "__rank"]
    got = sorted(((r["doc_id"], r["__n_features"], r["__weight"], r["__score"], r["__rank"]) for r in out.collect()), key=repr)
    assert got == resampled(docs, target, buckets, 20, 30)


def test_resampling_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b " * 20)] * 6 + [(2, "c d " * 20)] * 4, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    ranks = sorted(r["__rank"] for r in importance.resample(df, none, percent=50).collect() if r["__rank"])
    assert ranks == [1, 2, 3, 4, 5]
    assert importance.resample(df.limit(0), none).count() == 0


def test_resampling_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_importance_resampling"](spark, sf_dir).collect()), key=repr)
    assert got == resampled(docs, target, 10_000, 20, 5)


# ---- hard negatives

def mined(rows, is_anchor, n_pos=5, n_neg=10):
    good = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, y, v in good:
        if not is_anchor(i):
            continue
        others = sorted(((score(v, w), -j, z) for j, z, w in good if j != i), reverse=True)
        for ps, j, _ in [x for x in others if x[2] == y][:n_pos]:
            fits = [x for x in others if x[2] != y and 30 * ps <= 100 * x[0] <= 90 * ps][:n_neg]
            out += [(i, -j, k + 1, -x[1], ps, x[0]) for k, x in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("list_rows", "query_rows", "first"), [(4096, 1024, 32), (6, 4, 2)])
def test_negatives_match_brute_force(spark, monkeypatch, list_rows, query_rows, first):
    for name, v in (("LIST_ROWS", list_rows), ("QUERY_ROWS", query_rows), ("FIRST_LISTS", first)):
        monkeypatch.setattr(hard_negatives, name, v)
    rng = np.random.default_rng(list_rows)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(0, 4)), (centres[i % 6] + 0.4 * rng.normal(size=8)).round(1).tolist()) for i in range(300)]
    rows += [(400 + i, i % 4, rows[0][2]) for i in range(60)]  # ties
    rows += [(0, 1, rows[9][2]), rows[10], rows[10], (10, rows[10][1], rows[11][2]), (None, 1, rows[0][2]), (501, None, rows[0][2]), (502, 1, None), (503, 1, [1.0, None]), (504, 1, [float("nan"), 1.0]), (505, 1, [float("inf")]), (506, 2, [1.5, 2.0]), (507, 2, []), (520, 3, [0.0] * 8)]
    df = spark.createDataFrame([(i, y, v, 0, "q") for i, y, v in rows], "vec_id long, label int, embedding array<double>, list int, qid string").repartition(4)
    got = hard_negatives.mine(df, anchors=F.col("id") % 10 == 0, sample_rows=100)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 10 == 0)


def test_negatives_edges(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, 1, None), (2, None, [1.0])], schema)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, 1, [1.0])], schema)).count() == 0
    wide = "vec_id long, label int, embedding array<double>"
    rows = [(i, i % 2, [float((i * 37 % 11) * 2**19 + i), 1.0]) for i in range(24)]  # scores beyond 2^53
    assert sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, wide)).collect())) == mined(rows, lambda i: True)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.mine(spark.createDataFrame([(1, 1, [1e300])], wide))


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(3)
    centres = np.rint(rng.normal(size=(5, 6)) * 300)
    rows = np.rint(np.repeat(centres, 40, 0) + rng.normal(size=(200, 6)) * 10)
    own = hard_negatives.nearest(rows, centres)
    radius = np.array([np.sqrt(((rows[own == c] - centres[c]) ** 2).sum(1).max()) for c in range(5)])
    upper, lower = hard_negatives.bounds_of(rows[:20], centres, radius)
    s = rows[:20] @ rows.T
    assert all(upper[a, own[b]] >= s[a, b] >= lower[a, own[b]] for a in range(20) for b in range(200))
    best = np.sort(s, 1)[:, -5]
    assert (upper >= best[:, None]).mean() < 0.6  # most lists are left out
