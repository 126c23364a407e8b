"""The pipeline's stages against brute force at the whole of their contracts."""

from math import comb

import numpy as np
from test_dedup import all_lines, shingles

import corpus_pipeline as cp
from terrane.llm import near_dups as nd
from terrane.llm.queries import QUERIES


def components_at(rows, percent):
    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


def test_near_stage_links_from_80(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        base = [f"w{v}" for v in rng.integers(0, 5000, 100)]
        changed = list(base)
        for place in (20, 60)[: 1 + k % 2]:  # a changed word takes five shingles: similarities of 0.90 and 0.81
            changed[place] = f"x{k}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(changed))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in cp.one_of_each_group(spark, df, "").collect()}
    want = {p: {i for i, c in components_at(rows, p).items() if i == c} for p in (80, 85)}
    assert kept == want[80] and len(want[80]) == 60 and len(want[85]) == 90


def test_lines_of_one_and_two_words_take_part(spark, tmp_path):
    rows = [(1, "Yes.\nno no no\nred green\na b c\na b c d"), (2, "yes.\nno\ngreen red red\na b\na b c d e"), (3, "Yes."), (4, " \nYes.\nblue"), (5, "a b\n\tblue "), (6, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    want = all_lines(rows)
    assert {i: t for i, (t, _) in got.items()} == want
    assert {i: n for i, (_, n) in got.items()} == {1: 0, 2: 3, 3: 1, 4: 1, 5: 2, 6: 0, 7: 0}
    staged = {r["doc_id"]: r["text"] for r in cp.without_later_lines(spark, docs, "").collect()}
    assert staged == {i: t for i, t in want.items() if i not in (3, 5)}


def missed_by_sketches(similarity, slack):
    """Chance that the odd sketches of a pair differ in too many bits: each differing sample flips two random ones."""
    ones, at = np.zeros(nd.BITS + 1), np.arange(nd.BITS + 1)
    ones[0], after = 1, []
    for _ in range(2 * nd.SAMPLES + 1):
        after.append(ones[nd.most_bits(slack) + 1 :].sum())
        moved = np.zeros_like(ones)
        moved[1:] += ones[:-1] * (nd.BITS - at[:-1]) / nd.BITS
        moved[:-1] += ones[1:] * at[1:] / nd.BITS
        ones = moved
    n = nd.SAMPLES
    return sum(comb(n, k) * (1 - similarity) ** k * similarity ** (n - k) * after[2 * k] for k in range(n + 1))


def test_sketches_miss_less_than_bands():
    assert missed_by_sketches(0.85, nd.SLACK) < (1 - 0.85**nd.ROWS) ** nd.BANDS
    assert missed_by_sketches(0.8, cp.NEAR_SLACK) < (1 - 0.8**nd.ROWS) ** cp.NEAR_BANDS < 1e-5
