import re

import numpy as np
import pyarrow as pa
import pytest

from terrane.llm import line_dedup, near_dups, textnp


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


def make(seed, n=120, length=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, base = [], [vocabulary[k] for k in rng.integers(0, 400, length)]
    for i in range(n):
        t = list(base) if i % 3 else [vocabulary[k] for k in rng.integers(0, 400, length)]
        if i % 3 == 1:
            for k in rng.integers(0, length, rng.integers(0, 4)):
                t[k] = f"x{i}{k}"
        rows.append((i, " ".join(t) if i % 2 else " ".join(t).upper().lower()))
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rows = make(5) + [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (905, "a b c"), (906, "q " * 3000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n string")
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(df).collect()}
    want = components(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(shingles(t)) and got[i]["kept"] == (want[i] == i) for i, t in rows)


def test_nulls_repeats_and_empty(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (1, t), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, None, True), (3, 1, False), (3, 1, False), (1, 1, True), (None, None, True)], key=repr)
    assert near_dups.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r["doc_id"] or -1 for r in near_dups.drop_near_duplicates(df).collect()) == [-1, -1, 1]


def components_of_rows(rows, percent):
    """Smallest id reachable from each row, over links of texts and of equal ids."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and (rows[a][0] == rows[b][0] or 100 * len(x & y) >= percent * len(x | y)):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a in range(len(rows)):
        least[find(a)] = min(least.get(find(a), rows[a][0]), rows[a][0])
    return sorted((i, len(sets[a]), least[find(a)] if sets[a] else i) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("percent", "block"), [(85, 1024), (80, 5)])
def test_repeated_ids_lose_no_link(spark, monkeypatch, percent, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    a, b = ([f"{k}{i}" for i in range(40)] for k in "ab")
    rows = [(5, a), (5, b), (7, [*a[:-1], "x"]), (9, [*b[:-1], "x"]), (2, [*b[:-1], "y"]), (7, ["q"] * 8), (3, ["q"] * 9), (4, []), (4, a[:7])]
    rows = [(i, " ".join(t)) for i, t in rows]
    rng = np.random.default_rng(percent)
    rows += [(int(rng.integers(20, 60)), t) for _, t in make(percent, 90, 50)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id int, text string").repartition(3)
        options = {"percent": percent} | ({"slack": 0.58, "bands": 32} if percent == 80 else {})
        got = near_dups.near_duplicates(df, **options).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components_of_rows(rows, percent)
    with pytest.raises(TypeError, match="integers"):
        near_dups.near_duplicates(df.selectExpr("concat('d', doc_id) AS doc_id", "text"))


def test_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(200):
        both = rng.integers(0, 1 << 63, 850, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 75, dtype=np.uint64)])) for _ in range(2))
        x, y = near_dups.minhashes(a), near_dups.minhashes(b)
        ones = int(np.bitwise_count((near_dups.odd_sketch(x) ^ near_dups.odd_sketch(y)).view(np.uint64)).sum())
        missed += ones > near_dups.most_bits() or not (near_dups.band_keys(x) == near_dups.band_keys(y)).any()
    assert missed == 0


def test_shingle_sets_by_words():
    texts = ["", "a", "a b c d", "a b c d e f", " x\ty\nz ", "É é", "long " * 5000]
    sets = list(textnp.shingle_sets(*textnp.utf8(pa.array(texts))))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]


def all_lines(rows, least=1):
    """Lines go if any earlier line is similar, whether or not that line stayed."""
    seen, out = [], {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        kept = []
        for line in (t or "").split("\n"):
            s = set(words(line))
            gone = len(s) >= least and any(5 * len(s & o) >= 4 * len(s | o) for o in seen)
            if len(s) >= least:
                seen.append(s)
            if not gone:
                kept.append(line)
        out[i] = None if t is None else "\n".join(kept)
    return out


def test_lines_match_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.integers(1, 6)):
            base = [f"b{k}" for k in range(rng.integers(2, 14))] if rng.random() < 0.6 else [f"w{k}" for k in rng.integers(0, 50, rng.integers(1, 20))]
            if rng.random() < 0.5:
                base[rng.integers(0, len(base))] = f"u{i}"
            lines.append(" ".join(base))
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n \n"), (503, "the the the"), (None, rows[0][1])]
    df = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, line int, gone string")
    got = line_dedup.dedup_lines(df)
    assert got.columns[:4] == df.columns
    by_id = {r["doc_id"]: r["text"] for r in got.collect()}
    want = all_lines(rows)
    assert {i: t for i, t in by_id.items() if i is not None} == want and by_id[None] == rows[0][1]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_on_both_sides_of_the_narrow_parity(spark):
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[a:b]) for a, b in ((0, 64), (0, 65), (0, 70), (3, 70), (0, 90), (80, 144), (80, 160))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(t.split()) for t in texts]
    want = [any(9 * len(a & b) >= 4 * (len(a) + len(b)) for b in sets[:k]) for k, a in enumerate(sets)]
    got = {r["doc_id"]: r["__n_removed"] for r in line_dedup.dedup_lines(df).collect()}
    assert [got[k] for k in range(len(texts))] == [int(w) for w in want]
    lines = line_dedup.lines_of(df, "doc_id", "text")
    assert all((r["s1"] == 0) == (r["n"] <= line_dedup.NARROW) for r in line_dedup.sketched(lines, line_dedup.rarity(df, "text")).collect())


def test_sets_of_one_place_and_parity_are_both_verified(spark):
    """Rows of one id hold two sets with the same size and parity at one place; only one is similar to an earlier line."""
    bits = spark.range(4000).selectExpr("concat('v', id) AS w").selectExpr("w", "shiftrightunsigned(xxhash64(w), 8) & 63 AS b").collect()
    by_bit = {}
    for r in bits:
        by_bit.setdefault(r["b"], []).append(r["w"])
    rows = []
    for k in range(8):  # which of the two comes first differs
        twins = [by_bit[b][2 * k : 2 * k + 2] for b in range(9)]
        first = [w for w, _ in twins]
        near, far = first[:8] + [twins[8][1]], first[:6] + [w for _, w in twins[6:]]
        pair = [(100 + k, " ".join(near)), (100 + k, " ".join(far))]
        rows += [(k, " ".join(first)), *(pair if k % 2 else pair[::-1])]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["__n_removed"]} == set(range(100, 108))
