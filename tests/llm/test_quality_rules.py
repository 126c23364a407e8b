import pytest
from oracle import connect, rows_of, rows_of_sql

from terrane.llm import quality_rules
from terrane.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), ORACLE[name])


def brute(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "a", "one two three four", "a b c d e a b c d e", "x " * 40, "é ß #1 |\nsame\nsame\n\n \nsame", "the of and to in " * 3 + "end\x0bhere\rnow\x0cdone", "  no break \U0001f600"]


def test_counts(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(0, None, "y", 2), (None, "hello there", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = quality_rules.quality(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "hello there"
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(text)


def test_keep_good_keeps_columns(spark):
    good = "The river of the valley is wide and it was in the map that was on this wall."
    df = spark.createDataFrame([(1, good, "a"), (2, "### | $$ " * 9, "b"), (3, None, "c")], "doc_id long, text string, n_words string")
    out = quality_rules.keep_good(df)
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [1]
    assert quality_rules.keep_good(df.limit(0)).count() == 0


def test_plan_is_native(spark, sf_dir):
    plan = QUERIES["op3_quality_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
