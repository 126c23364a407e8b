import sys
from pathlib import Path

from terrane.llm import quality_rules

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_stages(spark, sf_dir):
    import corpus_pipeline as cp
    from test_dedup import all_lines, components, words

    from terrane.plans.storage import written

    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dups", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    texts = {}
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(spark, docs, sf_dir))
        if name == "sentencepiece":
            assert all(r["restored"] for r in docs.collect()) and docs.count() == len(before)
            continue
        assert docs.columns == columns
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            full = spark.read.parquet(f"{sf_dir}/documents.parquet")
            assert set(texts) == {r["doc_id"] for r in quality_rules.quality(full).filter("kept").collect()}
        if name == "line_dedup":
            want = all_lines(before.items())
            assert texts == {i: t for i, t in want.items() if t == before[i] or words(t)}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if before[r["doc_id"]] != r["text"])
        if name == "near_dups":
            assert set(texts) == {i for i, c in components(list(before.items())).items() if i == c}
