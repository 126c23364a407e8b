"""The corpus pipeline: stages over ``documents``, each written and read again.

Quality rules drop poor documents; line dedup removes later matches of lines, and a
document all of whose lines went; near-duplicate groups keep their smallest id;
documents that hold a benchmark item go; the rest is segmented into pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, line_dedup, near_dups, quality_rules, sentencepiece_lattice
from terrane.llm.queries import TOKENIZERS
from terrane.plans.storage import written

#: Near copies go from a Jaccard similarity of 0.8 on. Of pairs at 0.8, 3e-6 share none of 32
#: bands and 6e-8 fail the sketch check at a slack of 0.58.
NEAR_PERCENT, NEAR_SLACK, NEAR_BANDS = 80, 0.58, 32


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the threshold table."""
    return quality_rules.keep_good(docs)


def without_later_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later matches; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    out = out.filter((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_lines")))
    length = F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.drop_near_duplicates(docs, percent=NEAR_PERCENT, slack=NEAR_SLACK, bands=NEAR_BANDS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, score, the next best score, and whether decoding gives the text back."""
    coded = sentencepiece_lattice.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return coded.select("doc_id", "ids", "score", F.get("others", 0)["score"].alias("second_score"), "restored")


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", without_later_lines),
    ("near_dups", one_of_each_group),
    ("decontamination", without_benchmark),
    ("sentencepiece", segmented),
]

#: SQL has no form of the MinHash, tiling and lattice stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
