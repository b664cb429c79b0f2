"""The training-data pipeline: toxicity, line dedup, near duplicates, packing.

Part of the helixframe.llm subpackage.  Every stage takes all documents that its
predecessor kept; all but the last return the columns of ``documents``, extra ones included.
Each stage is given a table of its own, so what earlier stages left in the shared folder is
deleted when it begins.

Null and empty texts are clean, have one empty line, are no near duplicates of anything and are
packed as the end mark alone.  Rows that repeat an id are judged one by one by every stage; of rows
equal in all columns near_duplicates keeps one.  Null ids are kept.  An empty table gives an empty
table.  Columns of the input may bear any name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import jaccard_join, line_dedup, packing, toxicity
from helixframe.llm.common import clash_free, drop_all_stored, new_path, read_table, tuned


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half stay."""
    drop_all_stored(spark)
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    score = clash_free(docs) + "toxicity"
    scored = toxicity.classify(docs, labels, F.lit(True), score_column=score)
    return scored.filter(F.col(score) < 0.5).drop(score)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more that an earlier document holds are dropped; all documents stay."""
    drop_all_stored(tuned(spark))
    out = line_dedup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles of a similarity of 0.8 or more stays."""
    drop_all_stored(tuned(spark))
    return jaccard_join.keep_one_per_group(docs, size=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces and their places in sequences of 2048 tokens."""
    drop_all_stored(tuned(spark))
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained classifier or the tokenizer; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
