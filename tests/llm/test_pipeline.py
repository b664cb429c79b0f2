"""Each stage of the pipeline against a plain version on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from .test_jaccard_join import brute as groups
from .test_line_dedup import brute as kept_lines
from .test_packing import ids

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_duplicates", "packing"]
    clean = stages["toxicity"](spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lost = docs.join(clean, "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.filter("toxic = 0").count() == 0
    assert clean.join(labels.filter("toxic = 1"), "doc_id", "left_semi").count() <= 1
    lines = stages["line_dedup"](spark, clean, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    want = kept_lines(rows)
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {i: t for i, (_, _, t) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    one = stages["near_duplicates"](spark, lines, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in lines.collect()]
    assert {r["doc_id"] for r in one.collect()} == {c for _, c in groups(rows, 5, 80).values()}
    assert clean.columns == lines.columns == one.columns == columns
    packed = stages["packing"](spark, one, SF)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(ids(r["text"])) for r in one.collect())


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert got.count() > 100
