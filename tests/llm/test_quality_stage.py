"""The pipeline's threshold on the labelled rows it was chosen from."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from slipweave.llm import quality

SF = "/root/testdata/sf0.001"


def test_threshold_separates_labels_outside_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~quality.held_out(F.col("doc_id")))
    kept = {r.doc_id for r in P.quality_classifier(spark, docs, SF).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert 0 in known.values() and 1 in known.values()
    assert {i for i in known if i in kept} == {i for i, q in known.items() if q == 1}
