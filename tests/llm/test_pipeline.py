"""The pipeline against brute force, stage by stage on each stage's own input."""

import corpus_pipeline as P
import public_tokenizers
import sentencepiece

from slipweave.llm import decontaminate, quality
from slipweave.llm.queries import QUERIES
from tests.llm.test_similar_texts import brute_components
from tests.llm.test_suffix import brute as brute_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    docs = P.materialize(P.STAGES[0][1](spark, docs, SF), "t")
    assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} == {i for i, s in scores.items() if s >= P.REJECT_BELOW}

    rows = {r.doc_id: r.text for r in docs.collect()}
    groups = brute_components(rows, P.SIMILAR)
    docs = P.materialize(P.STAGES[1][1](spark, docs, SF), "t")
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(i for i, g in groups.items() if i == g)

    want = brute_spans(sorted((r.doc_id, r.text) for r in docs.collect()))
    docs = P.materialize(P.STAGES[2][1](spark, docs, SF), "t")
    got = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(got) == set(want)
    for i, (n, gone, _, _) in want.items():
        left = len(got[i].text.encode())
        assert n - gone - 6 <= left <= n - gone and got[i].n_chars == len(got[i].text)

    index = decontaminate.Passages([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    clean = {i for i, r in got.items() if not any(decontaminate.normalize(p) in decontaminate.normalize(r.text) for p in [r2.text for r2 in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]) and not index.search(r.text)}
    docs = P.materialize(P.STAGES[3][1](spark, docs, SF), "t")
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == clean

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = {r.doc_id: r for r in P.STAGES[4][1](spark, docs, SF).collect()}
    assert {i: r.n_pieces for i, r in last.items()} == {i: len(lib.encode(got[i].text)) for i in clean}
    assert all(r.decoded_equal for r in last.values())
    whole = {r.doc_id: r.ids_crc32 for r in QUERIES["pipeline"](spark, SF).collect()}
    assert whole == {i: r.ids_crc32 for i, r in last.items()}
