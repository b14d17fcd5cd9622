"""Training-corpus pipeline: five stages over documents.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
is written as Parquet and read back before the next one. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slipweave.llm import decontaminate, pieces, quality, simhash, suffix
from slipweave.plans.shared import materialize
from slipweave.sources.files import table

#: Documents scoring less are rejected: the boundary of balanced training, and the best separation of labelled rows
#: outside the held-out fold.
REJECT_BELOW = 0.5
#: Near copies: five-word shingles, Jaccard similarity of at least four fifths.
WORDS, SIMILAR = 5, (4, 5)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on labelled rows outside the held-out fold; drops documents below REJECT_BELOW."""
    net = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, net, REJECT_BELOW)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group; of rows that
    repeat a doc_id every one stays, and so do rows without one."""
    groups = simhash.similar_texts(docs, WORDS, SIMILAR)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out bytes covered by 100-byte strings that start earlier."""
    return suffix.clean(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids and reports both."""
    import public_tokenizers

    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Hash majorities, networks and tokenizers are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
