"""Training dataset and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_failed(manifest: DataFrame) -> DataFrame:
    """A missing status passes, so the comparison must be null-safe."""
    return manifest.where(~F.col("status").eqNullSafe("error"))


def build(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """One record per surviving manifest line with a text; duplicates stay. `texts` has
    each id once."""
    return not_failed(manifest).select("pos", "output_id").join(texts, "output_id").select("pos", "output_id", F.col("text").alias("input"))


def build_from_listing(texts: DataFrame) -> DataFrame:
    """Without a manifest: every text; sorting by output_id gives the order."""
    return texts.select(F.col("output_id").alias("pos"), "output_id", F.col("text").alias("input"))


def todo(inputs: DataFrame, done: DataFrame, overwrite: bool = False) -> DataFrame:
    """Inputs whose id has no text yet; all of them when overwriting."""
    return inputs if overwrite else inputs.join(done.select("output_id"), "output_id", "left_anti")


def union_results(failed: DataFrame, processed: DataFrame) -> DataFrame:
    """Per chunk the failures come first: order by (chunk, phase, ordinal)."""
    return failed.withColumn("phase", F.lit(0)).unionByName(processed.withColumn("phase", F.lit(1)))


def summary(results: DataFrame) -> DataFrame:
    """succeeded counts everything that is not an error."""
    bad = F.col("status").eqNullSafe("error")
    return results.agg(
        F.count("*").alias("total"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"),
    )


def skipped(inputs: DataFrame, remaining: DataFrame) -> DataFrame:
    """(found, todo, skipped): how many inputs there are, are left and were done before."""
    left = remaining.agg(F.count("*").alias("todo"))
    return inputs.agg(F.count("*").alias("found")).join(left, F.lit(True)).withColumn("skipped", F.col("found") - F.col("todo"))
