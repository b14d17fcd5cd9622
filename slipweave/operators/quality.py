"""Fragment cleaning, receipt statistics and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import DEFAULT, Settings
from ..functions.text import strip

OK, EMPTY, LOW, ERROR = "ok", "empty", "low_confidence", "error"


def clean(fragments: DataFrame) -> DataFrame:
    """Strip texts, drop blank ones, read a null confidence as 0 (NaN stays)."""
    return (
        fragments.withColumn("text", strip(F.col("text")))
        .where(F.col("text") != "")
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    )


def kept_lines(lines: Column) -> Column:
    """clean() of a list of model lines, as the raw payload holds them."""
    kept = F.transform(lines, lambda x: F.struct(strip(x["text"]).alias("text"), x["bbox"].alias("bbox"), F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence")))
    return F.filter(kept, lambda x: x["text"] != "")


def explode_lines(detections: DataFrame, key: str = "output_id") -> DataFrame:
    """Model output to one row per line; the list position becomes `seq`."""
    line = F.col("line")
    box = line["bbox"]
    return detections.select(key, F.posexplode("text_lines").alias("seq", "line")).select(
        key, "seq", line["text"].alias("text"),
        *[F.element_at(box, i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"), 1)],
        line["confidence"].alias("confidence"),
    )


def status(num_lines: Column, avg_confidence: Column, settings: Settings = DEFAULT) -> Column:
    """Compared unrounded and strictly; a NaN average counts as ok."""
    return (
        F.when(num_lines == 0, EMPTY)
        .when(avg_confidence < settings.low_confidence, LOW)
        .otherwise(OK)
    )


def stats(receipts: DataFrame, cleaned: DataFrame, key: str = "receipt_id") -> DataFrame:
    """num_lines counts fragments; receipts without any get 0 and 0.0."""
    per = cleaned.groupBy(key).agg(F.count("*").alias("n"), F.avg("confidence").alias("a"))
    return receipts.select(key).join(per, key, "left").select(
        key,
        F.coalesce("n", F.lit(0)).cast("int").alias("num_lines"),
        F.coalesce("a", F.lit(0.0)).alias("avg_confidence"),
    )


def with_status(frame: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return frame.withColumn("status", status(F.col("num_lines"), F.col("avg_confidence"), settings))
