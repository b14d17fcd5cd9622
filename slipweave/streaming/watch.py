"""Extension: new images in a folder as a stream; the checkpoint replaces skip-if-done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..conf import DEFAULT, Settings
from ..functions.text import stem
from ..operators import recognize
from ..plans import pipeline
from ..plans.shared import discard, materialize
from ..schemas import BINARY_FILE
from ..sources.files import _local, supported


def watch(
    spark: SparkSession, input_dir: str, output_dir: str, checkpoint: str, make_model=recognize.TextRecognizer,
    make_preprocessor=recognize.TextPreprocessor, settings: Settings = DEFAULT, once: bool = True,
) -> StreamingQuery:
    """Each batch's detections are written first, so the model runs once however many
    branches read them. Files of zero bytes are not seen by Spark's file source."""
    found = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(input_dir)
    found = supported(found).withColumn("output_id", stem(F.col("path"))).select("path", "output_id")

    def read(path: str) -> bytes:
        return recognize.read_bytes(_local(path))

    def save(batch: DataFrame, batch_id: int) -> None:
        # The batch id is in the path: a replayed batch overwrites itself.
        detections = materialize(recognize.detect(batch, make_model, make_preprocessor, settings, read=read), "detections")
        results = materialize(pipeline.results(detections, output_dir, settings), "results")
        results.select("output_id", "status", "text", "raw", F.lit(batch_id).cast("long").alias("run"), "place").write.mode("overwrite").parquet(f"{output_dir}/texts/batch={batch_id}")
        results.select("output_id", "status", "place").write.mode("overwrite").json(f"{output_dir}/manifest/batch={batch_id}")
        discard(detections, results)

    writer = found.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
