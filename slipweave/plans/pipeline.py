"""Images to results: scan, skip what is done, detect once, rebuild, write."""

from __future__ import annotations

import logging
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import DEFAULT, Settings
from ..functions.text import stem
from ..operators import quality, recognize, rows
from ..schemas import RESULT
from ..sources import files, sinks
from . import dataset
from .shared import exists, materialize

log = logging.getLogger(__name__)
TABLE, FOLDERS = "table", "folders"


def new_output_id() -> str:
    """An id that no file name gives: 32 hexadecimal digits."""
    return uuid.uuid4().hex


def place(chunk, phase, ordinal, size: int):
    """Column: order within a run, chunk by chunk, in each the failed images first."""
    return chunk * (2 * size) + phase * size + ordinal % size


def results(detections: DataFrame, output_dir: str, settings: Settings = DEFAULT, size: int | None = None, layout: str = TABLE) -> DataFrame:
    """DETECTIONS -> one result per file; failures carry 0 lines and no paths.

    A file is known by its place, as several may share an output_id."""
    at = place(F.col("chunk"), F.col("phase"), F.col("ordinal"), size or settings.max_images_per_call).alias("place")
    rows_ = detections.select("*", at)
    good, bad = rows_.where("error is null"), rows_.where("error is not null")
    cleaned = quality.clean(quality.explode_lines(good, "place"))
    rebuilt = rows.receipts(cleaned, "place", settings)
    if layout == FOLDERS:
        paths = sinks.output_paths(output_dir, F.col("output_id"))
    else:
        store = F.lit(f"{output_dir}/texts")
        paths = F.create_map(F.lit("raw_json"), store, F.lit("text"), store)
    done = quality.with_status(
        good.join(rebuilt, "place", "left")
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("num_lines", F.coalesce("num_lines", F.lit(0)))
        .withColumn("avg_confidence", F.coalesce("avg_confidence", F.lit(0.0))),
        settings,
    ).withColumn("raw", sinks.raw_payload(F.col("path"), F.col("preprocessing"), quality.kept_lines(F.col("text_lines"))))
    done = done.withColumn("output_paths", paths)
    failed = bad.select(
        "*", F.lit(0).alias("num_lines"), F.lit(0.0).alias("avg_confidence"), F.lit(quality.ERROR).alias("status"),
        F.lit("").alias("text"), F.lit(None).cast("string").alias("raw"),
        F.create_map().cast("map<string,string>").alias("output_paths"),
    )
    keep = [
        "chunk", "phase", "ordinal", "place", F.col("path").alias("file"), "output_id", "status", "text", "num_lines",
        "avg_confidence", "error", "duration_s", "peak_memory", "raw", "output_paths",
    ]
    return done.select(*keep).unionByName(failed.select(*keep))


@dataclass
class Run:
    """What a batch did: one result per processed file, and how many were done before."""

    results: DataFrame | None
    found: int
    skipped: int


def _next_run(spark: SparkSession, output_dir: str) -> int:
    path = f"{output_dir}/manifest.jsonl"
    if not exists(spark, path):
        return 0
    return (files.manifest(spark, path).agg(F.coalesce(F.max("run"), F.lit(-1))).first()[0]) + 1


def _save(spark: SparkSession, out: DataFrame, output_dir: str, layout: str) -> None:
    """Texts first, then the manifest: a run that is cut off between the two is done again."""
    out = out.withColumn("run", F.lit(_next_run(spark, output_dir)).cast("long"))
    done = out.where(F.col("status") != quality.ERROR).select("output_id", "text", "raw", "run", "place")
    done.write.mode("append").parquet(f"{output_dir}/texts")
    if layout == FOLDERS:
        sinks.export_folders(files.latest(done), output_dir)
    sinks.append_manifest(out.orderBy("place"), f"{output_dir}/manifest.jsonl")


def process(
    spark: SparkSession, input_path: str, output_dir: str, make_model=recognize.TextRecognizer, make_preprocessor=recognize.TextPreprocessor,
    overwrite: bool = False, settings: Settings = DEFAULT, max_images_per_call: int | None = None, layout: str = TABLE,
    unique_ids: bool = False, output_id: str | None = None,
) -> Run:
    """Runs a batch; detections are written before the sinks read them, so the model
    runs once. Of files that share an id the last one's text counts, as with a later
    run's; each has its line in the manifest. `output_id` names the result of a
    single file."""
    output_dir = output_dir.rstrip("/")
    found = files.images(spark, input_path)
    total = found.count()
    if output_id:
        if total != 1:
            raise ValueError("an output id names one file")
        found = found.withColumn("output_id", F.lit(output_id))
    earlier = files.stored(spark, output_dir)
    if earlier is not None:
        found = dataset.todo(found, earlier.select("output_id").distinct(), overwrite)
    todo = found.count()
    if unique_ids:
        sinks.fail_on_collisions(found.select("output_id"))
    size = (max_images_per_call or settings.max_images_per_call) if todo > 1 else 1
    if size == 0:
        raise ValueError("a chunk needs at least one image")
    if not todo or size < 0:
        return Run(None, todo, total - todo)
    detections = materialize(recognize.detect(found, make_model, make_preprocessor, settings, size), "detections")
    out = materialize(results(detections, output_dir, settings, size, layout), "results")
    _save(spark, out, output_dir, layout)
    return Run(out, todo, total - todo)


def process_image(spark: SparkSession, path: str, output_dir: str, output_id: str | None = None, **options) -> dict:
    """One image, done whether or not its id is; every failure, of writing too, is an
    error result. Returns the fields of RESULT."""
    names, began = [f.name for f in RESULT], time.monotonic()
    try:
        run = process(spark, path, output_dir, overwrite=True, output_id=output_id, **options)
        found = run.results.withColumn("source_path", F.col("file")).select(*names).first()
        return found.asDict()
    except Exception as e:
        log.exception("failed to process %s", path)
        name = output_id or spark.range(1).select(stem(F.lit(path))).first()[0]
        took = time.monotonic() - began
        failed = spark.createDataFrame(
            [(path, name, quality.ERROR, 0, 0.0, str(e), took, 0)],
            "file string, output_id string, status string, num_lines int, avg_confidence double, error string, duration_s double, place long",
        )
        base = output_dir.rstrip("/")
        sinks.append_manifest(failed.withColumn("run", F.lit(_next_run(spark, base)).cast("long")), f"{base}/manifest.jsonl")
        return dict(zip(names, (name, path, quality.ERROR, "", 0, 0.0, str(e), took, {})))
