"""Sinks: raw payloads, texts, the manifest and the dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rounded


def result_dir(output_dir: Column, output_id: Column) -> Column:
    return F.concat_ws("/", output_dir, output_id)


def output_paths(output_dir: str, output_id: Column) -> Column:
    """Where export_folders() puts a receipt's files."""
    base = result_dir(F.lit(output_dir), output_id)
    return F.create_map(F.lit("raw_json"), F.concat(base, F.lit("/raw.json")), F.lit("text"), F.concat(base, F.lit("/text.txt")))


def raw_payload(source: Column, preprocessing: Column, lines: Column) -> Column:
    """The audit record as JSON; nulls are written, as the format requires."""
    record = F.struct(source.alias("source_image"), preprocessing.alias("preprocessing"), lines.alias("text_lines"))
    return F.to_json(record, {"ignoreNullFields": "false"})


def manifest_entry(frame: DataFrame) -> DataFrame:
    return frame.select(
        "file", "output_id", "status", "num_lines", rounded(F.col("avg_confidence"), 4).alias("avg_confidence"),
        "error", rounded(F.col("duration_s"), 3).alias("duration_s"), *[c for c in ("run", "place") if c in frame.columns],
    )


def append_manifest(entries: DataFrame, path: str) -> None:
    manifest_entry(entries).write.mode("append").option("ignoreNullFields", "false").json(path)


def fail_on_collisions(frame: DataFrame, key: str = "output_id") -> DataFrame:
    """For callers who would rather stop than let a later file replace an earlier one."""
    twice = frame.groupBy(key).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"duplicate {key}: {[r[0] for r in twice]}")
    return frame


def export_folders(results: DataFrame, output_dir: str) -> None:
    """<output_dir>/<id>/{raw.json,text.txt} of results(output_id, text, raw), whose ids
    are unique, on any store. For runs whose files something else reads; the text
    table is the form that scales."""

    def save(rows) -> None:
        from .files import _local, _store

        store, base = _store(_local(output_dir))
        for r in rows:
            folder = f"{base}/{r['output_id']}"
            store.create_dir(folder, recursive=True)
            for name, content in (("raw.json", r["raw"]), ("text.txt", r["text"])):
                with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(content.encode())

    results.select("output_id", "raw", "text").foreachPartition(save)


def write_dataset(records: DataFrame, path: str) -> int:
    """{"input": text} lines in order of pos, as a folder of parts; returns how many."""
    records.orderBy("pos").select("input").write.mode("overwrite").json(path)
    return records.sparkSession.read.text(path).count()


def one_file(spark: SparkSession, folder: str, path: str) -> None:
    """Joins the parts of a folder, by name, into one file; the bytes stream through."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    parts = sorted(s.getPath().toString() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    out = target.getFileSystem(conf).create(target, True)
    try:
        for part in parts:
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(part))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            stream.close()
    finally:
        out.close()
