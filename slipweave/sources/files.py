"""File sources: image folders, manifests, text files, the driver's tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import SUPPORTED_EXTENSIONS
from ..functions.text import newlines, path_parts, stem, suffix
from ..plans.shared import exists, materialize
from ..schemas import LISTING, MANIFEST


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supported(frame: DataFrame, path: str = "path") -> DataFrame:
    """Extension filter, case-insensitive, before anything is decoded."""
    return frame.where(suffix(F.col(path)).isin(*SUPPORTED_EXTENSIONS))


def _local(path: str) -> str:
    """A path without the scheme of local files, made absolute."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return path if "://" in path else os.path.abspath(path)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files and folders in each folder of the batches. Linked folders are not entered."""
    from pyarrow import fs

    for batch in batches:
        for folder in batch["path"]:
            store, name = _store(folder)
            prefix = folder[:len(folder) - len(name)] if folder.endswith(name) else ""
            out = []
            for info in store.get_file_info(fs.FileSelector(name)):
                if info.type == fs.FileType.File:
                    out.append((prefix + info.path, info.size, False))
                elif info.type == fs.FileType.Directory and not ("://" not in folder and os.path.islink(info.path)):
                    out.append((prefix + info.path, 0, True))
            yield pd.DataFrame(out, columns=["path", "length", "folder"])


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder, empty and hidden ones too, which
    Spark's own file scan leaves out. Each level of folders is listed by the workers
    and written, so the driver never holds the names."""
    level = spark.createDataFrame([(folder, 0, True)], LISTING)
    found = None
    while True:
        level = materialize(level.repartition("path").mapInPandas(_inside, LISTING), "listing")
        files = level.where("not folder").select("path", "length")
        found = files if found is None else found.unionAll(files)
        level = level.where("folder")
        if level.isEmpty():
            return found


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, output_id, length. A folder is scanned recursively and filtered by
    extension; a single file is taken whatever its extension."""
    from pyarrow import fs

    path = _local(path.rstrip("/") or "/")
    store, name = _store(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no such file or folder: {path}")
    if info.type == fs.FileType.Directory:
        found = supported(listing(spark, path))
    else:
        found = spark.createDataFrame([(path, info.size)], "path string, length long")
    return found.select("path", stem(F.col("path")).alias("output_id"), "length")


def in_path_order(frame: DataFrame, path: str = "path") -> DataFrame:
    return frame.orderBy(path_parts(F.col(path)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines and `pos`, which orders them. A malformed or blank line fails the
    read. Lines that carry a run and a place come in that order; lines of other
    writers, which have neither, before them in order of file name and line."""
    line = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    raw = spark.read.text(path).select("value", line.alias("line"))
    blank = F.raise_error(F.lit("blank manifest line"))
    parsed = F.from_json(F.when(F.trim("value") == "", blank).otherwise(F.col("value")), MANIFEST, {"mode": "FAILFAST"})
    pos = F.struct("m.run", "m.place", "line").alias("pos")
    return raw.select("line", parsed.alias("m")).select(pos, "m.*")


def texts(spark: SparkSession, output_dir: str) -> DataFrame:
    """(output_id, text) of every <output_dir>/<id>/text.txt."""
    found = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "text.txt").text(output_dir, wholetext=True)
    )
    return found.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("output_id"),
        newlines(F.col("value")).alias("text"),
    )


def latest(stored: DataFrame) -> DataFrame:
    """(output_id, text, raw): of texts with one id the last written counts."""
    newest = F.max_by(F.struct("text", "raw"), F.struct("run", "place")).alias("t")
    return stored.groupBy("output_id").agg(newest).select("output_id", "t.*")


def stored(spark: SparkSession, output_dir: str) -> DataFrame | None:
    """The text table of earlier runs, all versions; None before the first."""
    path = f"{output_dir.rstrip('/')}/texts"
    return spark.read.parquet(path) if exists(spark, path) else None
