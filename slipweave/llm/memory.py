"""Bounds on what one Python worker holds."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 16 MB: long texts come in fewer rows at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Returns freed memory to the system; workers are reused by later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
