"""Image-size and orientation rules as columns; pixels belong to the worker.

Decoding, EXIF transposition, contrast enhancement and rotation are in `pixels`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import DEFAULT, Settings

ROTATIONS = (0, 90, 180, 270)


def resize_bounds(w: Column, h: Column, settings: Settings = DEFAULT) -> Column:
    """struct(width, height, resized, upscaled); dimensions round half to even."""
    long = F.greatest(w, h)
    down, up = long > settings.max_long_side, long < settings.min_long_side
    target = F.when(down, settings.max_long_side).when(up, settings.min_long_side)
    scale = target.cast("double") / long

    def side(x: Column) -> Column:
        return F.when(down | up, F.greatest(F.lit(1), F.rint(x * scale).cast("int"))).otherwise(x)

    return F.struct(side(w).alias("width"), side(h).alias("height"), down.alias("resized"), up.alias("upscaled"))


def exif_transposed(tag: Column) -> Column:
    """Any orientation tag but 1 counts, invalid ones too; no tag is 1."""
    return F.coalesce(tag, F.lit(1)) != 1


def best_rotation(scored: DataFrame, key: str = "receipt_id") -> DataFrame:
    """Mean confidence of all lines by rotation (0 when none); a tie keeps the earliest."""
    per = scored.groupBy(key, "rotation").agg(F.coalesce(F.avg(F.coalesce("confidence", F.lit(0.0))), F.lit(0.0)).alias("score"))
    return per.groupBy(key).agg(
        F.max_by("rotation", F.struct(F.col("score"), -F.col("rotation"))).alias("rotation"),
        F.max("score").alias("score"),
    )


def backoff(recognition: int, detector: int, divisor: int, retries: int = 3) -> Iterator[tuple[int, int]]:
    """Batch sizes to try while memory runs out; after the last one the error is raised.
    Sizes are worked out as they are asked for, so a bad divisor hurts only then."""
    yield recognition, detector
    for _ in range(retries):
        if recognition <= 1 and detector <= 1:
            return
        recognition, detector = max(1, recognition // divisor), max(1, detector // divisor)
        yield recognition, detector


def bounded(width: int, height: int, settings: Settings = DEFAULT) -> tuple[int, int, bool, bool]:
    """resize_bounds() of one image, for workers."""
    longer = max(width, height)
    shrink, grow = longer > settings.max_long_side, longer < settings.min_long_side
    if not (shrink or grow):
        return width, height, False, False
    scale = (settings.max_long_side if shrink else settings.min_long_side) / longer
    return max(1, round(width * scale)), max(1, round(height * scale)), shrink, grow
