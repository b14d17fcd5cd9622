"""Row reconstruction: cluster fragments into rows, then join each row.

The clustering is an ordered fold: a fragment is compared only with the span
covered so far by the newest row, so `lag` cannot express it. Fragments are
shuffled once by receipt and sorted inside the partitions (Spark spills the
sort); the fold then reads them in Arrow batches and keeps the span of one row,
whatever the receipt's size. Joining keeps the fragments of one row as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import DEFAULT, Settings
from ..functions.text import strip
from .geometry import char_width, y_center

_PLACE = ("x1", "yc", "seq", "x2", "cw", "text", "y1", "y2", "confidence")
ROW_BREAK, WIDE_GAP, GAP = "\n", "  ", " "


def _ordered(fragments: DataFrame, key: str) -> DataFrame:
    """(key, yc, seq, x1, ...) dealt by receipt, top to bottom; ties keep input order."""
    parts = fragments.select(
        key, y_center(F.col("y1"), F.col("y2")).alias("yc"), F.col("seq").cast("int").alias("seq"), "x1", "x2", "y1", "y2",
        char_width(F.col("text"), F.col("x1"), F.col("x2")).alias("cw"), strip(F.col("text")).alias("text"), "confidence",
    )
    return parts.repartition(key).sortWithinPartitions(key, "yc", "seq")


class Fold:
    """Row numbers of fragments that come receipt by receipt in reading order."""

    def __init__(self, threshold: float):
        self.threshold, self.key, self.row, self.low, self.high = threshold, None, 0, 0.0, 0.0

    def numbers(self, keys: list, tops: list[float], bottoms: list[float]) -> list[int]:
        """From 1 in each receipt; the state is carried to the next batch."""
        out, threshold = [], self.threshold
        current, row, low, high = self.key, self.row, self.low, self.high
        for key, top, bottom in zip(keys, tops, bottoms):
            if key != current:
                current, row = key, 0
            shared = (high if high < bottom else bottom) - (low if low > top else top)
            shorter = high - low if high - low < bottom - top else bottom - top
            # Spans without a common part, or without a height, have no ratio: it counts as 0.
            if row and (shared / shorter if shared > 0 and shorter > 0 else 0.0) >= threshold:
                low, high = min(low, top), max(high, bottom)
            else:
                row, low, high = row + 1, top, bottom
            out.append(row)
        self.key, self.row, self.low, self.high = current, row, low, high
        return out


def _type(frame: DataFrame, key: str) -> str:
    return frame.schema[key].dataType.simpleString()


def group_rows(fragments: DataFrame, key: str = "receipt_id", threshold: float | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """One row per fragment with `row_no` from 1, top to bottom."""
    limit = settings.row_y_overlap if threshold is None else threshold
    names = [key, "row_no", *_PLACE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(limit)
        for b in batches:
            numbers = fold.numbers(*(b.column(c).to_pylist() for c in (key, "y1", "y2")))
            columns = {c: b.column(c) for c in (key, *_PLACE)} | {"row_no": pa.array(numbers, pa.int32())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    kinds = f"{key} {_type(fragments, key)}, row_no int, x1 double, yc double, seq int, x2 double, cw double, text string, y1 double, y2 double, confidence double"
    return _ordered(fragments, key).mapInArrow(run, kinds)


def joined(row: list[tuple[float, float, float, str]], multiplier: float) -> str:
    """Text of one row from (x1, x2, cw, text), left to right; equal x1 keep their order.
    A gap wider than `multiplier` mean widths of its two neighbours shows as two spaces."""
    out, x2, cw = [], 0.0, 0.0
    for k, (left, right, width, text) in enumerate(sorted(row, key=lambda f: f[0])):
        if k:
            out.append(WIDE_GAP if left - x2 > multiplier * ((cw + width) / 2.0) else GAP)
        out.append(text)
        x2, cw = right, width
    return "".join(out)


def _rows(batches: Iterator[pa.RecordBatch], key: str, multiplier: float, numbers) -> Iterator[tuple]:
    """(key, row_no, text, confidences) of each row, in order, from ordered fragments."""
    name, row, conf = None, [], []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in (key, "x1", "x2", "cw", "text", "confidence")]
        for k, n, x1, x2, cw, text, c in zip(cols[0], numbers(b), *cols[1:]):
            if name != (k, n):
                if name:
                    yield (*name, joined(row, multiplier), conf)
                name, row, conf = (k, n), [], []
            row.append((x1, x2, cw, text))
            conf.append(0.0 if c is None else c)
    if name:
        yield (*name, joined(row, multiplier), conf)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def _schema(frame: DataFrame, key: str, *fields: tuple[str, pa.DataType]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([(key, to_arrow_type(frame.schema[key].dataType)), *fields])


def row_texts(fragments: DataFrame, key: str = "receipt_id", threshold: float | None = None, multiplier: float | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """(key, row_no, row_text): grouping and joining in one pass."""
    limit = settings.row_y_overlap if threshold is None else threshold
    wide = settings.row_gap_mult if multiplier is None else multiplier
    schema = _schema(fragments, key, ("row_no", pa.int32()), ("row_text", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(limit)
        found = _rows(batches, key, wide, lambda b: fold.numbers(*(b.column(c).to_pylist() for c in (key, "y1", "y2"))))
        yield from _batches((r[:3] for r in found), schema)

    return _ordered(fragments, key).mapInArrow(run, f"{key} {_type(fragments, key)}, row_no int, row_text string")


def join_rows(grouped: DataFrame, key: str = "receipt_id", multiplier: float | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """(key, row_no, row_text) from group_rows, whose order within a row may be lost."""
    wide = settings.row_gap_mult if multiplier is None else multiplier
    schema = _schema(grouped, key, ("row_no", pa.int32()), ("row_text", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _rows(batches, key, wide, lambda b: b.column("row_no").to_pylist())
        yield from _batches((r[:3] for r in found), schema)

    parts = grouped.select(key, F.col("row_no").cast("int").alias("row_no"), *_PLACE)
    parts = parts.repartition(key, "row_no").sortWithinPartitions(key, "row_no", "yc", "seq")
    return parts.mapInArrow(run, f"{key} {_type(grouped, key)}, row_no int, row_text string")


def receipts(fragments: DataFrame, key: str = "receipt_id", settings: Settings = DEFAULT) -> DataFrame:
    """(key, text, num_lines, avg_confidence) from cleaned fragments, in one shuffle:
    rows joined by a newline, the number of fragments and their exact mean. Callers
    left-join to keep receipts without fragments."""
    limit, wide = settings.row_y_overlap, settings.row_gap_mult
    schema = _schema(fragments, key, ("text", pa.string()), ("num_lines", pa.int32()), ("avg_confidence", pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(limit)
        found = _rows(batches, key, wide, lambda b: fold.numbers(*(b.column(c).to_pylist() for c in (key, "y1", "y2"))))

        def whole() -> Iterator[tuple]:
            lines: list[str] = []
            conf: list[float] = []
            name = None
            for k, n, text, mine in found:
                if n == 1:
                    if lines:
                        yield name, ROW_BREAK.join(lines), len(conf), math.fsum(conf) / len(conf)
                    name, lines, conf = k, [], []
                lines.append(text)
                conf += mine
            if lines:
                yield name, ROW_BREAK.join(lines), len(conf), math.fsum(conf) / len(conf)

        yield from _batches(whole(), schema, 512)

    return _ordered(fragments, key).mapInArrow(run, f"{key} {_type(fragments, key)}, text string, num_lines int, avg_confidence double")


def reconstruct(fragments: DataFrame, key: str = "receipt_id", settings: Settings = DEFAULT) -> DataFrame:
    """(key, text): rows joined by a newline. Callers left-join to keep empty receipts."""
    return receipts(fragments, key, settings).select(key, "text")
