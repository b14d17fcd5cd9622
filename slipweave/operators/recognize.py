"""Model inference: a pluggable recognizer run over chunks of images.

A recognizer takes a list of prepared images and returns one list of
(text, bbox, confidence) per image; a preprocessor turns a file's bytes into an
image. Both are made once per Python worker from a factory. `TextRecognizer` and
`TextPreprocessor` read text files instead of photos and make the flow testable.
"""

from __future__ import annotations

import hashlib
import importlib
import logging
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import DEFAULT, Settings
from ..functions.text import path_parts
from ..schemas import DETECTIONS
from .images import ROTATIONS, backoff
from .ordinal import with_ordinal

Line = tuple[str, tuple[float, float, float, float], float | None]
log = logging.getLogger(__name__)


class Recognizer(Protocol):
    """May also have `memory_errors`, the exceptions of a full device; `free_memory()`,
    called before a retry; and `peak_memory()` in bytes."""

    def recognize(self, images: list[Any], recognition_batch: int, detector_batch: int, math_mode: bool) -> list[list[Line]]: ...


class Preprocessor(Protocol):
    def prepare(self, content: bytes) -> tuple[Any, dict]: ...

    def rotate(self, image: Any, degrees: int) -> Any: ...

    def sample(self) -> bytes: ...


class OutOfMemory(RuntimeError):
    """Raised by a recognizer whose device is full."""


class TextPreprocessor:
    """An image is (text, degrees it was turned by). A first line `turned|N` says that
    the text reads best when turned by N."""

    def prepare(self, content: bytes) -> tuple[Any, dict]:
        text = bytes(content).decode()
        if not text:
            raise ValueError("empty file")
        return (text, 0), {
            "original_size": [0, 0], "final_size": [0, 0], "exif_transposed": False, "resized": False, "upscaled": False,
            "contrast_enhanced": False, "rotation_applied_degrees": 0, "notes": [],
        }

    def rotate(self, image: Any, degrees: int) -> Any:
        return image[0], degrees

    def sample(self) -> bytes:
        return b"Coffee|0|0|60|20|0.9\n45.00|200|0|250|20|0.9\n"


class TextRecognizer:
    """Reads `text|x1|y1|x2|y2|confidence` lines."""

    def recognize(self, images, recognition_batch=96, detector_batch=8, math_mode=False):
        def read(image: tuple[str, int]) -> list[Line]:
            text, turned = image
            rows = [r for r in text.split("\n") if r.strip("\r")]
            best = int(rows.pop(0).partition("|")[2]) if rows and rows[0].startswith("turned|") else 0
            out = []
            for r in rows:
                words, *box, conf = r.rstrip("\r").rsplit("|", 5)
                x1, y1, x2, y2 = map(float, box)
                out.append((words, (x1, y1, x2, y2), (float(conf) if turned == best else float(conf) / 2) if conf else None))
            return out

        return [read(x) for x in images]


def imported(name: str) -> Callable:
    """The object that `module:name` names."""
    module, _, attribute = name.partition(":")
    found = importlib.import_module(module)
    for part in attribute.split("."):
        found = getattr(found, part)
    return found


def with_backoff(model: Recognizer, images: list[Any], settings: Settings = DEFAULT) -> list[list[Line]]:
    """Shrinks both batch sizes while memory runs out, then lets the error go."""
    full = (OutOfMemory, *getattr(model, "memory_errors", ()))
    last: BaseException | None = None
    for recognition, detector in backoff(settings.recognition_batch, settings.detector_batch, settings.oom_divisor):
        try:
            return model.recognize(images, recognition, detector, settings.math_mode)
        except full as e:
            last = e
            getattr(model, "free_memory", lambda: None)()
            log.warning("out of memory with batches of %d and %d", recognition, detector)
    raise last


def mean_confidence(lines: list[Line]) -> float:
    return sum(c or 0.0 for _, _, c in lines) / len(lines) if lines else 0.0


def upright(model: Recognizer, image: Any, rotate: Callable[[Any, int], Any], settings: Settings = DEFAULT, assume_upright: bool = False) -> tuple[Any, int]:
    """Best of four clockwise rotations by mean confidence; ties keep the first."""
    if not settings.orientation_fallback or assume_upright:
        return image, 0
    turned = [(image if d == 0 else rotate(image, d), d) for d in ROTATIONS]
    score = [mean_confidence(with_backoff(model, [x], settings)[0]) for x, _ in turned]
    return turned[score.index(max(score))]


_made: dict[str, Any] = {}


def once(key: str, make: Callable[[], Any]) -> Any:
    """One object per Python worker and factory; loading a model takes long."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def factory_key(make: Callable) -> str:
    """Names a factory by what is sent to the workers, so two lambdas differ."""
    return hashlib.sha256(cloudpickle.dumps(make)).hexdigest()


def read_bytes(path: str) -> bytes:
    """A file's content, read where it is needed."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_stream(name, compression=None) as f:
        return f.read()


def detect(
    files: DataFrame, make_model: Callable[[], Recognizer] = TextRecognizer, make_preprocessor: Callable[[], Preprocessor] = TextPreprocessor,
    settings: Settings = DEFAULT, max_images_per_call: int | None = None, read: Callable[[str], bytes] = read_bytes,
) -> DataFrame:
    """files(path, output_id) -> DETECTIONS, one row per file.

    Chunks follow path order and stay whole, so a failed model call marks just the
    prepared images of its chunk; a failed read or decode marks one image. Only paths
    are numbered and shuffled; the bytes are read by the task that needs them."""
    size = max_images_per_call or settings.max_images_per_call
    chunked = with_ordinal(files.select("path", "output_id").withColumn("_k", path_parts(F.col("path"))), "_k").drop("_k")
    chunked = chunked.withColumn("chunk", F.floor(F.col("ordinal") / size))
    keys = factory_key(make_model), factory_key(make_preprocessor)
    names = [f.name for f in DETECTIONS]

    def chunk(group: pd.DataFrame) -> Iterator[dict]:
        model, pre = once(keys[0], make_model), once(keys[1], make_preprocessor)
        ready: list[tuple[dict, Any, dict, float]] = []
        for r in group.sort_values("ordinal").itertuples():
            base, began = {"path": r.path, "output_id": r.output_id, "chunk": r.chunk, "ordinal": r.ordinal}, time.monotonic()
            try:
                image, report = pre.prepare(read(r.path))
                image, turned = upright(model, image, pre.rotate, settings, report["exif_transposed"])
                ready.append((base, image, report | {"rotation_applied_degrees": turned}, began))
            except Exception as e:  # one image's failure is that image's row
                yield base | {"phase": 0, "error": str(e) or type(e).__name__, "duration_s": time.monotonic() - began}
        try:
            found = with_backoff(model, [x for _, x, _, _ in ready], settings) if ready else []
        except Exception as e:  # a failed call fails its chunk
            for base, _, _, began in ready:
                yield base | {"phase": 1, "error": str(e) or type(e).__name__, "duration_s": time.monotonic() - began}
            return
        peak = getattr(model, "peak_memory", lambda: None)()
        for (base, _, report, began), lines in zip(ready, found):
            yield base | {
                "phase": 1, "preprocessing": report, "text_lines": [{"text": t, "bbox": list(b), "confidence": c} for t, b, c in lines],
                "duration_s": time.monotonic() - began, "peak_memory": peak,
            }

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[r.get(c) for c in names] for r in chunk(group)], columns=names, dtype=object)

    return chunked.groupBy("chunk").applyInPandas(run, DETECTIONS)
