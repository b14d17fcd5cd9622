"""Driver-side settings. Values fold into the plan as literals."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

# Extensions accepted by a folder scan.
SUPPORTED_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff", ".heic", ".heif")

# Setting -> (field, parser). The first group's names follow a prefix that a deployment chooses.
_PREFIXED = {
    "MAX_LONG_SIDE": ("max_long_side", int),
    "MIN_LONG_SIDE": ("min_long_side", int),
    "CLAHE_CLIP": ("clahe_clip", float),
    "ORIENTATION_FALLBACK": ("orientation_fallback", lambda v: v == "1"),
    "ROW_Y_OVERLAP": ("row_y_overlap", float),
    "ROW_GAP_MULT": ("row_gap_mult", float),
    "LOW_CONFIDENCE": ("low_confidence", float),
    "MATH_MODE": ("math_mode", lambda v: v == "1"),
    "MAX_BATCH": ("max_images_per_call", int),
    "OOM_DIVISOR": ("oom_divisor", int),
}
_PLAIN = {
    "RECOGNITION_BATCH_SIZE": ("recognition_batch", int),
    "DETECTOR_BATCH_SIZE": ("detector_batch", int),
}


@dataclass(frozen=True)
class Settings:
    max_long_side: int = 2560
    min_long_side: int = 1000
    clahe_clip: float = 2.0
    orientation_fallback: bool = False
    row_y_overlap: float = 0.4
    row_gap_mult: float = 3.0
    low_confidence: float = 0.5
    math_mode: bool = False
    max_images_per_call: int = 16
    oom_divisor: int = 2
    recognition_batch: int = 96
    detector_batch: int = 8


def read_dotenv(path: str | os.PathLike) -> dict[str, str]:
    """KEY=VALUE lines of a .env file; comments and blanks are ignored."""
    found: dict[str, str] = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            key, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not key.startswith("#"):
                found[key.strip()] = value.strip().strip("'\"")
    return found


def load(env: Mapping[str, str] | None = None, dotenv: str | os.PathLike = ".env", prefix: str = "SLIPWEAVE_") -> Settings:
    """Real environment over .env over defaults. A malformed value raises ValueError."""
    merged = read_dotenv(dotenv) | dict(os.environ if env is None else env)
    known = {prefix + name: found for name, found in _PREFIXED.items()} | _PLAIN
    return Settings(**{field: parse(merged[name]) for name, (field, parse) in known.items() if name in merged})


DEFAULT = Settings()
