"""Pixels: decoding, orientation by EXIF, size bounds, contrast, rotation.

Needs Pillow and OpenCV, and pillow-heif for HEIC files; all are imported when a
worker first prepares an image, never by the driver.
"""

from __future__ import annotations

import io
from functools import lru_cache
from typing import Any

from ..conf import DEFAULT, Settings
from .images import bounded

# The EXIF tag of the orientation, and the tiles of the contrast step.
ORIENTATION_TAG, TILES = 0x0112, (8, 8)


@lru_cache(1)
def _opener():
    """Pillow, with HEIC files registered where the plug-in is there."""
    from PIL import Image

    try:
        import pillow_heif
    except ImportError:
        return Image
    pillow_heif.register_heif_opener()
    return Image


class PixelPreprocessor:
    """bytes -> (image, report); decoding is forced here, so a damaged file fails here."""

    def __init__(self, settings: Settings = DEFAULT):
        self.settings = settings

    def prepare(self, content: bytes) -> tuple[Any, dict]:
        from PIL import ImageOps

        library = _opener()
        found = library.open(io.BytesIO(content))
        found.load()
        tag = found.getexif().get(ORIENTATION_TAG, 1)
        image = ImageOps.exif_transpose(found).convert("RGB")
        width, height, shrunk, grown = bounded(*image.size, self.settings)
        if shrunk or grown:
            image = image.resize((width, height), library.LANCZOS if shrunk else library.BICUBIC)
        image = self.contrast(image)
        return image, {
            "original_size": list(found.size), "final_size": list(image.size), "exif_transposed": tag != 1,
            "resized": shrunk, "upscaled": grown, "contrast_enhanced": True, "rotation_applied_degrees": 0, "notes": [],
        }

    def contrast(self, image: Any) -> Any:
        """Equalizes the lightness channel tile by tile, within a clip limit."""
        import cv2
        import numpy as np

        light, *colours = cv2.split(cv2.cvtColor(np.asarray(image), cv2.COLOR_RGB2LAB))
        light = cv2.createCLAHE(clipLimit=self.settings.clahe_clip, tileGridSize=TILES).apply(light)
        return _opener().fromarray(cv2.cvtColor(cv2.merge((light, *colours)), cv2.COLOR_LAB2RGB))

    def rotate(self, image: Any, degrees: int) -> Any:
        """Clockwise; the canvas grows to hold the corners."""
        return image.rotate(-degrees, expand=True, resample=_opener().BICUBIC)

    def sample(self) -> bytes:
        """A small image with a line of text, for a smoke check."""
        from PIL import ImageDraw

        image = _opener().new("RGB", (480, 120), "white")
        ImageDraw.Draw(image).text((12, 40), "Coffee 45.00", fill="black")
        out = io.BytesIO()
        image.save(out, "PNG")
        return out.getvalue()
