"""What a recogniser sees of a bitmap: grey crops, and the lines of text in them."""

from __future__ import annotations

import numpy as np

from .matroska import MediaError

#: White margin, widest gap within a line, tallest crop, most pixels, most lines, reach about a line.
MARGIN, ROW_GAP, CROP_HEIGHT, CROP_PIXELS, LINES, REACH = 16, 12, 512, 2 << 20, 16, 4


def grey(rgba: np.ndarray) -> np.ndarray:
    """Luminance over black, inverted, so that a clear pixel is white."""
    p = rgba.astype(np.int64)
    light = (p[..., :3] @ np.array([77, 150, 29]) + 128) // 256
    return (255 - (light * p[..., 3] + 127) // 255).astype(np.uint8)


def bands(image: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows that hold ink; rows at most ROW_GAP apart belong together."""
    inked = np.flatnonzero((image != 255).any(axis=1))
    if not len(inked):
        return []
    groups = np.split(inked, np.flatnonzero(np.diff(inked) > ROW_GAP + 1) + 1)
    if len(groups) > LINES:
        raise MediaError("LimitExceeded", "lines")
    return [(int(g[0]), int(g[-1]) + 1) for g in groups]


def crop(rgba: np.ndarray) -> np.ndarray:
    """A grey image with a white margin; of a tall one, only white rows between lines are left out."""
    image = grey(rgba)
    if image.shape[0] > CROP_HEIGHT:
        gap = np.full((ROW_GAP + 1, image.shape[1]), 255, np.uint8)
        parts = [p for a, b in bands(image) or [(0, 1)] for p in (image[a:b], gap)]
        image = np.concatenate(parts[:-1])
    out = np.pad(image, MARGIN, constant_values=255)
    if image.shape[0] > CROP_HEIGHT or out.size > CROP_PIXELS:
        raise MediaError("LimitExceeded", "crop")
    return out


def lines(image: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(top, left, bottom, right) of the lines of a crop, with a little room about them."""
    out = []
    for a, b in bands(image):
        inked = np.flatnonzero((image[a:b] != 255).any(axis=0))
        out.append((max(a - REACH, 0), max(int(inked[0]) - REACH, 0), min(b + REACH, image.shape[0]), min(int(inked[-1]) + 1 + REACH, image.shape[1])))
    if not out:
        raise MediaError("UnreadableLayout")
    return out
