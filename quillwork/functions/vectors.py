"""Signatures and image features held as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions.numbers import round_binary

# Thresholds of the frame checks.
QUESTION_SCORE = 0.55
DUPLICATE_MAD = 0.012
BLANK_STD = 4.0
BLURRED_VAR = 60.0
MODE_BAND = 18


def vector_mad(a: Column, b: Column) -> Column:
    """Mean absolute difference; a missing vector is 1.0 away."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    total = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(a.isNull() | b.isNull(), 1.0).otherwise(total / F.size(a))


def dhash(grid: Column, rows: int = 8, cols: int = 9) -> Column:
    """Hex of the bits "right neighbour is larger", row by row."""
    cells = [(r, c) for r in range(rows) for c in range(cols - 1)]
    at = F.array(*[F.lit(r * cols + c + 1) for r, c in cells])
    bits = F.transform(
        at, lambda i: F.when(F.get(grid, i) > F.get(grid, i - 1), "1").otherwise("0")
    )
    text = F.array_join(bits, "")
    digits = [
        F.lower(F.conv(F.substring(text, i + 1, 4), 2, 16)) for i in range(0, len(cells), 4)
    ]
    return F.when(grid.isNull(), "").otherwise(F.concat(*digits))


def slide_score(text_boxes: Column, uniformity: Column, saturation: Column) -> Column:
    """Probability that a frame is a text slide, from its three features."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    text = F.least(text_boxes / 60.0, F.lit(1.0))
    background = clip((uniformity - 0.30) / 0.50)
    grey = 1.0 - F.least(saturation * 2.2, F.lit(1.0))
    return round_binary(clip(0.35 * text + 0.45 * background + 0.20 * grey), 4)


def is_question_score(score: Column, threshold: float = QUESTION_SCORE) -> Column:
    return score >= threshold


def pixel_std(gray: Column, width: int | None = None) -> Column:
    """Population standard deviation of the flattened grey image."""
    n = F.size(gray)
    mean = F.aggregate(gray, F.lit(0.0), lambda acc, x: acc + x) / n
    # the mean is bound once, as it would be computed again for every pixel
    spread = F.transform(
        F.array(mean), lambda m: F.aggregate(gray, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
    )[0]
    return F.when(gray.isNotNull() & (n > 0), F.sqrt(spread / n))


def _stack(images: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sharpness, share of pixels near the most common level) of images of one size."""
    x = np.stack(images).reshape(len(images), -1, width)
    around = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    laplacian = (
        around[:, :-2, 1:-1] + around[:, 2:, 1:-1] + around[:, 1:-1, :-2] + around[:, 1:-1, 2:] - 4 * x
    )
    levels = x.astype("int64").reshape(len(x), -1) + 256 * np.arange(len(x))[:, None]
    counts = np.bincount(levels.ravel(), minlength=256 * len(x)).reshape(len(x), 256)
    sums = np.concatenate([np.zeros((len(x), 1), "int64"), counts.cumsum(axis=1)], axis=1)
    mode = counts.argmax(axis=1)
    low, high = np.maximum(0, mode - MODE_BAND), np.minimum(256, mode + MODE_BAND + 1)
    rows = np.arange(len(x))
    near = (sums[rows, high] - sums[rows, low]) / levels.shape[1]
    return laplacian.reshape(len(x), -1).var(axis=1), near


def image_features(gray: Column, width: int) -> Column:
    """Struct of `sharpness`, the variance of the four-neighbour Laplacian with mirrored
    borders, and `uniformity`, the share of pixels within 18 grey levels of the most
    common one. Images of one size are measured together."""

    @F.pandas_udf("sharpness double, uniformity double")
    def features(images: pd.Series) -> pd.DataFrame:
        out = np.full((len(images), 2), np.nan)
        given = [(i, np.asarray(px, "float64")) for i, px in enumerate(images) if px is not None]
        for size in {px.size for _, px in given}:
            rows = [i for i, px in given if px.size == size]
            out[rows, 0], out[rows, 1] = _stack([px for _, px in given if px.size == size], width)
        return pd.DataFrame({c: [None if np.isnan(v) else v for v in out[:, k]] for k, c in enumerate(("sharpness", "uniformity"))}, dtype=object)

    return features(gray)


def laplacian_var(gray: Column, width: int) -> Column:
    return image_features(gray, width)["sharpness"]


def bg_uniformity(gray: Column, width: int) -> Column:
    return image_features(gray, width)["uniformity"]
