"""Quality of camera frames from their pixels: stencils over gray images in Arrow batches, one row per image."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gray levels that count as dark and as bright, and the difference that makes a corner.
DARK, BRIGHT, CORNER = 20.0, 235.0, 20.0
#: The sixteen places around a pixel that the segment test looks at, and how many in a row must differ.
CIRCLE, ARC = [(-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1)], 9
METRICS = "sharpness double, blur double, anisotropy double, brightness double, dark double, bright double, corners int"


def corners(gray: np.ndarray, least: float = CORNER) -> int:
    """Pixels on whose circle nine neighbours in a row are all brighter, or all darker, by more than least, and whose summed difference is the largest of the pixels around (ties: the first in reading order)."""
    h, w = gray.shape
    if h < 7 or w < 7:
        return 0
    ring = np.stack([gray[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx] for dy, dx in CIRCLE]) - gray[3:-3, 3:-3]
    found = np.zeros(ring.shape[1:], bool)
    for hit in (ring > least, ring < -least):
        twice = np.concatenate([hit, hit[: ARC - 1]])
        found |= np.lib.stride_tricks.sliding_window_view(twice, ARC, axis=0).all(-1).any(0)
    score = np.where(found, np.maximum(np.abs(ring) - least, 0).sum(0), 0.0)
    wide = np.pad(score, 1)
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
    for dy, dx in around:
        other = wide[1 + dy : 1 + dy + score.shape[0], 1 + dx : 1 + dx + score.shape[1]]
        found &= (score >= other) if (dy, dx) > (0, 0) else (score > other)
    return int(found.sum())


def metrics_of(gray: np.ndarray) -> tuple:
    """sharpness: variance of the Laplacian, borders mirrored; blur: the same over inner pixels (0 below 3 by 3); anisotropy: ratio of the eigenvalues of the mean gradient products; means and shares of gray levels; corners."""
    wide = np.pad(gray, 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray, 1, mode="edge")
    at = lambda dy, dx: wide[1 + dy : 1 + dy + gray.shape[0], 1 + dx : 1 + dx + gray.shape[1]]
    bend = at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1) - 4 * gray
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    xx, yy, xy = (gx * gx).mean(), (gy * gy).mean(), (gx * gy).mean()
    root = np.sqrt(max(0.0, (xx - yy) ** 2 + 4 * xy * xy))
    inner = bend[1:-1, 1:-1]
    return float(bend.var()), float(inner.var()) if inner.size else 0.0, float((xx + yy + root) / 2 / max(1e-5, (xx + yy - root) / 2)), float(gray.mean()), float((gray < DARK).mean()), float((gray > BRIGHT).mean()), corners(gray)


def image_metrics(images: DataFrame) -> DataFrame:
    """images: id, width, pixels (gray levels row by row). id and METRICS. Metrics are null if pixels are null, empty, no whole rows of width, or hold null or non-finite levels. A task holds one batch of images."""

    def run(batches):
        for batch in batches:
            rows = []
            for width, pixels in zip(batch.column("width").to_pylist(), batch.column("pixels"), strict=True):
                gray = None
                if pixels.is_valid and len(pixels.values) and width and width > 0 and len(pixels.values) % width == 0:
                    gray = pixels.values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                rows.append(metrics_of(gray) if gray is not None and np.isfinite(gray).all() else (None,) * 7)
            names = [x.split()[0] for x in METRICS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([r[k] for r in rows], pa.int32() if k == 6 else pa.float64()) for k in range(7)]], ["id", *names])

    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", F.col("width").cast("int").alias("width"), F.col("pixels").cast("array<double>").alias("pixels")).mapInArrow(run, f"id {kind}, {METRICS}")
