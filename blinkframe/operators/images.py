"""Frame images: event weights by pixel, wavelet planes, spots and blocks.

An image is sparse rows (frame, x, y, value) made by one aggregation. What needs every pixel of a frame runs in one
grouped function on a dense array, which the sensor bounds and the number of events doesn't.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blinkframe.sources.events import COUNTS, FRAME, RAW, inside

#: B3 spline taps.
SPLINE = np.array([1, 4, 6, 4, 1]) / 16
MAX_SPOTS = 256


def analysis_image(events: DataFrame, signed: bool, frame_us: int, width: int, height: int) -> DataFrame:
    """Time-weighted image: an event weighs the microseconds since its frame began, one at least."""
    weight = F.greatest(F.col("timestamp_us") - F.col("frame") * frame_us, F.lit(1)).cast("double")
    value = F.when(F.col("polarity"), weight).otherwise(-weight) if signed else weight
    return inside(events, width, height).groupBy("frame", "x", "y").agg(F.sum(value).alias("value"))


def counted_image(events: DataFrame, width: int, height: int) -> DataFrame:
    """Preview image: events by pixel."""
    return inside(events, width, height).groupBy("frame", "x", "y").agg(F.count("*").cast("double").alias("value"))


def sourced_image(first: DataFrame, second: DataFrame, preview: DataFrame, sources: DataFrame, signed: bool, frame_us: int, width: int, height: int) -> DataFrame:
    """Image of every frame from its source, as :func:`source_of` tells it: weighted events, or the preview's counts (frame, x, y, n)."""
    of = lambda rows, name: rows.join(sources.filter(F.col("source") == name).select("frame"), "frame", "left_semi")
    weighted = analysis_image(of(first, RAW).unionByName(of(second, FRAME).select(*first.columns)), signed, frame_us, width, height)
    counts = inside(of(preview, COUNTS), width, height).groupBy("frame", "x", "y").agg(F.sum("n").cast("double").alias("value"))
    return weighted.unionByName(counts)


def smooth(image: np.ndarray, step: int) -> np.ndarray:
    """Spline smoothing along rows, then columns; taps stand ``step`` pixels apart and the border is repeated."""
    reach = 2 * step
    for axis in (1, 0):
        wide = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = image.shape[axis]
        image = sum(tap * np.take(wide, range(k * step, k * step + n), axis) for k, tap in enumerate(SPLINE))
    return image


def planes(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second wavelet plane."""
    first = smooth(image, 1)
    return image - first, first - smooth(first, 2)


def local_maxima(image: np.ndarray) -> np.ndarray:
    """Inner pixels above zero with no strictly greater neighbour, as a mask."""
    found = np.zeros(image.shape, bool)
    if min(image.shape) < 3:
        return found
    inner = image[1:-1, 1:-1]
    best = np.max([image[dy : dy + inner.shape[0], dx : dx + inner.shape[1]] for dy in range(3) for dx in range(3)], axis=0)
    found[1:-1, 1:-1] = (inner > 0) & (inner >= best)
    return found


def centre_of_mass(image: np.ndarray, x: int, y: int, radius: int = 1) -> tuple[float, float]:
    """Centroid of what is positive around a pixel, the pixel itself if nothing is."""
    y0, x0 = max(y - radius, 0), max(x - radius, 0)
    part = np.maximum(image[y0 : y + radius + 1, x0 : x + radius + 1], 0.0)
    mass = part.sum()
    if mass <= 0:
        return float(x), float(y)
    yy, xx = np.mgrid[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]]
    return float((xx * part).sum() / mass), float((yy * part).sum() / mass)


def dense(rows: pd.DataFrame, width: int, height: int) -> np.ndarray:
    image = np.zeros((height, width))
    image[rows["y"].to_numpy(), rows["x"].to_numpy()] = rows["value"].to_numpy()
    return image


def by_frame(image: DataFrame, work: Callable[[np.ndarray], pd.DataFrame], schema: str, width: int, height: int) -> DataFrame:
    """Run ``work`` on the dense image of every frame."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = work(dense(rows, width, height))
        out.insert(0, "frame", rows["frame"].iloc[0])
        return out

    return image.groupBy("frame").applyInPandas(run, f"frame long, {schema}")


def wavelet_planes(image: DataFrame, width: int, height: int) -> DataFrame:
    """Both wavelet planes at every pixel: frame, x, y, f1, f2."""

    def work(dense_image: np.ndarray) -> pd.DataFrame:
        f1, f2 = planes(dense_image)
        yy, xx = np.mgrid[: f1.shape[0], : f1.shape[1]]
        return pd.DataFrame({"x": xx.ravel(), "y": yy.ravel(), "f1": f1.ravel(), "f2": f2.ravel()})

    return by_frame(image, work, "x int, y int, f1 double, f2 double", width, height)


def plane_sigma(image: DataFrame, width: int, height: int) -> DataFrame:
    """Standard deviation of the first plane over all pixels of each frame."""
    return by_frame(image, lambda i: pd.DataFrame({"sigma": [planes(i)[0].std()]}), "sigma double", width, height)


def spots(image: DataFrame, factor: float = 1.5, most: int = MAX_SPOTS, *, width: int, height: int) -> DataFrame:
    """Local maxima of the thresholded second plane, brightest first: frame, rank, x, y, value, com_x, com_y."""

    def work(dense_image: np.ndarray) -> pd.DataFrame:
        f1, f2 = planes(dense_image)
        kept = np.where(f2 > factor * f1.std(), f2, 0.0)
        y, x = np.nonzero(local_maxima(kept))
        order = np.lexsort((x, y, -kept[y, x]))[:most]
        y, x = y[order], x[order]
        centres = np.array([centre_of_mass(kept, a, b) for a, b in zip(x, y, strict=True)]).reshape(-1, 2)
        return pd.DataFrame({"rank": np.arange(1, len(x) + 1), "x": x, "y": y, "value": kept[y, x], "com_x": centres[:, 0], "com_y": centres[:, 1]})

    return by_frame(image, work, "rank int, x int, y int, value double, com_x double, com_y double", width, height)


def above_threshold(image: DataFrame, threshold: float, most: int = 256) -> DataFrame:
    """Pixels at or above a value, the first ``most`` of each frame in row-major order."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("frame").orderBy("y", "x"))
    return image.filter(F.col("value") >= threshold).withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")


def downsampled(image: DataFrame, most: int = 192, *, width: int, height: int) -> DataFrame:
    """Block means of at most ``most`` blocks a side; the real number of pixels counts at the edges. Empty blocks aren't listed."""
    sx, sy = max(-(-width // most), 1), max(-(-height // most), 1)
    blocks = image.groupBy("frame", F.expr(f"x div {sx}").cast("int").alias("bx"), F.expr(f"y div {sy}").cast("int").alias("by")).agg(F.sum("value").alias("total"))
    pixels = (F.least((F.col("bx") + 1) * sx, F.lit(width)) - F.col("bx") * sx) * (F.least((F.col("by") + 1) * sy, F.lit(height)) - F.col("by") * sy)
    return blocks.select("frame", "bx", "by", (F.col("total") / pixels).alias("value"))


def ring_power(image: np.ndarray) -> float | None:
    """Mean spectral power in a ring of spatial frequencies; None for small or flat images."""
    height, width = image.shape
    if width < 8 or height < 8:
        return None
    image = image - image.mean()
    if (image**2).sum() <= 1e-6:
        return None
    power = np.abs(np.fft.fft2(image)) ** 2

    def frequency(n: int) -> np.ndarray:
        i = np.arange(n)
        return np.where(i <= n // 2, i, i - n) / max(n / 2, 1.0)

    radius = np.hypot(frequency(width)[None, :], frequency(height)[:, None])
    ring = (radius >= 0.25) & (radius <= 0.9)
    return float(power[ring].mean()) if ring.any() else None


def spectral_focus(image: DataFrame, most: int = 192, *, width: int, height: int) -> DataFrame:
    """Spectral focus metric of each frame that has one: frame, metric."""
    sx, sy = max(-(-width // most), 1), max(-(-height // most), 1)
    blocks = downsampled(image, most, width=width, height=height).select("frame", F.col("bx").alias("x"), F.col("by").alias("y"), "value")

    def work(dense_image: np.ndarray) -> pd.DataFrame:
        metric = ring_power(dense_image)
        return pd.DataFrame({"metric": [] if metric is None else [metric]}, dtype=float)

    return by_frame(blocks, work, "metric double", -(-width // sx), -(-height // sy))
