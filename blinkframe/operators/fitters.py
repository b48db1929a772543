"""Sub-pixel fits of clusters and of image windows.

Centroid and phase fits are aggregates and stay in the JVM. The others take all clusters of an Arrow batch at once: sums by
cluster and stacks of small systems. Clusters are dealt by their own key, so no task holds a frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blinkframe.config import Fit, FittingSettings
from blinkframe.functions.numeric import at_most, wrapped
from blinkframe.operators.images import dense

FITTED = "frame long, cluster_id long, x double, y double, sigma_x double, sigma_y double, residual double"


def mean_xy(pixels: DataFrame) -> DataFrame:
    """Centroid by event counts; sigma and residual are 0."""
    n = F.col("n_pos") + F.col("n_neg")
    sums = pixels.groupBy("frame", "cluster_id").agg(F.sum(n).alias("n"), F.sum(F.col("x") * n).alias("sx"), F.sum(F.col("y") * n).alias("sy")).filter("n > 0")
    zero = F.lit(0.0)
    return sums.select("frame", "cluster_id", (F.col("sx") / F.col("n")).alias("x"), (F.col("sy") / F.col("n")).alias("y"), zero.alias("sigma_x"), zero.alias("sigma_y"), zero.alias("residual"))


def phasor(pixels: DataFrame) -> DataFrame:
    """Phase of the first Fourier coefficient along each axis of the cluster's box; thin boxes give the centroid."""
    box = pixels.groupBy("frame", "cluster_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    n = F.col("n_pos") + F.col("n_neg")
    px, py = 2 * math.pi * (F.col("x") - F.col("x0")) / F.col("w"), 2 * math.pi * (F.col("y") - F.col("y0")) / F.col("h")
    sums = pixels.join(box, ["frame", "cluster_id"]).groupBy("frame", "cluster_id", "x0", "y0", "w", "h").agg(
        F.sum(n).alias("n"), F.sum(F.col("x") * n).alias("sx"), F.sum(F.col("y") * n).alias("sy"),
        F.sum(n * F.cos(px)).alias("cx"), F.sum(n * F.sin(px)).alias("ix"), F.sum(n * F.cos(py)).alias("cy"), F.sum(n * F.sin(py)).alias("iy"),
    ).filter("n > 0")

    def place(c: str, i: str, start: str, size: str):
        # Without amplitude there is no phase but rounding; it is taken as zero.
        phase = F.when(F.sqrt(F.col(c) * F.col(c) + F.col(i) * F.col(i)) <= 1e-9 * F.col("n"), 0.0).otherwise(F.atan2(F.col(i), F.col(c)))
        return F.col(start) + wrapped(phase * F.col(size) / (2 * math.pi), F.col(size).cast("double"))

    def ratio(c: str, i: str):
        return F.least(F.sqrt(F.col(c) * F.col(c) + F.col(i) * F.col(i)) / F.col("n"), F.lit(1.0))

    thin = (F.col("w") < 2) | (F.col("h") < 2)
    zero = F.lit(0.0)
    return sums.select(
        "frame", "cluster_id",
        F.when(thin, F.col("sx") / F.col("n")).otherwise(place("cx", "ix", "x0", "w")).alias("x"),
        F.when(thin, F.col("sy") / F.col("n")).otherwise(place("cy", "iy", "y0", "h")).alias("y"),
        zero.alias("sigma_x"), zero.alias("sigma_y"),
        F.when(thin, 0.0).otherwise(1 - 0.5 * (ratio("cx", "ix") + ratio("cy", "iy"))).alias("residual"),
    )


def _sizes(first: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.r_[first, total])


def _solved(matrix: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of a stack of systems by elimination with row exchange, and which have one: no best pivot below 1e-9."""
    table = np.concatenate([matrix, right[:, :, None]], 2)
    each, good = np.arange(len(table)), np.ones(len(table), bool)
    for at in range(right.shape[1]):
        best = at + np.abs(table[:, at:, at]).argmax(1)
        top = table[each, best]
        good &= np.abs(top[:, at]) >= 1e-9
        table[each, best] = table[:, at]
        table[:, at] = top / np.where(good, top[:, at], 1.0)[:, None]
        factor = table[:, :, at].copy()
        factor[:, at] = 0.0
        table -= factor[:, :, None] * table[:, None, at]
    return table[:, :, -1], good


def log_gaussian_fits(x: np.ndarray, y: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least squares of a parabola through log counts; coordinates from the box's corner keep it well posed."""
    sizes = _sizes(first, len(x))
    of = np.repeat(np.arange(len(first)), sizes)
    x0, y0 = np.minimum.reduceat(x, first), np.minimum.reduceat(y, first)
    u, v, z = x - x0[of], y - y0[of], np.log(n)
    design = np.stack([np.ones_like(z), u, v, u * u, v * v], 1)
    left = np.add.reduceat(design[:, :, None] * (design * n[:, None])[:, None], first)
    theta, good = _solved(left, np.add.reduceat(design * (n * z)[:, None], first))
    _, b, c, d, e = theta.T
    good &= (sizes >= 5) & np.isfinite(theta).all(1) & (d < -1e-9) & (e < -1e-9)
    with np.errstate(all="ignore"):
        rest = np.sqrt(np.add.reduceat((z - (design * theta[of]).sum(1)) ** 2, first) / sizes)
        return good, np.stack([x0 - b / (2 * d), y0 - c / (2 * e), np.sqrt(-0.5 / d), np.sqrt(-0.5 / e), rest], 1)


def gaussian_fits(x: np.ndarray, y: np.ndarray, value: np.ndarray, first: np.ndarray, start: np.ndarray, rounds: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Damped least squares of Gaussians on a background no lower than ``floor``, all fits of a batch at once.

    ``first`` says where the samples of each fit begin, ``start`` holds a row of parameters for each. Returns which fits there
    are, and their parameters and root mean square errors. A step is taken only if it lowers the error; a fit that no step
    improved isn't one.
    """
    sizes = _sizes(first, len(x))
    of = np.repeat(np.arange(len(first)), sizes)
    params, damping, reached = start.astype(float), np.full(len(first), 1e-2), np.full(len(first), math.inf)
    fine, going = np.ones(len(first), bool), np.ones(len(first), bool)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            if not going.any():
                break
            now, mine = np.flatnonzero(going), going[of]
            xs, ys, vs, count = x[mine], y[mine], value[mine], sizes[now]
            at, edge = np.repeat(np.arange(len(now)), count), np.cumsum(count) - count

            def model(p: np.ndarray) -> tuple[np.ndarray, ...]:
                px, py, sx, sy, a, b = p[at].T
                dx, dy = xs - px, ys - py
                g = np.exp(-0.5 * (dx * dx / (sx * sx) + dy * dy / (sy * sy)))
                slope = a * g
                return vs - b - slope, np.stack([slope * dx / sx**2, slope * dy / sy**2, slope * dx * dx / sx**3, slope * dy * dy / sy**3, g, np.ones_like(g)], 1)

            rest, jacobian = model(params[now])
            error = np.add.reduceat(rest * rest, edge)
            left = np.add.reduceat(jacobian[:, :, None] * jacobian[:, None], edge) + damping[now, None, None] * np.eye(6)
            step, solved = _solved(left, np.add.reduceat(jacobian * rest[:, None], edge))
            solved &= np.isfinite(error)
            fine[now[~solved]] = False
            tried = params[now] + step
            tried[:, 2:4] = np.clip(tried[:, 2:4], 0.5, 6.0)
            tried[:, 4], tried[:, 5] = np.maximum(tried[:, 4], 1e-3), np.maximum(tried[:, 5], floor)
            rest = model(tried)[0]
            new = np.add.reduceat(rest * rest, edge)
            better = solved & (new < error)
            params[now[better]], reached[now[better]] = tried[better], new[better]
            damping[now] *= np.where(better, 0.7, 2.0)
            going[now] = solved & (np.sqrt((step * step).sum(1)) >= 1e-3)
        return fine & np.isfinite(reached), np.column_stack([params, np.sqrt(reached / sizes)])


def gaussian_fit(x: np.ndarray, y: np.ndarray, value: np.ndarray, start: np.ndarray, rounds: int, floor: float) -> tuple | None:
    """One fit of :func:`gaussian_fits`."""
    fine, found = gaussian_fits(x, y, value, np.zeros(1, int), start[None], rounds, floor)
    return tuple(found[0]) if fine[0] else None


def cluster_gaussian_fits(x: np.ndarray, y: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.add.reduceat(n, first)
    low, high = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first)
    spread = lambda v: np.clip((np.maximum.reduceat(v, first) - np.minimum.reduceat(v, first) + 1) / 4, 0.7, 4.0)
    start = np.stack([np.add.reduceat(x * n, first) / total, np.add.reduceat(y * n, first) / total, spread(x), spread(y), np.maximum(high - low, 1.0), np.maximum(low, 0.0)], 1)
    fine, found = gaussian_fits(x, y, n, first, start, 20, 0.0)
    return fine & (_sizes(first, len(x)) >= 5), found[:, [0, 1, 2, 3, 6]]


def radial_fits(x: np.ndarray, y: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Point closest to the lines along the gradients of each cluster's smoothed counts; clusters of one box size go together."""
    of = np.repeat(np.arange(len(first)), _sizes(first, len(x)))
    x0, y0 = np.minimum.reduceat(x, first), np.minimum.reduceat(y, first)
    box = np.stack([np.maximum.reduceat(y, first) - y0 + 1, np.maximum.reduceat(x, first) - x0 + 1], 1).astype(int)
    fine, found = np.zeros(len(first), bool), np.zeros((len(first), 5))

    def smooth(g: np.ndarray) -> np.ndarray:
        wide = np.pad(g, ((0, 0), (1, 1), (1, 1)))
        return sum(wide[:, i : i + g.shape[1], j : j + g.shape[2]] for i in range(3) for j in range(3)) / 9

    for height, width in np.unique(box[(box >= 3).all(1)], axis=0):
        own = np.flatnonzero((box == (height, width)).all(1))
        place = np.full(len(first), -1)
        place[own] = np.arange(len(own))
        mine = place[of] >= 0
        at = of[mine]
        image = np.zeros((len(own), height, width))
        image[place[at], (y[mine] - y0[at]).astype(int), (x[mine] - x0[at]).astype(int)] = n[mine]
        gx, gy = smooth(0.5 * (image[:, 1:-1, 2:] - image[:, 1:-1, :-2])), smooth(0.5 * (image[:, 2:, 1:-1] - image[:, :-2, 1:-1]))
        w = gx * gx + gy * gy
        w = np.where(w > 1e-9, w, 0.0)
        py, px = np.mgrid[1 : height - 1, 1 : width - 1]
        nx, ny = -gy, gx
        dot = nx * px + ny * py
        total = lambda v: v.sum((1, 2))  # noqa: B023, E731
        a, b, c, r, s = (total(w * v) for v in (nx * nx, nx * ny, ny * ny, nx * dot, ny * dot))
        with np.errstate(all="ignore"):
            det = a * c - b * b
            cx, cy = (r * c - s * b) / det, (a * s - r * b) / det
            rest = np.sqrt(total(w * (nx * cx[:, None, None] + ny * cy[:, None, None] - dot) ** 2) / total(w))
        fine[own] = (total(w) > 0) & (np.abs(det) >= 1e-9) & np.isfinite(cx) & np.isfinite(cy)
        found[own, 0], found[own, 1], found[own, 4] = x0[own] + cx, y0[own] + cy, rest
    return fine, found


#: Pixels fitted at once; clusters are kept whole.
AT_ONCE = 50_000


def _each_cluster(pixels: DataFrame, fit: Callable) -> DataFrame:
    """Run ``fit`` on the pixels of all clusters of a batch: (x, y, counts, where each cluster begins)."""
    rows = pixels.select("frame", "cluster_id", "x", "y", (F.col("n_pos") + F.col("n_neg")).cast("double").alias("n")).filter("n > 0")
    rows = rows.groupBy("frame", "cluster_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "n"))).alias("p"))  # at most one cluster's pixels
    rows = rows.select("frame", "cluster_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.n").alias("n"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["n"].map(len).cumsum() // AT_ONCE):
                x, y, n = (np.concatenate(part[c].tolist()).astype(float) for c in "xyn")
                sizes = part["n"].map(len).to_numpy()
                fine, found = fit(x, y, n, np.cumsum(sizes) - sizes)
                out = part[["frame", "cluster_id"]][fine]
                yield out.assign(**dict(zip(("x", "y", "sigma_x", "sigma_y", "residual"), found[fine].T, strict=True)))

    return rows.mapInPandas(work, FITTED)


def fit_clusters(pixels: DataFrame, method: Fit) -> DataFrame:
    """Fit every cluster of a histogram by ``method``; clusters without a fit are left out."""
    if method is Fit.MEAN_XY:
        return mean_xy(pixels)
    if method is Fit.PHASOR:
        return phasor(pixels)
    return _each_cluster(pixels, {Fit.LOG_GAUSSIAN: log_gaussian_fits, Fit.GAUSSIAN: cluster_gaussian_fits, Fit.RADIAL: radial_fits}[method])


def accepted(fits: DataFrame, method: Fit, settings: FittingSettings, nm_per_pixel: float | None = None) -> DataFrame:
    """Fits within the sigma limits, where the method gives a sigma, and the residual limit; a NaN residual passes."""
    nm = nm_per_pixel or settings.nm_per_pixel
    kept = fits.filter(at_most(F.col("residual"), settings.max_fit_residual, True))
    if method.gives_sigma:
        low, high = settings.sigma_min_nm, settings.sigma_max_nm
        kept = kept.filter((F.col("sigma_x") * nm).between(low, high) & (F.col("sigma_y") * nm).between(low, high))
    return kept


def timed(fits: DataFrame, members: DataFrame, measures: DataFrame) -> DataFrame:
    """Add timestamp_us: mean time of the cluster's events near the fit, nearer events weighing more, or of all of them."""
    keys = ["frame", "cluster_id"]
    box = 0.5 * F.greatest(F.col("x_max") - F.col("x_min") + 1, F.col("y_max") - F.col("y_min") + 1)
    radius = F.when((F.col("sigma_x") > 0) & (F.col("sigma_y") > 0), 2.5 * F.greatest("sigma_x", "sigma_y", F.lit(1.0))).otherwise(box)
    located = fits.join(measures.select(*keys, "x_min", "x_max", "y_min", "y_max", "n_events", "polarity_balance"), keys).withColumn("radius", radius)
    events = members.select(*keys, F.col("x").alias("ex"), F.col("y").alias("ey"), "timestamp_us")
    d2 = F.pow(F.col("ex") - F.col("x"), 2) + F.pow(F.col("ey") - F.col("y"), 2)
    w = F.when(d2 <= F.col("radius") * F.col("radius"), 1 / (1 + d2))
    times = located.join(events, keys).groupBy(*keys).agg((F.sum(F.col("timestamp_us") * w) / F.sum(w)).alias("near"), F.avg("timestamp_us").alias("every"))
    return located.join(times, keys).withColumn("timestamp_us", F.round(F.coalesce("near", "every")).cast("long")).drop("near", "every", "radius", "x_min", "x_max", "y_min", "y_max")


def window_fits(image: DataFrame, spots: DataFrame, radius: int = 4, sigma: float = 1.6, *, width: int, height: int) -> DataFrame:
    """Gaussian fits of the image around each spot's centre of mass; spots whose window leaves the image are dropped."""
    cx, cy = F.round("com_x"), F.round("com_y")
    inside = spots.filter((cx - radius >= 0) & (cy - radius >= 0) & (cx + radius < width) & (cy + radius < height)).select("frame", "rank", "com_x", "com_y")
    schema = "frame long, rank int, x double, y double, sigma_x double, sigma_y double, amplitude double, background double, fit_error double"

    def work(pixels: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        if not len(own):
            return pd.DataFrame(columns=names)
        side = np.arange(-radius, radius + 1)
        com = own[["com_x", "com_y"]].to_numpy(float)
        at = np.floor(com + 0.5).astype(int)
        shape = (len(own), len(side), len(side))
        xx, yy = (np.broadcast_to(v, shape).reshape(len(own), -1) for v in (at[:, 0, None, None] + side, at[:, 1, None, None] + side[:, None]))
        value = dense(pixels, width, height)[yy, xx]
        low, wide = value.min(1), np.full(len(own), sigma)
        start = np.stack([*com.T, wide, wide, np.maximum(value.max(1) - low, 1.0), low], 1)
        fine, found = gaussian_fits(xx.ravel().astype(float), yy.ravel().astype(float), value.ravel(), np.arange(len(own)) * len(side) ** 2, start, 15, -math.inf)
        return own[["frame", "rank"]][fine].assign(**dict(zip(names[2:], found[fine].T, strict=True)))

    return image.groupBy("frame").cogroup(inside.groupBy("frame")).applyInPandas(work, schema)
