"""Post-processing: limits, drift, nearest neighbours, point spread and tracks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blinkframe.config import PostprocSettings
from blinkframe.functions.numeric import at_most, finite, fraction
from blinkframe.functions.ordered import rolling, running
from blinkframe.sources.shared import checkpoint

MAX_SHIFT = 8
LINK_RADIUS = 1.5
PATCH_RADIUS = 4


def passing(rows: DataFrame, settings: PostprocSettings) -> DataFrame:
    """Fits with enough events, even polarity and a residual within the limit; NaN fails."""
    kept = rows.filter((F.col("n_events") >= settings.min_n_events) & (F.abs("polarity_balance") <= settings.max_polarity_imbalance))
    return kept.filter(at_most(F.col("residual"), settings.max_fit_residual, False))


def rasterised(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points by rounded pixel, halves away from zero."""
    return points.groupBy(*keys, F.round("x").cast("long").alias("x"), F.round("y").cast("long").alias("y")).agg(F.count("*").alias("n"))


def _vertex(left, centre, right):
    den = left - 2 * centre + right
    return F.when(F.abs(den) < 1e-9, 0.0).otherwise(F.least(F.greatest(0.5 * (left - right) / den, F.lit(-0.5)), F.lit(0.5)))


def shifts(reference: DataFrame, moving: DataFrame, most: int = MAX_SHIFT) -> DataFrame:
    """Shift of each frame of ``moving`` against ``reference`` (both frame, x, y): frame, shift_x, shift_y, overlap.

    Whole shifts are scored by the product of counts that fall together, found by a join on cells; the first best in
    row-major order wins and is refined by parabolas. No overlap in reach gives the first shift of all.
    """
    ref, mov = rasterised(reference, ["frame"]), rasterised(moving, ["frame"])
    cell = 2 * most + 3
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    at = lambda c: F.expr(f"floor({c} / {cell})")
    far = ref.select("frame", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("n").alias("rn"))
    far = far.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumns({"cx": F.col("dx") + at("rx"), "cy": F.col("dy") + at("ry")})
    pairs = mov.withColumns({"cx": at("x"), "cy": at("y")}).join(far, ["frame", "cx", "cy"])
    # Reference pixel p meets moving pixel p - s.
    scored = pairs.select("frame", (F.col("rx") - F.col("x")).alias("sx"), (F.col("ry") - F.col("y")).alias("sy"), (F.col("rn") * F.col("n")).alias("v"))
    scored = scored.filter((F.abs("sx") <= most + 1) & (F.abs("sy") <= most + 1)).groupBy("frame", "sx", "sy").agg(F.sum("v").alias("score"))
    both = ref.select("frame").distinct().join(mov.select("frame").distinct(), "frame")
    inner = scored.filter((F.abs("sx") <= most) & (F.abs("sy") <= most))
    best = inner.groupBy("frame").agg(F.max(F.struct("score", (-F.col("sy")).alias("a"), (-F.col("sx")).alias("b"))).alias("best"))
    best = both.join(best, "frame", "left").select("frame", F.coalesce("best.score", F.lit(0)).cast("long").alias("overlap"), F.coalesce(-F.col("best.b"), F.lit(-most)).alias("bx"), F.coalesce(-F.col("best.a"), F.lit(-most)).alias("by"))
    around = best.join(scored, "frame", "left").groupBy("frame", "bx", "by", "overlap").agg(
        *[F.coalesce(F.max(F.when((F.col("sx") == F.col("bx") + dx) & (F.col("sy") == F.col("by") + dy), F.col("score"))), F.lit(0)).cast("double").alias(name)
          for name, dx, dy in (("c", 0, 0), ("w", -1, 0), ("e", 1, 0), ("n", 0, -1), ("s", 0, 1))]
    )
    found = around.select("frame", (F.col("bx") + _vertex(F.col("w"), F.col("c"), F.col("e"))).alias("shift_x"), (F.col("by") + _vertex(F.col("n"), F.col("c"), F.col("s"))).alias("shift_y"), "overlap")
    alone = moving.select("frame").distinct().join(both, "frame", "left_anti")
    return found.unionByName(alone.select("frame", F.lit(0.0).alias("shift_x"), F.lit(0.0).alias("shift_y"), F.lit(0).cast("long").alias("overlap")))


def window_reference(points: DataFrame, frames: int) -> DataFrame:
    """Points of the ``frames`` frames before each frame, under that frame: the reference without feedback."""
    return points.withColumn("frame", F.explode(F.sequence(F.col("frame") + 1, F.col("frame") + frames)))


def window_shifts(points: DataFrame, frames: int, most: int = MAX_SHIFT, by: Sequence[str] = ()) -> DataFrame:
    """Shift of each frame against the ``frames`` frames before it: as :func:`shifts` with :func:`window_reference`, without its rows.

    Points are counted by pixel first. Frames are dealt by blocks of the window's length and pixels by cells, so that a
    pixel's count goes to two blocks as a reference and to nine cells as a moving one. A group slides through its block: the
    reference grid of its cell gains the newest frame's counts and loses the oldest's, and every moving pixel adds the grid
    around it to the scores of its frame. Scores of a frame's cells are then summed. Columns of ``by``, such as a segment,
    are apart.
    """
    keys, cell, size = list(by), 2 * most + 3, 2 * most + 3
    counts = rasterised(points, [*keys, "frame"]).withColumns({"cx": F.expr(f"floor(x / {cell})"), "cy": F.expr(f"floor(y / {cell})"), "block": F.expr(f"floor(frame / {frames})")})
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    fixed = counts.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") + 1))).withColumn("moving", F.lit(False))
    moving = counts.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy"), "moving": F.lit(True)}).drop("dx", "dy")

    def scored(part: pd.DataFrame) -> pd.DataFrame:
        own = part.sort_values("frame", kind="stable")
        is_moving = own["moving"].to_numpy()
        ref, mov = own[~is_moving], own[is_moving]
        x0, y0 = int(own["cx"].iloc[0]) * cell, int(own["cy"].iloc[0]) * cell
        at, fx, fy, fn = ref["frame"].to_numpy(), ref["x"].to_numpy() - x0, ref["y"].to_numpy() - y0, ref["n"].to_numpy()
        grid = np.zeros((cell, cell), np.int64)
        oldest = newest = 0
        out = []
        for frame, rows in mov.groupby("frame", sort=True):
            until, since = np.searchsorted(at, frame), np.searchsorted(at, frame - frames)
            np.add.at(grid, (fy[newest:until], fx[newest:until]), fn[newest:until])
            np.subtract.at(grid, (fy[oldest:since], fx[oldest:since]), fn[oldest:since])
            oldest, newest = since, until
            if since == until:
                continue
            score = np.zeros((size, size), np.int64)
            for x, y, n in rows[["x", "y", "n"]].itertuples(index=False):
                # Moving pixel p meets reference pixel p + s, s from -(most + 1) to most + 1.
                left, top = x - x0 - most - 1, y - y0 - most - 1
                a, b, c, d = max(left, 0), min(left + size, cell), max(top, 0), min(top + size, cell)
                if a < b and c < d:
                    score[c - top : d - top, a - left : b - left] += n * grid[c:d, a:b]
            if score.any():
                out.append((*(part[k].iloc[0] for k in keys), frame, score.ravel().tolist()))
        return pd.DataFrame(out, columns=[*keys, "frame", "score"])

    def told(part: pd.DataFrame) -> pd.DataFrame:
        score = np.sum([np.asarray(v) for v in part["score"] if v is not None], axis=0).reshape(size, size) if part["score"].notna().any() else np.zeros((size, size))
        x, y, overlap = _refined(score, most) if part["known"].any() else (0.0, 0.0, 0)
        return pd.DataFrame([(*(part[k].iloc[0] for k in keys), part["frame"].iloc[0], x, y, overlap)], columns=[*keys, "frame", "shift_x", "shift_y", "overlap"])

    named = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in points.select(*keys).schema)
    both = fixed.unionByName(moving)
    scores = both.groupBy(*keys, "block", "cx", "cy").applyInPandas(scored, f"{named}frame long, score array<long>").withColumn("known", F.lit(False))
    # A frame without a point in its window has no shift; one whose points meet none in reach has the first of all.
    each = rolling(points.select(*keys, "frame").distinct(), "frame", 2, lambda last: {"previous": F.max("frame").over(last(2, 1))}, keys)
    each = each.select(*keys, "frame", F.lit(None).cast("array<long>").alias("score"), F.coalesce(F.col("previous") >= F.col("frame") - frames, F.lit(False)).alias("known"))
    return scores.unionByName(each).groupBy(*keys, "frame").applyInPandas(told, f"{named}frame long, shift_x double, shift_y double, overlap long")


def _refined(score: np.ndarray, most: int) -> tuple[float, float, int]:
    """First best whole shift of a square of scores, its rim left out, refined by parabolas; and its score."""
    inner = score[1:-1, 1:-1]
    y, x = np.unravel_index(int(inner.argmax()), inner.shape)

    def vertex(a: float, b: float, c: float) -> float:
        den = a - 2 * b + c
        return 0.0 if abs(den) < 1e-9 else float(np.clip(0.5 * (a - c) / den, -0.5, 0.5))

    v = score[y : y + 3, x : x + 3]
    return float(x - most + vertex(v[1, 0], v[1, 1], v[1, 2])), float(y - most + vertex(v[0, 1], v[1, 1], v[2, 1])), int(inner[y, x])


def moved(rows: DataFrame, found: DataFrame, physical: bool = False) -> DataFrame:
    """Apply shifts: subtracted, or added where ``physical`` (the shift points from the drifted frame to its reference)."""
    sign = 1 if physical else -1
    out = rows.join(found.select("frame", "shift_x", "shift_y"), "frame", "left")
    return out.withColumns({"x": F.col("x") + sign * F.coalesce("shift_x", F.lit(0.0)), "y": F.col("y") + sign * F.coalesce("shift_y", F.lit(0.0))}).drop("shift_x", "shift_y")


def neighbour_distances(rows: DataFrame, key: str = "cluster_id", by: Sequence[str] = ("frame",)) -> DataFrame:
    """Distance of each localization to the nearest other of its frame (the columns of ``by``, in general); one alone has none.

    Search goes by growing rings: what has no neighbour within one cell's width meets cells four times as wide in the next
    round. Points left over in a round are farther apart than the cells of the round before, so that only a bounded number of
    them can meet any point: rows grow with the points, and rounds with the logarithm of the widest gap. Positions that
    aren't finite have no distance and are nobody's neighbour.
    """
    keys, cell = list(by), 8.0
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    own = rows.filter(finite(F.col("x")) & finite(F.col("y"))).select(*keys, key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    company = own.groupBy(*keys).agg((F.min(key) != F.max(key)).alias("company")).filter("company").drop("company")
    own = checkpoint(own.join(company, keys, "left_semi"))
    far = own.select(*keys, F.col(key).alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    d = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    left, found = own, []
    while True:
        at = lambda c: F.floor(F.col(c) / cell)
        wide = left.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumns({"cx": at("x") + F.col("dx"), "cy": at("y") + F.col("dy")}).drop("dx", "dy")
        met = wide.join(far.withColumns({"cx": at("ox"), "cy": at("oy")}), [*keys, "cx", "cy"]).filter(F.col(key) != F.col("other"))
        close = checkpoint(met.groupBy(*keys, key).agg(F.min(d).alias("distance")).filter(F.col("distance") <= cell))
        found.append(close)
        left = checkpoint(left.join(close, [*keys, key], "left_anti"))
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, found)
        cell *= 4


def precision(distances: DataFrame, nm: float = 65.0, by: Sequence[str] = ()) -> DataFrame:
    """Rayleigh sigma of all distances up to and including each frame: frame, n, sigma_px, sigma_nm; columns of ``by`` are apart."""
    if "frame" in by:
        raise ValueError("frames are in order, they aren't groups")
    frames = distances.groupBy(*by, "frame").agg(F.sum(F.col("distance") * F.col("distance")).alias("d2"), F.count("*").alias("k"))
    out = running(frames, "frame", by, n="k", total="d2")
    sigma = F.sqrt(F.col("total") / (2 * F.col("n")))
    return out.select(*by, "frame", "n", sigma.alias("sigma_px"), (sigma * nm).alias("sigma_nm"))


def recent_distances(distances: DataFrame, key: str = "cluster_id", most: int = 32) -> DataFrame:
    """The last ``most`` distances."""
    return distances.orderBy(F.desc("frame"), F.desc(key)).limit(most)


def spread_patch(rows: DataFrame, radius: int = PATCH_RADIUS) -> DataFrame:
    """Mean Gaussian patch of all localizations, about their sub-pixel positions: dx, dy, value."""
    reach = range(-radius, radius + 1)

    def profile(at: str, sigma: str, name: str) -> list:
        wide = F.greatest(sigma, F.lit(1.0))
        off = lambda d: F.lit(d) - fraction(F.col(at))
        return [F.exp(-0.5 * off(d) * off(d) / (wide * wide)).alias(f"{name}{d + radius}") for d in reach]

    sides = rows.select(*profile("x", "sigma_x", "u"), *profile("y", "sigma_y", "v"))
    cells = [(dx, dy, f"m{dx + radius}_{dy + radius}") for dy in reach for dx in reach]
    means = sides.agg(*[F.avg(F.col(f"u{dx + radius}") * F.col(f"v{dy + radius}")).alias(name) for dx, dy, name in cells])
    listed = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.col(name).alias("value")) for dx, dy, name in cells]))
    return means.select(listed.alias("cell")).select("cell.*").filter("value is not null")


class Tracks:
    """Molecules followed from frame to frame: each localization takes the nearest free track within reach."""

    def __init__(self, radius: float = LINK_RADIUS, active: list[tuple] | None = None) -> None:
        self.radius, self.active = radius, list(active or [])
        self.next_id = 0

    def step(self, points: list[tuple[float, float]]) -> list[int]:
        """Advance by one frame; returns the lengths of the tracks that ended."""
        xy = np.array([(x, y) for x, y, _ in self.active]).reshape(-1, 2)
        free = np.ones(len(xy), bool)
        following = []
        for x, y in points:
            d2 = np.where(free, (xy[:, 0] - x) ** 2 + (xy[:, 1] - y) ** 2, math.inf)
            least = d2.min(initial=math.inf)
            if least <= self.radius**2:
                at = int(np.flatnonzero(d2 == least)[-1])  # the later of equals
                free[at] = False
                following.append((x, y, self.active[at][2] + 1))
            else:
                following.append((x, y, 1))
        ended = [length for (_, _, length), f in zip(self.active, free, strict=True) if f]
        self.active = following
        return ended


def _linked(rows: DataFrame, session: str, order: str, radius: float) -> DataFrame:
    """(session, frame, nth, before): the localization of the frame before that each one continues, if any.

    Greedy assignment goes by the order of a frame's localizations and sees only the frame before, so each pair of
    neighbouring frames is a group of its own.
    """
    own = rows.select(F.col(session).alias("session"), "frame", F.col(order).alias("nth"), "x", "y")
    both = own.withColumn("old", F.lit(False)).unionByName(own.withColumns({"frame": F.col("frame") + 1, "old": F.lit(True)}))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("nth", kind="stable")
        old, new = part[part["old"]], part[~part["old"]]
        xy = old[["x", "y"]].to_numpy(float)
        free = np.ones(len(xy), bool)
        before: list[int | None] = []
        for x, y in new[["x", "y"]].itertuples(index=False):
            d2 = np.where(free, (xy[:, 0] - x) ** 2 + (xy[:, 1] - y) ** 2, math.inf)
            least = d2.min(initial=math.inf)
            if least <= radius**2:
                at = int(np.flatnonzero(d2 == least)[-1])  # the later of equals
                free[at] = False
                before.append(int(old["nth"].iloc[at]))
            else:
                before.append(None)
        return pd.DataFrame({"session": new["session"], "frame": new["frame"], "nth": new["nth"], "before": pd.array(before, "Int64")})

    kind = own.schema["session"].dataType.simpleString()
    return both.groupBy("session", "frame").applyInPandas(work, f"session {kind}, frame long, nth long, before long")


def track_lengths(rows: DataFrame, session: str = "session", order: str = "cluster_id", radius: float = LINK_RADIUS) -> DataFrame:
    """Lengths of all tracks of each session, ended and active: session, length.

    ``order`` numbers the localizations of a frame. A frame without any ends all tracks. Links are found between neighbouring
    frames, then every localization finds its track's first one by pointer doubling: rounds grow with the logarithm of the
    longest track.
    """
    links = checkpoint(_linked(rows, session, order, radius))
    node = F.struct("frame", "nth")
    ups = links.select("session", node.alias("node"), F.when(F.col("before").isNotNull(), F.struct((F.col("frame") - 1).alias("frame"), F.col("before").alias("nth"))).alias("up"))
    ups = ups.select("session", "node", F.coalesce("up", "node").alias("top"))
    moving = 1
    while moving:
        far = ups.select("session", F.col("node").alias("top"), F.col("top").alias("higher"))
        ups = checkpoint(ups.join(far, ["session", "top"]).select("session", "node", F.col("higher").alias("top"), (F.col("higher") != F.col("top")).alias("moved")))
        moving = ups.filter("moved").limit(1).count()
        ups = ups.drop("moved")
    found = ups.groupBy("session", "top").agg(F.count("*").alias("length"))
    return found.select(F.col("session").alias(session), "length")


def on_time(lengths: DataFrame, session: str = "session") -> DataFrame:
    """Tracks by length, short ones first."""
    return lengths.groupBy(session, "length").agg(F.count("*").alias("n")).orderBy(session, "length")


def best_shift(reference: np.ndarray, moving: np.ndarray) -> tuple[float, float]:
    """Shift of some points against a reference, as :func:`shifts` tells it; none without points on both sides."""
    if not len(reference) or not len(moving):
        return 0.0, 0.0
    away = lambda v: np.sign(v) * np.floor(np.abs(v) + 0.5)
    ref, rn = np.unique(away(reference), axis=0, return_counts=True)
    mov, mn = np.unique(away(moving), axis=0, return_counts=True)
    size = MAX_SHIFT + 1
    grid = np.zeros((2 * size + 1, 2 * size + 1))
    for (x, y), n in zip(mov, mn, strict=True):
        dx, dy = ref[:, 0] - x, ref[:, 1] - y
        near = (np.abs(dx) <= size) & (np.abs(dy) <= size)
        np.add.at(grid, ((dy[near] + size).astype(int), (dx[near] + size).astype(int)), n * rn[near])
    return _refined(grid, MAX_SHIFT)[:2]


def drift_fold(rows: DataFrame, window: int = 50, session: str = "session", order: str = "cluster_id", physical: bool = False) -> DataFrame:
    """Drift correction with feedback: a frame's reference is the corrected points of the ``window`` frames before it.

    Frames without rows count as frames. Each frame needs the corrected ones before it, so a session is one sequential
    fold: its points stream by in order of their frames, ``window`` frames of them are held, and a shift is told for each
    frame. Shifts are then joined to the rows.
    """
    sign = 1 if physical else -1

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray]] = []
        now: tuple | None = None
        points: list[np.ndarray] = []

        def closed() -> tuple:
            nonlocal held
            moving = np.concatenate(points)
            held = [(f, p) for f, p in held if f >= now[1] - window]
            found = best_shift(np.concatenate([p for _, p in held]) if held else np.zeros((0, 2)), moving)
            held.append((now[1], moving + sign * np.array(found)))
            return (*now, *found)

        names = ["session", "frame", "shift_x", "shift_y"]
        for batch in batches:
            out = []
            for key, part in batch.groupby(["session", "frame"], sort=False, dropna=False):
                if key != now:
                    if now is not None:
                        out.append(closed())
                        if key[0] != now[0]:
                            held = []
                    now, points = key, []
                points.append(part[["x", "y"]].to_numpy(float))
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([closed()], columns=names)

    own = rows.select(F.col(session).alias("session"), "frame", F.col(order).alias("nth"), F.col("x").cast("double"), F.col("y").cast("double"))
    kind = own.schema["session"].dataType.simpleString()
    sorted_rows = own.repartition("session").sortWithinPartitions("session", "frame", "nth")
    found = sorted_rows.mapInPandas(work, f"session {kind}, frame long, shift_x double, shift_y double").withColumnRenamed("session", session)
    out = rows.join(found, [session, "frame"])
    return out.withColumns({"x": F.col("x") + sign * F.col("shift_x"), "y": F.col("y") + sign * F.col("shift_y")}).select(*rows.columns, "shift_x", "shift_y")
