"""Localizations: limits, times, standard and nanometre rows, accumulation and density."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blinkframe.config import LocalizationSettings
from blinkframe.functions.numeric import finite
from blinkframe.functions.ordered import running
from blinkframe.operators.rangejoin import within


def uncertainty_px(amplitude: str = "amplitude"):
    return (F.col("sigma_x") + F.col("sigma_y")) / 2 / F.sqrt(F.greatest(F.abs(F.col(amplitude)), F.lit(1.0)))


def in_sigma_range(rows: DataFrame, low_nm: float, high_nm: float, nm: float) -> DataFrame:
    return rows.filter((F.col("sigma_x") * nm).between(low_nm, high_nm) & (F.col("sigma_y") * nm).between(low_nm, high_nm))


def credible(rows: DataFrame, settings: LocalizationSettings, nm: float | None = None) -> DataFrame:
    """Localizations within the limits of sigma, uncertainty and finite error."""
    nm = nm or settings.nm_per_pixel
    kept = in_sigma_range(rows, settings.sigma_min_nm, settings.sigma_max_nm, nm)
    return kept.filter((uncertainty_px() * nm <= settings.max_xy_uncertainty_nm) & finite(F.col("fit_error")))


def timed(rows: DataFrame, events: DataFrame | None, radius: float, frame_us: int) -> DataFrame:
    """Add timestamp_us: weighted mean of the frame's events within ``radius``; the middle of the window if there are none."""
    middle = F.col("frame") * frame_us + F.lit(frame_us // 2)
    if events is None:
        return rows.withColumn("timestamp_us", middle)
    own = rows.select("frame", "rank", "x", "y")
    # Localizations go to the cells around them: they are fewer than events.
    near = within(events.select("frame", "x", "y", "timestamp_us"), own, radius)
    w = 1 / (1 + F.col("d2"))
    times = near.groupBy("frame", F.col("r_rank").alias("rank")).agg(F.round(F.sum(F.col("timestamp_us") * w) / F.sum(w)).cast("long").alias("t"))
    return rows.join(times, ["frame", "rank"], "left").withColumn("timestamp_us", F.coalesce("t", middle)).drop("t")


def standard(rows: DataFrame) -> DataFrame:
    """Cluster fits as standard localizations: no amplitude, no background, the residual as error."""
    zero = F.lit(0.0)
    kept = [c for c in ("session", "epoch") if c in rows.columns]
    return rows.select(*kept, "frame", "cluster_id", "x", "y", "sigma_x", "sigma_y", zero.alias("amplitude"), zero.alias("background"), "timestamp_us", F.col("residual").alias("fit_error"))


def accumulated(rows: DataFrame, order: list[str], nm: float = 65.0, by: Sequence[str] = ()) -> DataFrame:
    """Table in nanometres: columns of ``by``, id, frame, x_nm, y_nm, sigma_nm, intensity, offset, uncertainty_xy_nm, timestamp_us.

    Ids run from 0 in ``order`` over the whole table, or each group of ``by`` (an epoch, as a reset starts anew), without one task numbering it: each frame counts its rows, frames
    are offset by the running sum of those counts.
    """
    counts = rows.groupBy(*by, "frame").agg(F.count("*").alias("n"))
    before = running(counts, "frame", by, until="n").select(*by, "frame", (F.col("until") - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy(*by, "frame").orderBy(*order))
    out = rows.withColumn("nth", nth).join(before, [*by, "frame"])
    return out.select(
        *by, (F.col("before") + F.col("nth") - 1).alias("id"), "frame", (F.col("x") * nm).alias("x_nm"), (F.col("y") * nm).alias("y_nm"),
        ((F.col("sigma_x") + F.col("sigma_y")) / 2 * nm).alias("sigma_nm"), F.col("amplitude").alias("intensity"), F.col("background").alias("offset"),
        (uncertainty_px() * nm).alias("uncertainty_xy_nm"), "timestamp_us",
    )


def rescaled(table: DataFrame, old_nm: float, new_nm: float) -> DataFrame:
    """An accumulated table in another calibration, which is held to 1 to 500 nm."""
    scale = min(max(new_nm, 1.0), 500.0) / old_nm
    if abs(scale - 1.0) <= 2.220446049250313e-16:
        return table
    return table.withColumns({c: F.col(c) * scale for c in ("x_nm", "y_nm", "sigma_nm", "uncertainty_xy_nm")})


def newest(table: DataFrame, most: int, by: Sequence[str] = ()) -> DataFrame:
    """The last ``most`` rows by id, of each group of ``by`` if there are any."""
    if not by:
        return table.orderBy(F.desc("id")).limit(most)
    # Ids run from 0 in each group: what is within reach of the last one stays, without sorting a group.
    last = table.groupBy(*by).agg(F.max("id").alias("_last"))
    return table.join(last, list(by)).filter(F.col("id") > F.col("_last") - most).drop("_last")


def density(table: DataFrame, bin_nm: float) -> DataFrame:
    """Localizations by square bin: bin_x, bin_y, n."""
    return table.groupBy(F.floor(F.col("x_nm") / bin_nm).alias("bin_x"), F.floor(F.col("y_nm") / bin_nm).alias("bin_y")).agg(F.count("*").alias("n"))


def current(rows: DataFrame) -> DataFrame:
    """Compact table of the last frame: x_px, y_px, sigma_x_px, sigma_y_px, n_events."""
    last = rows.agg(F.max("frame").alias("frame"))
    named = rows.select("frame", F.col("x").alias("x_px"), F.col("y").alias("y_px"), F.col("sigma_x").alias("sigma_x_px"), F.col("sigma_y").alias("sigma_y_px"), "n_events")
    return named.join(F.broadcast(last), "frame").drop("frame")  # one row


def markers(rows: DataFrame) -> DataFrame:
    """Crosshair overlay: single-precision positions."""
    return rows.select("frame", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"))


def highlights(measures: DataFrame) -> DataFrame:
    """Highlighted pixel of each cluster: its rounded centroid."""
    at = lambda c: F.greatest(F.round(c), F.lit(0.0)).cast("int")
    return measures.select("frame", "cluster_id", at("centroid_x").alias("x"), at("centroid_y").alias("y"))


def frame_status(frames: DataFrame, events: DataFrame, members: DataFrame, fits: DataFrame, kept: DataFrame) -> DataFrame:
    """Counts of each frame, empty frames too: events, candidates, accepted and rejected fits."""
    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("frame").agg(F.count("*").alias(name))

    out = frames.select("frame").join(count(events, "n_events"), "frame", "left")
    out = out.join(count(members.select("frame", "cluster_id").distinct(), "n_candidates"), "frame", "left")
    out = out.join(count(kept, "n_accepted"), "frame", "left").na.fill(0)
    return out.withColumn("n_rejected", F.col("n_candidates") - F.col("n_accepted"))


def mean_background(rows: DataFrame) -> DataFrame:
    return rows.groupBy("frame").agg(F.avg("background").alias("mean_background"))
