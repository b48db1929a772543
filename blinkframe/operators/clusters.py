"""Clusters of events in a frame: density, covariance and spot based."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blinkframe.config import CandidateSettings, Finding
from blinkframe.functions.components import components
from blinkframe.operators.images import analysis_image, spots
from blinkframe.operators.rangejoin import within
from blinkframe.sources.events import with_polarity
from blinkframe.sources.shared import checkpoint


#: Pixels a side of the tiles that frames of larger sensors are cut into.
TILE = 512


def _near(x: np.ndarray, y: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of pixels within ``eps`` of each other, each with itself too."""
    reach = math.floor(eps)
    key = y.astype(np.int64) << 32 | (x + (1 << 30))
    order = np.argsort(key)
    sorted_key = key[order]
    pairs = []
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            if dx * dx + dy * dy <= eps * eps:
                want = ((y + dy).astype(np.int64) << 32) | (x + dx + (1 << 30))
                at = np.minimum(np.searchsorted(sorted_key, want), len(key) - 1)
                hit = np.flatnonzero(sorted_key[at] == want)
                pairs.append(np.stack([hit, order[at[hit]]]))
    a, b = np.concatenate(pairs, 1)
    return a, b


def _roots(first: np.ndarray, core: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least event number among the core pixels that hang together with each core pixel; the largest number for others."""
    far = np.iinfo(np.int64).max
    root = np.where(core, first, far)
    linked = core[a] & core[b]
    u, v = a[linked], b[linked]
    while True:
        new = root.copy()
        np.minimum.at(new, u, root[v])
        if (new == root).all():
            return root
        root = new


def dbscan(events: DataFrame, eps: float, min_events: int, tile: int | None = None) -> DataFrame:
    """Events of clusters with their ``cluster_id``, the least event_seq of the cluster's core; noise is dropped.

    Events of a pixel share their fate, so a frame's task holds its pixels, not its events. A pixel is core if at least
    ``min_events`` events lie within ``eps``; a border pixel goes to the cluster with the least root. With ``tile`` a frame
    is cut into squares of so many pixels a side, each a task's group of its own; clusters are the same for any size.
    """
    eps, min_events = max(eps, 1.0), max(min_events, 1)
    pixels = events.groupBy("frame", "x", "y").agg(F.count("*").alias("n"), F.min("event_seq").alias("first"))
    labels = _whole(pixels, eps, min_events) if tile is None else _tiled(pixels, eps, min_events, tile)
    return events.join(labels, ["frame", "x", "y"])


def _whole(pixels: DataFrame, eps: float, least: int) -> DataFrame:
    """Labels of pixels (frame, x, y, cluster_id), a frame at a time."""

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = _near(rows["x"].to_numpy(np.int64), rows["y"].to_numpy(np.int64), eps)
        core = np.bincount(a, rows["n"].to_numpy()[b], len(rows)) >= least
        root = _roots(rows["first"].to_numpy(np.int64), core, a, b)
        border = ~core[a] & core[b]
        np.minimum.at(root, a[border], root[b[border]])
        return rows[["frame", "x", "y"]].assign(cluster_id=root)[root < np.iinfo(np.int64).max]

    return pixels.groupBy("frame").applyInPandas(label, "frame long, x int, y int, cluster_id long")


def _tiled(pixels: DataFrame, eps: float, least: int, tile: int) -> DataFrame:
    """The same by tiles. A tile gets the pixels within twice ``eps`` around it, so that it knows the core pixels within ``eps``.

    Clusters of a tile have a root of their own; a core pixel near an edge is known to several tiles and links its roots.
    Components of these links, rows for pixels along the edges alone, give the roots of whole clusters.
    """
    reach = math.floor(eps)
    wide = 2 * reach
    spread = lambda c: F.expr(f"sequence(cast(floor(({c} - {wide}) / {tile}) as int), cast(floor(({c} + {wide}) / {tile}) as int))")
    dealt = pixels.withColumn("tx", F.explode(spread("x"))).withColumn("ty", F.explode(spread("y")))

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, first = (rows[c].to_numpy(np.int64) for c in ("x", "y", "first"))
        left, top = int(rows["tx"].iloc[0]) * tile, int(rows["ty"].iloc[0]) * tile
        edge = np.minimum.reduce([x - left, left + tile - 1 - x, y - top, top + tile - 1 - y])  # below 0 outside of the tile
        a, b = _near(x, y, eps)
        core = (np.bincount(a, rows["n"].to_numpy()[b], len(rows)) >= least) & (edge >= -reach)
        root = _roots(first, core, a, b)
        border = ~core[a] & core[b] & (edge[a] >= 0)
        at = np.append(np.flatnonzero(core), a[border])
        made = pd.DataFrame({"frame": rows["frame"].iloc[0], "x": x[at], "y": y[at], "first": first[at], "core": core[at], "own": edge[at] >= 0, "edge": edge[at] < reach, "root": np.append(root[core], root[b[border]])})
        return made.drop_duplicates()

    schema = "frame long, x int, y int, first long, core boolean, own boolean, edge boolean, root long"
    told = checkpoint(dealt.groupBy("frame", "tx", "ty").applyInPandas(label, schema))
    links = told.filter("core and edge").select("frame", F.col("first").alias("u"), F.col("root").alias("v"))
    joined = components(links, ["frame"]).select("frame", F.col("root").alias("whole"), F.col("id").alias("root"))
    return told.filter("own").join(joined, ["frame", "root"], "left").groupBy("frame", "x", "y").agg(F.min(F.coalesce("whole", "root")).alias("cluster_id"))


def measured(members: DataFrame) -> DataFrame:
    """Measures of each cluster: counts, centroid, box, covariance eigenvalues and isotropy.

    Pixels are whole numbers, so sums of them and of their products are exact in any order: n squared times a covariance is
    a whole number, and equal clusters have equal measures however their rows were dealt.
    """
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    out = members.groupBy("frame", "cluster_id").agg(
        F.count("*").alias("n_events"), F.count_if("polarity").alias("n_positive"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    n = F.col("n_events")
    spread = lambda a, b, ab: (n * F.col(ab) - F.col(a) * F.col(b)).cast("double")
    out = out.withColumns({"vx": spread("sx", "sx", "sxx"), "vy": spread("sy", "sy", "syy"), "vxy": spread("sx", "sy", "sxy")})
    across = F.col("vx") - F.col("vy")
    out = out.withColumn("root", F.sqrt(across * across + 4 * F.col("vxy") * F.col("vxy")))
    twice = 2 * (n * n).cast("double")
    large, small = F.col("vx") + F.col("vy") + F.col("root"), F.col("vx") + F.col("vy") - F.col("root")
    return out.select(
        "frame", "cluster_id", "n_events", "n_positive", (F.col("sx") / n).alias("centroid_x"), (F.col("sy") / n).alias("centroid_y"), "x_min", "x_max", "y_min", "y_max",
        (n - F.col("n_positive")).alias("n_negative"), (large / twice).alias("lambda_1"), (small / twice).alias("lambda_2"),
        ((2 * F.col("n_positive") - n) / n).alias("polarity_balance"),
        F.when(large / twice <= 1e-9, 1.0).otherwise(F.greatest(small, F.lit(0.0)) / large).alias("isotropy"),
    )


def histogram(members: DataFrame) -> DataFrame:
    """Events by pixel of each cluster: frame, cluster_id, x, y, n_pos, n_neg."""
    return members.groupBy("frame", "cluster_id", "x", "y").agg(F.count_if("polarity").alias("n_pos"), F.count_if(~F.col("polarity")).alias("n_neg"))


def nested(members: DataFrame) -> DataFrame:
    """A row for each cluster with its histogram and event numbers as sorted arrays."""
    pixels = histogram(members).groupBy("frame", "cluster_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "n_pos", "n_neg"))).alias("pixels"))
    events = members.groupBy("frame", "cluster_id").agg(F.sort_array(F.collect_list("event_seq")).alias("events"))
    return measured(members).join(pixels, ["frame", "cluster_id"]).join(events, ["frame", "cluster_id"])


def compact(members: DataFrame, extent: float, isotropy: float) -> DataFrame:
    """Members of clusters of two events or more that are small and round enough."""
    kept = measured(members).filter((F.col("n_events") >= 2) & (F.col("lambda_1") <= extent * extent) & (F.col("isotropy") >= isotropy))
    return members.join(kept.select("frame", "cluster_id"), ["frame", "cluster_id"])


def around_spots(events: DataFrame, settings: CandidateSettings, frame_us: int, width: int, height: int) -> DataFrame:
    """Events around each spot; clusters may overlap. ``cluster_id`` is the spot's rank."""
    found = spots(analysis_image(events, False, frame_us, width, height), settings.threshold_factor, settings.max_candidates, width=width, height=height)
    centres = found.select("frame", "x", "y", F.col("rank").cast("long").alias("cluster_id"))
    near = within(events, centres, float(settings.fit_radius_px)).withColumnRenamed("r_cluster_id", "cluster_id")
    enough = near.groupBy("frame", "cluster_id").count().filter(F.col("count") >= settings.min_events)
    return near.join(enough.select("frame", "cluster_id"), ["frame", "cluster_id"]).select(*events.columns, "cluster_id")


def largest(members: DataFrame, most: int) -> DataFrame:
    """Members of the ``most`` clusters of each frame with most events, earlier clusters first among equals."""
    rank = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("n"), "cluster_id"))
    kept = members.groupBy("frame", "cluster_id").agg(F.count("*").alias("n")).withColumn("rank", rank).filter(F.col("rank") <= most)
    return members.join(kept.select("frame", "cluster_id"), ["frame", "cluster_id"])


def candidates(events: DataFrame, settings: CandidateSettings, frame_us: int, width: int, height: int) -> DataFrame:
    """Members of candidate clusters by the method that is set."""
    chosen = with_polarity(events, settings.polarity)
    tile = TILE if max(width, height) > TILE else None
    if settings.finding_method is Finding.FRAME_BASED:
        members = around_spots(chosen, settings, frame_us, width, height)
    elif settings.finding_method is Finding.EIGENFEATURE:
        members = compact(dbscan(chosen, settings.epsilon_px, max(settings.min_events - 2, 2), tile), settings.max_spatial_extent_px, settings.min_isotropy)
    else:
        members = dbscan(chosen, settings.epsilon_px, settings.min_events, tile)
    return largest(members, settings.max_candidates)
