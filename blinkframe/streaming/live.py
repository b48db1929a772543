"""Structured Streaming forms: frame images with a watermark, tracks, precision and focus as keyed state, an append-only table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from blinkframe.operators.postproc import Tracks


def frame_counts(stream: DataFrame, frame: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Events by pixel of tumbling frames of a stream with a timestamp column ``ts``; frames are given out once they are past the watermark."""
    windowed = stream.withWatermark("ts", late).groupBy(F.window("ts", frame).alias("w"), "x", "y")
    return windowed.agg(F.count("*").alias("n"), F.count_if("polarity").alias("n_pos")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "x", "y", "n", "n_pos")


TOLD = "session string, frame long, n_ended long, sum_length long, n_distances long, sigma_px double"
STATE = "x array<double>, y array<double>, length array<long>, n long, d2 double, last long"


def _nearest(points: np.ndarray) -> np.ndarray:
    if len(points) < 2:
        return np.zeros(0)
    d2 = ((points[:, None] - points[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    return d2.min(1)


def evaluated(stream: DataFrame) -> DataFrame:
    """Tracks and running precision of localizations (session, frame, nth, x, y), a row for each frame.

    State is the active tracks and two sums. Frames of a session have to arrive in order from one batch to the next; rows
    of a frame that was closed already are dropped, and a gap of frames ends all tracks.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        xs, ys, lengths, n, d2, last = state.get if state.exists else ([], [], [], 0, 0.0, None)
        tracks = Tracks(active=list(zip(xs, ys, lengths, strict=True)))
        rows = pd.concat(list(batches))
        if last is not None:
            rows = rows[rows["frame"] > last]
        out = []
        for frame, part in rows.sort_values(["frame", "nth"], kind="stable").groupby("frame", sort=True):
            ended = tracks.step([]) if last is not None and frame > last + 1 else []
            points = part[["x", "y"]].to_numpy(float)
            ended += tracks.step([tuple(p) for p in points.tolist()])
            near = _nearest(points)
            n, d2, last = n + len(near), d2 + float(near.sum()), int(frame)
            out.append((key[0], last, len(ended), sum(ended), n, float(np.sqrt(d2 / (2 * n))) if n else None))
        state.update(([float(t[0]) for t in tracks.active], [float(t[1]) for t in tracks.active], [int(t[2]) for t in tracks.active], n, d2, last))
        yield pd.DataFrame(out, columns=["session", "frame", "n_ended", "sum_length", "n_distances", "sigma_px"])

    return stream.groupBy("session").applyInPandasWithState(step, TOLD, STATE, "append", "NoTimeout")


FOCUSED = "session string, frame long, metric double, history array<double>, missing boolean"


def focused(stream: DataFrame, depth: int = 120) -> DataFrame:
    """Focus history of a stream of (session, frame, kind, metric), a row for each frame.

    ``kind`` is value, missing (no localizations came: the last metric and the history stay, and the row says so) or reset,
    which clears the session. A value that is null leaves the history alone as well. State is the history and the last metric.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history, last = state.get if state.exists else ([], None)
        history, out = list(history), []
        for frame, kind, metric in pd.concat(list(batches)).sort_values("frame", kind="stable")[["frame", "kind", "metric"]].itertuples(index=False):
            if kind == "reset":
                history, last = [], None
            elif kind == "value" and not pd.isna(metric):
                last = float(metric)
                history = [*history, last][-depth:]
            out.append((key[0], frame, last, list(history), kind == "missing"))
        state.update((history, last))
        yield pd.DataFrame(out, columns=["session", "frame", "metric", "history", "missing"]).astype({"metric": "float64"})

    return stream.groupBy("session").applyInPandasWithState(step, FOCUSED, "history array<double>, last double", "append", "NoTimeout")


def append_table(stream: DataFrame, path: str, checkpoint: str):
    """Write accumulated rows to Parquet as they come, each with the generation (batch) that brought it."""

    def write(batch: DataFrame, generation: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/generation={generation}")

    return stream.writeStream.foreachBatch(lambda b, g: write(b.drop("generation"), g)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
