"""Post-processing of a session as a stream: drift with feedback, nearest neighbours, point spread and tracks as keyed state.

Input rows are (session, frame, kind, nth, x, y, sigma_x, sigma_y). ``kind`` is point; or empty, for a frame whose payload
holds no points; missing, for a frame without one; reset, disable or enable, which take effect ahead of their frame. A frame
is closed when a later one of its session comes, or by a timer once the watermark has passed its end. What comes for a frame
that was closed before is dropped, apart from resets and switches: these take effect at once.

State is a ring of the last frames' corrected points, the open frame, the tracks of the last step and three numbers. Sums of
distances and of the point spread aren't state: each closed frame gives its part, and readers add up what they want.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blinkframe.operators.postproc import PATCH_RADIUS, Tracks, best_shift

INPUT = "session string, frame long, kind string, nth long, x double, y double, sigma_x double, sigma_y double"
CLOSED = (
    "session string, epoch long, step long, frame long, presence string, nth array<long>, x array<double>, y array<double>, shift_x double, shift_y double, "
    "ended array<long>, active array<long>, n_distances long, d2 double, n_patch long, patch array<double>"
)
RESETS = ("reset", "disable")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def nearest(points: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest other; none of a single point.

    Points in order of x are compared with the k-th after and before them, k = 1, 2, ..., each until that is farther in x
    alone than the nearest found: memory is that of the points.
    """
    n = len(points)
    if n < 2:
        return np.zeros(0)
    order = np.argsort(points[:, 0], kind="stable")
    x, y = points[order, 0], points[order, 1]
    best = np.full(n, np.inf)
    for step in (1, -1):
        some, k = np.arange(n), step
        while len(some):
            some = some[(some + k >= 0) & (some + k < n)]
            dx = np.abs(x[some + k] - x[some])
            best[some] = np.minimum(best[some], np.hypot(dx, y[some + k] - y[some]))
            some, k = some[dx < best[some]], k + step
    found = np.empty(n)
    found[order] = best
    return found


def patch(points: np.ndarray, sigma: np.ndarray, radius: int = PATCH_RADIUS) -> np.ndarray:
    """Sum of Gaussian patches about the sub-pixel positions of points, row by row."""
    reach = np.arange(-radius, radius + 1)
    off = reach - (points - np.trunc(points))[:, :, None]
    wide = np.maximum(sigma, 1.0)[:, :, None]
    u, v = np.moveaxis(np.exp(-0.5 * off * off / (wide * wide)), 1, 0)
    return (v.T @ u).ravel()


@dataclass
class Session:
    """What a session holds between frames; ``close`` takes one frame on."""

    window: int
    drift: bool
    epoch: int = 0
    step: int = 0
    off: bool = False
    last: int | None = None
    ring: dict[int, tuple[int, np.ndarray]] = field(default_factory=dict)
    active: list[tuple] = field(default_factory=list)
    touched: set[int] = field(default_factory=set)

    def told(self, action: str) -> None:
        """A reset or switch."""
        if action in RESETS:
            self.epoch, self.step = self.epoch + 1, 0
            self.ring, self.active, self.touched = {}, [], set()
        if action != "reset":
            self.off = action == "disable"

    def close(self, frame: int, presence: str, rows: np.ndarray) -> tuple:
        """Row of CLOSED, without the session; ``rows`` are nth, x, y, sigma_x, sigma_y in order of nth."""
        self.last = frame
        if self.off or presence == "missing":
            return (self.epoch, None, frame, "off" if self.off else presence, [], [], [], 0.0, 0.0, [], [t[2] for t in self.active], 0, 0.0, 0, None)
        self.step += 1
        points, shift = rows[:, 1:3], (0.0, 0.0)
        if self.drift:
            held = [p for step, p in self.ring.values() if step >= self.step - self.window]
            shift = best_shift(np.concatenate(held) if held else np.zeros((0, 2)), points)
            points = points - np.array(shift)
            slot = self.step % self.window
            self.ring[slot] = (self.step, points)
            self.touched.add(slot)
        tracks = Tracks(active=self.active)
        ended = tracks.step([tuple(p) for p in points.tolist()])
        self.active = tracks.active
        near = nearest(points)
        spread = patch(points, rows[:, 3:5]).tolist() if len(rows) else None
        return (
            self.epoch, self.step, frame, "filled" if len(rows) else "empty", rows[:, 0].astype(np.int64).tolist(), points[:, 0].tolist(), points[:, 1].tolist(),
            *map(float, shift), [int(n) for n in ended], [int(t[2]) for t in self.active], len(near), float((near * near).sum()), len(rows), spread,
        )


COLUMNS = ["session", "epoch", "step", "frame", "presence", "nth", "x", "y", "shift_x", "shift_y", "ended", "active", "n_distances", "d2", "n_patch", "patch"]


class SessionProcessor(StatefulProcessor):
    """Keeps a :class:`Session` and its open frame in Spark's state store."""

    def __init__(self, window: int, drift: bool, timed: bool) -> None:
        self.window, self.drift, self.timed = max(window, 1), drift, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "epoch long, step long, off boolean, last long, open long, presence string, xs array<double>, ys array<double>, lengths array<long>")
        self.ring = handle.getMapState("ring", "slot long", "step long, xs array<double>, ys array<double>")
        self.rows = handle.getListState("rows", "nth long, x double, y double, sigma_x double, sigma_y double")

    def _loaded(self) -> tuple[Session, int | None, str]:
        state = Session(self.window, self.drift)
        if not self.now.exists():
            return state, None, "empty"
        state.epoch, state.step, state.off, state.last, open_frame, presence, xs, ys, lengths = self.now.get()
        state.active = list(zip(xs, ys, lengths, strict=True))
        for (slot,), (step, px, py) in self.ring.iterator():
            state.ring[slot] = (step, np.column_stack([np.asarray(px, float), np.asarray(py, float)]))
        return state, open_frame, presence

    def _stored(self, state: Session, open_frame: int | None, presence: str, fresh: bool) -> None:
        if fresh:
            self.ring.clear()
        for slot in state.ring if fresh else state.touched:
            step, points = state.ring[slot]
            self.ring.updateValue((slot,), (step, points[:, 0].tolist(), points[:, 1].tolist()))
        xs, ys, lengths = ([t[i] for t in state.active] for i in range(3))
        self.now.update((state.epoch, state.step, state.off, state.last, open_frame, presence, [float(v) for v in xs], [float(v) for v in ys], [int(v) for v in lengths]))

    def _held(self) -> np.ndarray:
        rows = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        return np.array(rows, float).reshape(-1, 5)

    def _frame(self, key: Any, made: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in made], columns=COLUMNS).astype({"step": "Int64"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = pd.concat(list(rows))
        state, frame, presence = self._loaded()
        epoch, made = state.epoch, []
        held = self._held()
        part["points"] = part["kind"] == "point"
        for number, own in part.sort_values(["frame", "points", "nth"], kind="stable").groupby("frame", sort=True):
            actions = [k for k in own["kind"] if k in ("reset", "disable", "enable")]
            payload = own[~own["kind"].isin(["reset", "disable", "enable"])]
            if frame is not None and number > frame:
                made.append(state.close(frame, presence, held[np.argsort(held[:, 0], kind="stable")]))
                frame, held = None, np.zeros((0, 5))
            for action in actions:
                state.told(action)
            if (state.last is not None and number <= state.last) or (frame is not None and number < frame) or not len(payload):
                continue
            points = payload.loc[payload["points"], ["nth", "x", "y", "sigma_x", "sigma_y"]].to_numpy(float)
            brought = "missing" if (payload["kind"] == "missing").all() else "empty"
            presence = brought if frame is None or presence == "missing" else presence
            frame, held = int(number), np.concatenate([held, points])
        self.rows.put([tuple([int(r[0]), *map(float, r[1:])]) for r in held]) if len(held) else self.rows.clear()
        self._stored(state, frame, presence, state.epoch != epoch)
        if self.timed and frame is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(part["ends"].max().timestamp() * 1000))
        yield self._frame(key, made)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, frame, presence = self._loaded()
        made = []
        if frame is not None:
            held = self._held()
            made.append(state.close(frame, presence, held[np.argsort(held[:, 0], kind="stable")]))
            self.rows.clear()
            self._stored(state, None, "empty", False)
        yield self._frame(key, made)

    def close(self) -> None:
        pass


def processed(stream: DataFrame, window: int = 50, drift: bool = True, ends: str | None = None, late: str = "0 seconds") -> DataFrame:
    """A row for each closed frame of a stream of :data:`INPUT` rows, see :data:`CLOSED`; one key is one session.

    ``ends`` names a timestamp column with the end of a row's frame: the watermark on it, ``late`` behind, then closes the
    last open frame. Needs the RocksDB state store.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    rows = stream.select("session", "frame", "kind", "nth", "x", "y", "sigma_x", "sigma_y", *([F.col(ends).alias("ends")] if ends else []))
    if ends:
        rows = rows.withWatermark("ends", late)
    processor = SessionProcessor(window, drift, ends is not None)
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=processor, outputStructType=CLOSED, outputMode="Append", timeMode="EventTime" if ends else "None")


def folded_precision(closed: DataFrame) -> DataFrame:
    """session, epoch, n, sigma_px of all closed frames so far."""
    sums = closed.groupBy("session", "epoch").agg(F.sum("n_distances").alias("n"), F.sum("d2").alias("d2"))
    return sums.filter("n > 0").select("session", "epoch", "n", F.sqrt(F.col("d2") / (2 * F.col("n"))).alias("sigma_px"))


def folded_patch(closed: DataFrame, radius: int = PATCH_RADIUS) -> DataFrame:
    """session, epoch, dx, dy, value: the mean patch of all closed frames so far."""
    side = 2 * radius + 1
    cells = closed.filter("n_patch > 0").select("session", "epoch", "n_patch", F.posexplode("patch").alias("at", "sum"))
    means = cells.groupBy("session", "epoch", "at").agg((F.sum("sum") / F.sum("n_patch")).alias("value"))
    return means.select("session", "epoch", (F.col("at") % side - radius).cast("int").alias("dx"), (F.floor(F.col("at") / side) - radius).cast("int").alias("dy"), "value")


def folded_tracks(closed: DataFrame) -> DataFrame:
    """session, epoch, length, n: tracks that ended, and those that are active in an epoch's last step."""
    ended = closed.select("session", "epoch", F.explode("ended").alias("length"))
    last = closed.groupBy("session", "epoch").agg(F.max_by("active", F.col("frame")).alias("active"))
    return ended.unionByName(last.select("session", "epoch", F.explode("active").alias("length"))).groupBy("session", "epoch", "length").agg(F.count("*").alias("n"))
