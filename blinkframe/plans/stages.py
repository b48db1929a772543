"""Stages and how they hang together, and the views of their results.

A stage is a function from the results before it to a DataFrame. Raw-event stages come first, then derived ones, each after
the stages it names; a stage that is off, or whose input is missing, has no result and a diagnostic says so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blinkframe.config import CandidateSettings, FittingSettings, FocusSettings, GlobalSettings, LocalizationSettings, PostprocSettings, ReconstructionSettings, Settings, ThresholdSettings
from blinkframe.operators import clusters, fitters, focus, images, localize, postproc
from blinkframe.sources import published

PHASES = ("frames", "events", "derived")
Build = Callable[[dict[str, DataFrame], Settings, GlobalSettings], DataFrame]


@dataclass(frozen=True)
class Stage:
    name: str
    title: str
    reads: str  # one of PHASES
    after: tuple[str, ...]
    settings: Settings
    build: Build
    enabled: bool = True
    #: Results that are used if they are there; a stage waits for them as for those it needs.
    optional: tuple[str, ...] = ()
    description: str = ""
    version: str = "1.0.0"

    def put(self, key: str, value) -> Stage:
        return replace(self, settings=self.settings.put(key, value))


def _localized(have: dict[str, DataFrame], s: LocalizationSettings, g: GlobalSettings) -> DataFrame:
    sensor = {"width": g.sensor_width, "height": g.sensor_height}
    image = images.analysis_image(have["events"], True, g.frame_us, **sensor)
    found = fitters.window_fits(image, images.spots(image, s.threshold_factor, **sensor), s.fit_radius_px, s.initial_sigma_px, **sensor)
    return localize.timed(localize.credible(found, s, g.nm(s.nm_per_pixel)), have["events"], float(s.fit_radius_px), g.frame_us)


def _counted(have: dict[str, DataFrame], g: GlobalSettings) -> DataFrame:
    return images.counted_image(have["events"], g.sensor_width, g.sensor_height)


def _fitted(have: dict[str, DataFrame], s: FittingSettings, g: GlobalSettings) -> DataFrame:
    members = have["candidates"]
    found = fitters.fit_clusters(clusters.histogram(members), s.fit_method)
    kept = fitters.accepted(found, s.fit_method, s, g.nm(s.nm_per_pixel))
    return fitters.timed(kept, members, clusters.measured(members)).withColumn("fit_method", F.lit(s.fit_method.name.lower()))


def _processed(have: dict[str, DataFrame], s: PostprocSettings, g: GlobalSettings) -> DataFrame:
    kept = postproc.passing(have["fits"], s)
    if not s.drift_correction_enabled:
        return kept
    # The frames of a session stream by, with the window alone held; rows without a session are one.
    if "session" in kept.columns:
        return postproc.drift_fold(kept, s.drift_window_frames)
    return postproc.drift_fold(kept.withColumn("session", F.lit("run")), s.drift_window_frames).drop("session")


def _by(rows: DataFrame) -> list[str]:
    """Columns that keep sessions and epochs apart, where rows have them."""
    return [c for c in ("session", "epoch") if c in rows.columns]


def _evaluated(have: dict[str, DataFrame], s: PostprocSettings, g: GlobalSettings) -> DataFrame:
    """Precision up to each frame, from nearest neighbours."""
    rows = have.get("postproc", have["fits"])
    by = _by(rows)
    return postproc.precision(postproc.neighbour_distances(rows, by=[*by, "frame"]), g.nm(s.nm_per_pixel), by)


def _on_time(have: dict[str, DataFrame], s: PostprocSettings, g: GlobalSettings) -> DataFrame:
    """Tracks by length, of each session or of the run."""
    rows = have.get("postproc", have["fits"])
    return postproc.on_time(postproc.track_lengths(rows if "session" in rows.columns else rows.withColumn("session", F.lit("run"))))


def _table(have: dict[str, DataFrame], s: ReconstructionSettings, g: GlobalSettings) -> DataFrame:
    rows = localize.standard(have.get("postproc", have["fits"]))
    by = _by(rows)
    return localize.newest(localize.accumulated(rows, ["cluster_id"], g.nm(s.nm_per_pixel), by), s.max_localizations, by)


def _focused(have: dict[str, DataFrame], s: FocusSettings, g: GlobalSettings) -> DataFrame:
    rows = have.get("postproc", have["fits"])
    metrics = {
        "MEAN_SIGMA": lambda: focus.mean_sigma(rows, s.sigma_min_nm, s.sigma_max_nm, g.nm(s.nm_per_pixel)),
        "ASTIGMATISM": lambda: focus.astigmatism(rows, s.sigma_min_nm, s.sigma_max_nm, g.nm(s.nm_per_pixel)),
        "FFT": lambda: images.spectral_focus(_counted(have, g), width=g.sensor_width, height=g.sensor_height),
    }[s.method.name]()
    return focus.trend(focus.quality(metrics, s.method, s.history_depth), s.method, s.history_depth)


STAGES = [
    Stage("threshold", "Bright pixels", "frames", (), ThresholdSettings(threshold=2), lambda have, s, g: images.above_threshold(_counted(have, g), s.threshold), description="Pixels with at least so many events in a frame."),
    Stage("localization", "Image localization", "events", (), LocalizationSettings(), _localized, description="Spots of time-weighted images, found by wavelets and fitted."),
    Stage("candidates", "Event clusters", "events", (), CandidateSettings(), lambda have, s, g: clusters.candidates(have["events"], s, g.frame_us, g.sensor_width, g.sensor_height), description="Clusters of events that may be molecules."),
    Stage("fits", "Cluster fits", "derived", ("candidates",), FittingSettings(), _fitted, description="Positions, widths and times of clusters."),
    Stage("postproc", "Limits and drift", "derived", ("fits",), PostprocSettings(), _processed, description="Fits within limits, corrected for drift."),
    Stage("precision", "Precision", "derived", ("fits",), PostprocSettings(), _evaluated, optional=("postproc",), description="Running precision from nearest neighbours."),
    Stage("point_spread", "Point spread", "derived", ("fits",), PostprocSettings(), lambda have, s, g: postproc.spread_patch(have.get("postproc", have["fits"])), optional=("postproc",), description="Mean patch of all localizations."),
    Stage("on_time", "On-time", "derived", ("fits",), PostprocSettings(), _on_time, optional=("postproc",), description="Lengths of tracks from frame to frame."),
    Stage("accumulated", "Accumulated table", "derived", ("fits",), ReconstructionSettings(), _table, optional=("postproc",), description="All localizations in nanometres, the newest up to a limit."),
    Stage("focus", "Focus metric", "derived", ("fits",), FocusSettings(), _focused, optional=("postproc",), description="Focus by width, ratio of widths or spectrum, with quality and trend."),
]


@dataclass
class Run:
    """Results of a run by stage name, and what was said on the way (severity, stage, message)."""

    results: dict[str, DataFrame]
    said: list[tuple[str, str, str]] = field(default_factory=list)
    generation: dict[str, int] = field(default_factory=dict)

    def diagnostics(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.said, "severity string, stage string, message string")

    def publish(self, prefix: str = "", folder: str | None = None) -> None:
        """Offer every result as a temporary view; a later run replaces it and counts one generation on.

        With a folder, results are written there and views read them: a result whose content is that of the run before, in
        this session or another, keeps its generation. Events are read, not published.
        """
        for name, rows in self.results.items():
            if folder is None:
                rows.createOrReplaceTempView(prefix + name)
                self.generation[name] = self.generation.get(name, 0) + 1
            elif name != "events":
                self.generation[name] = published.publish(rows, f"{folder}/{name}")
                published.read(rows.sparkSession, f"{folder}/{name}", self.generation[name]).createOrReplaceTempView(prefix + name)


def run(events: DataFrame, stages: list[Stage] = STAGES, known: GlobalSettings | None = None) -> Run:
    """Plan all enabled stages over ``events``; nothing is computed before a result is asked for."""
    done = Run({"events": events})
    waiting = sorted((s for s in stages if s.enabled), key=lambda s: PHASES.index(s.reads))
    while waiting:
        ready = [s for s in waiting if all(n in done.results or n not in {w.name for w in waiting} for n in (*s.after, *s.optional))]
        if not ready:
            raise ValueError("stages wait for each other: " + ", ".join(s.name for s in waiting))
        for stage in ready:
            waiting.remove(stage)
            if missing := [n for n in stage.after if n not in done.results]:
                done.said.append(("info", stage.name, f"needs {', '.join(missing)}"))
                continue
            done.results[stage.name] = stage.build(done.results, stage.settings, known or GlobalSettings())
    return done


@dataclass(frozen=True)
class View:
    """How a result is shown: a table, a compact table, a density, a scatter, an image or a series."""

    name: str
    dataset: str
    kind: str
    build: Callable[[DataFrame], DataFrame]


VIEWS = [
    View("accumulated.table", "accumulated", "table", lambda rows: rows),
    View("accumulated.density", "accumulated", "density", lambda rows: localize.density(rows, 100.0)),
    View("accumulated.scatter", "accumulated", "scatter", lambda rows: rows.select("x_nm", "y_nm")),
    View("fits.compact", "fits", "compact", localize.current),
    View("focus.series", "focus", "series", lambda rows: rows.select("frame", "metric").orderBy("frame")),
    View("threshold.image", "threshold", "image", lambda rows: rows),
]


def view(done: Run, name: str) -> DataFrame | None:
    """A view of a run; the compact table is that of the last stage that offers one. None if its data is missing."""
    found = next((v for v in VIEWS if v.name == name), None)
    if found is None:
        return None
    dataset = "postproc" if found.dataset == "fits" and "postproc" in done.results else found.dataset
    return found.build(done.results[dataset]) if dataset in done.results else None
