"""Queries of the localization engine by name, and their DuckDB SQL.

Doubles are rounded on both sides: sums run in any order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blinkframe import oracle as O  # noqa: N812
from blinkframe.config import CandidateSettings, Finding, Fit, FittingSettings, Focus, LocalizationSettings, Polarity, PostprocSettings
from blinkframe.operators import clusters, fitters, focus, images, localize, postproc
from blinkframe.operators.rangejoin import neighbours
from blinkframe.sources import calendar, events, published
from blinkframe.sources.retained import History
from blinkframe.sources.shared import checkpoint, shared_folder

#: Geometry of the fixtures.
SENSOR = {"width": events.WIDTH, "height": events.HEIGHT}
FRAME_US = events.FRAME_US
SCATTERED = {"eps": 2.0, "least": 4}
EMITTERS = {"eps": 2.0, "least": 5}
DRIFT_WINDOW = 3
#: Wider than the defaults, so that fits of the fixtures pass in numbers.
LOOSE = FittingSettings(max_fit_residual=2.0, sigma_min_nm=40.0, sigma_max_nm=400.0)
WIDE = {"low_nm": 40.0, "high_nm": 400.0}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.dbscan(events.emitters(spark, sf_dir), EMITTERS["eps"], EMITTERS["least"])


def fits(spark: SparkSession, sf_dir: str, method: Fit = Fit.LOG_GAUSSIAN) -> DataFrame:
    return fitters.fit_clusters(clusters.histogram(members(spark, sf_dir)), method)


def localizations(spark: SparkSession, sf_dir: str, settings: FittingSettings = LOOSE) -> DataFrame:
    """Accepted, timed log-Gaussian fits of the emitters; clusters and fits are found once, whatever is made of them."""
    own = checkpoint(members(spark, sf_dir))
    found = fitters.fit_clusters(clusters.histogram(own), Fit.LOG_GAUSSIAN)
    return checkpoint(fitters.timed(fitters.accepted(found, Fit.LOG_GAUSSIAN, settings), own, clusters.measured(own)))


_MEM = O.dbscan(**EMITTERS)
_SCAT = O.dbscan(**SCATTERED)
_ACCEPTED = "kept AS (SELECT * FROM fit WHERE NOT (residual > {r}) AND sigma_x * 65.0 BETWEEN {a} AND {b} AND sigma_y * 65.0 BETWEEN {a} AND {b})"
_LOOSE = _ACCEPTED.format(r=2.0, a=40.0, b=400.0)
_LOC = [O.EM, _MEM, O.MEASURES, O.HIST, O.log_gaussian().replace("    fit AS", "    fit AS"), _LOOSE, O.TIMED.replace("FROM fit JOIN cl", "FROM kept AS fit JOIN cl")]
_FIT = "SELECT frame, cluster_id, round(x, 6) AS x, round(y, 6) AS y, round(sigma_x, 6) AS sigma_x, round(sigma_y, 6) AS sigma_y, round(residual, 6) AS residual FROM fit"


# Events and frames.


@register("cd_events", O.query(O.EV, "SELECT * FROM ev"))
def _(spark, sf):
    return events.scattered(spark, sf)


@register("polarity_filter", O.query(O.EV, "SELECT frame, count(*) AS n, min(event_seq) AS first FROM ev WHERE polarity GROUP BY frame"))
def _(spark, sf):
    return events.with_polarity(events.scattered(spark, sf), Polarity.POSITIVE).groupBy("frame").agg(F.count("*").alias("n"), F.min("event_seq").alias("first"))


@register("frame_windows", O.query(O.EV, f"SELECT f AS frame, f * {O.F_US} AS window_start_us, (f + 1) * {O.F_US} AS window_end_us FROM (SELECT unnest(range(min(frame), max(frame) + 1)) AS f FROM ev)"))
def _(spark, sf):
    return events.frames(events.scattered(spark, sf), frame_us=FRAME_US)


@register("history_range", O.query(O.EV, "SELECT count(DISTINCT frame) AS frame_count, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS event_count, min(timestamp_us) AS oldest_timestamp_us FROM ev WHERE timestamp_us >= 400000000 AND timestamp_us < 1500000000"))
def _(spark, sf):
    return events.history_range(events.scattered(spark, sf), 400_000_000, 1_500_000_000)


@register("retained_history", O.query(O.EV, "SELECT count(DISTINCT frame) AS frame_count, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS event_count, min(timestamp_us) AS oldest_timestamp_us, count(DISTINCT timestamp_us // 100000000) AS n_blocks FROM ev WHERE timestamp_us >= 600000000 AND timestamp_us < 1500000000"))
def _(spark, sf):
    """Two deliveries, the second of them twice; blocks that end before 650 s are gone, whatever the range asks for."""
    own, kept = events.scattered(spark, sf), History(f"{shared_folder(spark)}/history-{uuid.uuid4().hex}", 100_000_000)
    kept.add(own.filter("event_seq % 2 = 0"), "even")
    for _ in range(2):
        kept.add(own.filter("event_seq % 2 = 1"), "odd")
    kept.expire(spark, 650_000_000)
    found = kept.read(spark, 400_000_000, 1_500_000_000)
    return events.history_range(found, 400_000_000, 1_500_000_000, F.countDistinct("block").alias("n_blocks"))


@register("published_generations", O.query(O.EV, """counts AS (
      SELECT 1 AS run, frame, count(*) AS n FROM ev GROUP BY frame UNION ALL SELECT 2, frame, count(*) FROM ev GROUP BY frame
      UNION ALL SELECT 3, frame, count(*) FROM ev WHERE polarity GROUP BY frame UNION ALL SELECT 4, frame, count(*) FROM ev WHERE polarity GROUP BY frame)""",
    "tables AS (SELECT run, list([frame, n] ORDER BY frame) AS content, count(*) AS n_rows, sum(n)::BIGINT AS n_events FROM counts GROUP BY run)",
    "told AS (SELECT *, lag(content) OVER (ORDER BY run) IS DISTINCT FROM content AS changed FROM tables)",
    "SELECT run, sum(changed::INT) OVER (ORDER BY run)::BIGINT AS generation, n_rows, n_events FROM told"))
def _(spark, sf):
    """Counts by frame of four runs, the second with the rows of the first and the fourth with those of the third in other partitions."""
    folder, out = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}", []
    own = events.scattered(spark, sf)
    for run, rows in enumerate((own, own, own.filter("polarity"), own.filter("polarity")), 1):
        counts = rows.groupBy("frame").agg(F.count("*").alias("n"))
        generation = published.publish(counts if run % 2 else counts.repartition(7), folder)
        seen = published.read(spark, folder, generation).agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_events"))
        out.append(seen.select(F.lit(run).alias("run"), F.lit(generation).cast("long").alias("generation"), "n_rows", "n_events"))
    return reduce(DataFrame.unionByName, out)


@register("source_fallback", O.query(O.EV, "SELECT frame, count(*) AS n FROM ev WHERE (frame % 2 = 0 AND polarity) OR (frame % 2 = 1 AND NOT polarity) GROUP BY frame"))
def _(spark, sf):
    own = events.scattered(spark, sf)
    return events.preferred(own.filter("frame % 2 = 0 and polarity"), own.filter("not polarity"), events.frames(own, frame_us=FRAME_US)).groupBy("frame").agg(F.count("*").alias("n"))


@register("source_warnings", O.query(O.EV, "all_frames AS (SELECT unnest(range(min(frame), max(frame) + 1)) AS frame FROM ev)", """
    sources AS (
      SELECT frame, CASE WHEN frame % 5 IN (0, 4) AND frame IN (SELECT frame FROM ev) THEN 'raw' WHEN frame % 5 = 3 AND frame IN (SELECT frame FROM ev WHERE NOT polarity) THEN 'frame'
                         WHEN frame % 5 = 1 AND frame IN (SELECT frame FROM ev) THEN 'counts' ELSE 'none' END AS source FROM all_frames)""", """
    SELECT frame, 'warning' AS severity, 'localization' AS stage,
           CASE source WHEN 'counts' THEN 'Raw events are missing for this frame; preview counts are used.' ELSE 'This frame has neither events nor preview counts.' END AS message
    FROM sources WHERE source IN ('counts', 'none')"""))
def _(spark, sf):
    return events.source_warnings(sources(spark, sf)[3], "localization")


@register("sourced_image", O.query(O.EV, "src AS (SELECT * FROM ev WHERE frame % 5 IN (0, 3, 4) AND (frame % 5 <> 3 OR NOT polarity))", O.image(True).replace("img AS", "weighted AS").replace("FROM ev", "FROM src"), "SELECT * FROM weighted UNION ALL SELECT frame, x, y, count(*)::DOUBLE FROM ev WHERE frame % 5 = 1 GROUP BY ALL"))
def _(spark, sf):
    return images.sourced_image(*sources(spark, sf), True, FRAME_US, **SENSOR)


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Raw events without those of some frames, frame events of one of them, preview counts of another, and every frame's source."""
    own = events.scattered(spark, sf_dir)
    raw, second = own.filter("frame % 5 in (0, 4)"), own.filter("frame % 5 = 3 and not polarity")
    preview = own.filter("frame % 5 not in (2, 3)").groupBy("frame", "x", "y").agg(F.count("*").alias("n"))
    return raw, second, preview, events.source_of(raw, second, preview, events.frames(own, frame_us=FRAME_US))


# Images.


@register("analysis_image_signed", O.query(O.EV, O.image(True), "SELECT * FROM img"))
def _(spark, sf):
    return images.analysis_image(events.scattered(spark, sf), True, frame_us=FRAME_US, **SENSOR)


@register("analysis_image_unsigned", O.query(O.EV, O.image(False), "SELECT * FROM img"))
def _(spark, sf):
    return images.analysis_image(events.scattered(spark, sf), False, frame_us=FRAME_US, **SENSOR)


@register("counted_image", O.query(O.EV, "SELECT frame, x, y, count(*)::DOUBLE AS value FROM ev GROUP BY ALL"))
def _(spark, sf):
    return images.counted_image(events.scattered(spark, sf), **SENSOR)


@register("wavelet_planes", O.query(O.EV, O.image(False), O.WAVELET, "SELECT frame, x::INT AS x, y::INT AS y, round(f1, 3) AS f1, round(f2, 3) AS f2 FROM planes"))
def _(spark, sf):
    return rounded(images.wavelet_planes(images.analysis_image(events.scattered(spark, sf), False, frame_us=FRAME_US, **SENSOR), **SENSOR), 3)


@register("wavelet_f1_sigma", O.query(O.EV, O.image(True), O.WAVELET, "SELECT frame, round(stddev_pop(f1), 3) AS sigma FROM planes GROUP BY frame"))
def _(spark, sf):
    return rounded(images.plane_sigma(images.analysis_image(events.scattered(spark, sf), True, frame_us=FRAME_US, **SENSOR), **SENSOR), 3)


@register("local_maxima", O.query(O.EV, O.image(False), O.spots(most=100_000), "SELECT frame, x::INT AS x, y::INT AS y, round(value, 3) AS value FROM spots"))
def _(spark, sf):
    found = images.spots(images.analysis_image(events.scattered(spark, sf), False, frame_us=FRAME_US, **SENSOR), most=100_000, **SENSOR)
    return rounded(found.select("frame", "x", "y", "value"), 3)


@register("spot_top_k", O.query(O.EV, O.image(True), O.spots(most=20), "SELECT frame, rank::INT AS rank, x::INT AS x, y::INT AS y, round(value, 3) AS value, round(com_x, 6) AS com_x, round(com_y, 6) AS com_y FROM spots"))
def _(spark, sf):
    found = images.spots(images.analysis_image(events.scattered(spark, sf), True, frame_us=FRAME_US, **SENSOR), most=20, **SENSOR)
    return found.withColumns({"value": F.round("value", 3), "com_x": F.round("com_x", 6), "com_y": F.round("com_y", 6)})


@register("threshold_pixels", O.query(O.EV, "px AS (SELECT frame, x, y, count(*)::DOUBLE AS value FROM ev GROUP BY ALL)", "SELECT frame, x, y, value FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY y, x) AS nth FROM px WHERE value >= 2) WHERE nth <= 256"))
def _(spark, sf):
    return images.above_threshold(images.counted_image(events.scattered(spark, sf), **SENSOR), 2)


@register("downsample", O.query(O.EV, "b AS (SELECT frame, x // 6 AS bx, y // 5 AS b_y, count(*) AS n FROM ev GROUP BY ALL)", "SELECT frame, bx, b_y AS \"by\", round(n / ((least((bx + 1) * 6, 128) - bx * 6) * (least((b_y + 1) * 5, 96) - b_y * 5)), 6) AS value FROM b"))
def _(spark, sf):
    return rounded(images.downsampled(images.counted_image(events.scattered(spark, sf), **SENSOR), 22, **SENSOR))


@register("focus_fft", O.query(O.EV, O.SPECTRUM, "SELECT frame, round(avg(re * re + im * im), 4) AS metric FROM ring JOIN varied USING (frame) WHERE radius BETWEEN 0.25 AND 0.9 GROUP BY frame"))
def _(spark, sf):
    return rounded(images.spectral_focus(images.counted_image(events.scattered(spark, sf), **SENSOR), **SENSOR), 4)


# Clusters.


@register("neighbour_pairs", O.query(O.EV, "SELECT a.frame, a.event_seq, count(*) AS n, sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2)::DOUBLE AS d2 FROM ev a JOIN ev b ON a.frame = b.frame AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4 GROUP BY ALL"))
def _(spark, sf):
    own = events.scattered(spark, sf).select("frame", "event_seq", "x", "y")
    return neighbours(own, 2.0)


@register("dbscan_labels", O.query(O.EV, _SCAT, "SELECT frame, event_seq, cluster_id FROM mem", recursive=True))
def _(spark, sf):
    return clusters.dbscan(events.scattered(spark, sf), SCATTERED["eps"], SCATTERED["least"]).select("frame", "event_seq", "cluster_id")


@register("dbscan_tiles", O.query(O.EV, _SCAT, "SELECT frame, event_seq, cluster_id FROM mem", recursive=True))
def _(spark, sf):
    return clusters.dbscan(events.scattered(spark, sf), SCATTERED["eps"], SCATTERED["least"], tile=16).select("frame", "event_seq", "cluster_id")


@register("cluster_summary", O.query(O.EV, _SCAT, O.MEASURES, "SELECT frame, cluster_id, n_events, n_positive, n_negative, round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y, x_min, x_max, y_min, y_max, round(polarity_balance, 6) AS polarity_balance, round(lambda_1, 6) + 0.0 AS lambda_1 FROM cl", recursive=True))
def _(spark, sf):
    found = clusters.measured(clusters.dbscan(events.scattered(spark, sf), SCATTERED["eps"], SCATTERED["least"]))
    return rounded(found.select("frame", "cluster_id", "n_events", "n_positive", "n_negative", "centroid_x", "centroid_y", "x_min", "x_max", "y_min", "y_max", "polarity_balance", "lambda_1"))


@register("cluster_histogram", O.query(O.EM, _MEM, O.HIST, "SELECT frame, cluster_id, x, y, n_pos, n_neg FROM hist", recursive=True))
def _(spark, sf):
    return clusters.histogram(members(spark, sf))


@register("cluster_nested", O.query(O.EM, _MEM, "SELECT frame, cluster_id, count(DISTINCT (x, y)) AS n_pixels, count(*) AS n_listed, min(event_seq) AS first FROM mem GROUP BY ALL", recursive=True))
def _(spark, sf):
    return clusters.nested(members(spark, sf)).select("frame", "cluster_id", F.size("pixels").cast("long").alias("n_pixels"), F.size("events").cast("long").alias("n_listed"), F.get("events", F.lit(0)).alias("first"))


@register("eigenfeature", O.query(O.EV, O.dbscan(2.0, 2), O.MEASURES, "SELECT frame, cluster_id, n_events, round(isotropy, 5) AS isotropy FROM cl WHERE n_events >= 2 AND lambda_1 <= 4.0 AND isotropy >= 0.25", recursive=True))
def _(spark, sf):
    kept = clusters.compact(clusters.dbscan(events.scattered(spark, sf), 2.0, 2), 2.0, 0.25)
    return clusters.measured(kept).select("frame", "cluster_id", "n_events", F.round("isotropy", 5).alias("isotropy"))


@register("frame_clusters", O.query(O.EM, O.image(False), O.spots(most=64), "SELECT frame, cluster_id, count(*) AS n, min(event_seq) AS first FROM (SELECT e.frame, s.rank AS cluster_id, e.event_seq FROM spots s JOIN ev e ON e.frame = s.frame AND (e.x - s.x) ** 2 + (e.y - s.y) ** 2 <= 16) GROUP BY ALL HAVING count(*) >= 5"))
def _(spark, sf):
    settings = CandidateSettings(finding_method=Finding.FRAME_BASED, max_candidates=64)
    return clusters.around_spots(events.emitters(spark, sf), settings, frame_us=FRAME_US, **SENSOR).groupBy("frame", "cluster_id").agg(F.count("*").alias("n"), F.min("event_seq").alias("first"))


@register("top_candidates", O.query(O.EV, _SCAT, "c AS (SELECT frame, cluster_id, count(*) AS n FROM mem GROUP BY ALL)", "SELECT frame, cluster_id, n FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, cluster_id) AS k FROM c) WHERE k <= 10", recursive=True))
def _(spark, sf):
    own = clusters.dbscan(events.scattered(spark, sf), SCATTERED["eps"], SCATTERED["least"])
    return clusters.largest(own, 10).groupBy("frame", "cluster_id").agg(F.count("*").alias("n"))


@register("highlight_pixels", O.query(O.EM, _MEM, O.MEASURES, "SELECT frame, cluster_id, greatest(round(centroid_x), 0)::INT AS x, greatest(round(centroid_y), 0)::INT AS y FROM cl", recursive=True))
def _(spark, sf):
    return localize.highlights(clusters.measured(members(spark, sf)))


# Fits.


@register("fit_mean_xy", O.query(O.EM, _MEM, O.HIST, O.MEAN_XY, _FIT, recursive=True))
def _(spark, sf):
    return rounded(fits(spark, sf, Fit.MEAN_XY))


@register("fit_phasor", O.query(O.EM, _MEM, O.HIST, O.PHASOR, _FIT, recursive=True))
def _(spark, sf):
    return rounded(fits(spark, sf, Fit.PHASOR))


@register("fit_log_gaussian", O.query(O.EM, _MEM, O.HIST, O.log_gaussian(), _FIT.replace(", 6)", ", 4)"), recursive=True))
def _(spark, sf):
    return rounded(fits(spark, sf), 4)


@register("fit_gaussian", O.query(O.EM, _MEM, O.HIST, O.cluster_gaussian(), _FIT.replace(", 6)", ", 4)"), recursive=True))
def _(spark, sf):
    return rounded(fits(spark, sf, Fit.GAUSSIAN), 4)


@register("fit_radial", O.query(O.EM, _MEM, O.HIST, O.RADIAL, _FIT, recursive=True))
def _(spark, sf):
    return rounded(fits(spark, sf, Fit.RADIAL))


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Localizations of the emitters' images, by the default settings."""
    own = events.emitters(spark, sf_dir)
    image = images.analysis_image(own, True, frame_us=FRAME_US, **SENSOR)
    settings = LocalizationSettings()
    found = fitters.window_fits(image, images.spots(image, settings.threshold_factor, **SENSOR), settings.fit_radius_px, settings.initial_sigma_px, **SENSOR)
    return localize.timed(localize.credible(found, settings), own, float(settings.fit_radius_px), frame_us=FRAME_US)


_ROI_SET = LocalizationSettings()
_ROI = [
    O.EM, O.image(True), O.spots(_ROI_SET.threshold_factor), O.window_gaussian(_ROI_SET.fit_radius_px, _ROI_SET.initial_sigma_px),
    O.credible(_ROI_SET.sigma_min_nm, _ROI_SET.sigma_max_nm, _ROI_SET.max_xy_uncertainty_nm, _ROI_SET.fit_radius_px),
]
#: Amplitudes and errors are sums of microseconds, of nine digits and more: they are compared in milliseconds.
_ROI_ROW = "SELECT frame, rank::INT AS rank, round(x, 3) AS x, round(y, 3) AS y, round(sigma_x, 3) AS sigma_x, round(sigma_y, 3) AS sigma_y, round(amplitude / 1e3) AS amplitude, round(background / 1e3) AS background, round(fit_error / 1e3) AS fit_error, timestamp_us // 10 * 10 AS timestamp_us FROM loc"


@register("localize_roi", O.query(*_ROI, _ROI_ROW, recursive=True))
def _(spark, sf):
    whole = [F.round(F.col(c) / 1e3).alias(c) for c in ("amplitude", "background", "fit_error")]
    return rois(spark, sf).select("frame", "rank", *[F.round(c, 3).alias(c) for c in ("x", "y", "sigma_x", "sigma_y")], *whole, F.expr("timestamp_us div 10 * 10").alias("timestamp_us"))


@register("mean_background", O.query(*_ROI, "SELECT frame, round(avg(background) / 1e3) AS mean_background FROM loc GROUP BY frame", recursive=True))
def _(spark, sf):
    return localize.mean_background(rois(spark, sf)).select("frame", F.round(F.col("mean_background") / 1e3).alias("mean_background"))


@register("fit_filter", O.query(O.EM, _MEM, O.HIST, O.log_gaussian(), _ACCEPTED.format(r=0.5, a=80.0, b=200.0), "SELECT frame, cluster_id, round(x, 4) AS x, round(residual, 4) AS residual FROM kept", recursive=True))
def _(spark, sf):
    return rounded(fitters.accepted(fits(spark, sf), Fit.LOG_GAUSSIAN, FittingSettings()).select("frame", "cluster_id", "x", "residual"), 4)


@register("fit_timestamp", O.query(*_LOC, "SELECT frame, cluster_id, timestamp_us, n_events, round(polarity_balance, 6) AS polarity_balance FROM loc", recursive=True))
def _(spark, sf):
    return localizations(spark, sf).select("frame", "cluster_id", "timestamp_us", "n_events", F.round("polarity_balance", 6).alias("polarity_balance"))


@register("standard_rows", O.query(*_LOC, "SELECT frame, cluster_id, round(x, 4) AS x, round(y, 4) AS y, round(sigma_x, 4) AS sigma_x, round(sigma_y, 4) AS sigma_y, 0.0::DOUBLE AS amplitude, 0.0::DOUBLE AS background, timestamp_us, round(residual, 4) AS fit_error FROM loc", recursive=True))
def _(spark, sf):
    return rounded(localize.standard(localizations(spark, sf)), 4)


@register("frame_status", O.query(*_LOC, "all_frames AS (SELECT unnest(range(min(frame), max(frame) + 1)) AS frame FROM ev)", """
    SELECT f.frame, (SELECT count(*) FROM ev e WHERE e.frame = f.frame) AS n_events, (SELECT count(*) FROM cl c WHERE c.frame = f.frame) AS n_candidates,
           (SELECT count(*) FROM loc l WHERE l.frame = f.frame) AS n_accepted, (SELECT count(*) FROM cl c WHERE c.frame = f.frame) - (SELECT count(*) FROM loc l WHERE l.frame = f.frame) AS n_rejected
    FROM all_frames f""", recursive=True))  # fmt: skip
def _(spark, sf):
    own, found = events.emitters(spark, sf), members(spark, sf)
    return localize.frame_status(events.frames(own, frame_us=FRAME_US), own, found, None, localizations(spark, sf))


# Post-processing.


@register("postproc_filter", O.query(*_LOC, "SELECT frame, cluster_id, n_events, round(polarity_balance, 6) AS polarity_balance FROM loc WHERE n_events >= 60 AND abs(polarity_balance) <= 0.3 AND residual <= 0.6", recursive=True))
def _(spark, sf):
    kept = postproc.passing(localizations(spark, sf), PostprocSettings(min_n_events=60, max_polarity_imbalance=0.3, max_fit_residual=0.6))
    return kept.select("frame", "cluster_id", "n_events", F.round("polarity_balance", 6).alias("polarity_balance"))


@register("drift_shift", O.query(*_LOC, O.drift(DRIFT_WINDOW), "SELECT frame, round(shift_x, 5) AS shift_x, round(shift_y, 5) AS shift_y, overlap FROM shifts", recursive=True))
def _(spark, sf):
    points = localizations(spark, sf).select("frame", "x", "y")
    return rounded(postproc.window_shifts(points, DRIFT_WINDOW), 5)


@register("drift_apply", O.query(*_LOC, O.drift(DRIFT_WINDOW), "SELECT frame, cluster_id, round(x - shift_x, 4) AS x, round(y - shift_y, 4) AS y FROM loc JOIN shifts USING (frame)", recursive=True))
def _(spark, sf):
    own = localizations(spark, sf)
    points = own.select("frame", "x", "y")
    return rounded(postproc.moved(own, postproc.window_shifts(points, DRIFT_WINDOW)).select("frame", "cluster_id", "x", "y"), 4)


@register("drift_feedback", O.query(*_LOC, O.feedback(50), "SELECT 'all' AS session, loc.frame, cluster_id, round(x - shift_x, 4) AS x, round(y - shift_y, 4) AS y, round(shift_x, 4) AS shift_x, round(shift_y, 4) AS shift_y FROM loc JOIN fold ON fold.frame = loc.frame", recursive=True))
def _(spark, sf):
    own = localizations(spark, sf).select(F.lit("all").alias("session"), "frame", "cluster_id", "x", "y")
    return rounded(postproc.drift_fold(own, 50), 4)


@register("nn_distance", O.query(*_LOC, O.NEIGHBOURS, "SELECT frame, cluster_id, round(distance, 5) AS distance FROM nn", recursive=True))
def _(spark, sf):
    return rounded(postproc.neighbour_distances(localizations(spark, sf)), 5)


@register("nn_recent", O.query(*_LOC, O.NEIGHBOURS, "SELECT frame, cluster_id, round(distance, 5) AS distance FROM nn ORDER BY frame DESC, cluster_id DESC LIMIT 32", recursive=True))
def _(spark, sf):
    return rounded(postproc.recent_distances(postproc.neighbour_distances(localizations(spark, sf))), 5)


@register("enena", O.query(*_LOC, O.NEIGHBOURS, "s AS (SELECT frame, sum(distance ** 2) AS d2, count(*) AS k FROM nn GROUP BY frame)", "SELECT frame, (sum(k) OVER w)::BIGINT AS n, round(sqrt(sum(d2) OVER w / (2 * sum(k) OVER w)), 5) AS sigma_px, round(sqrt(sum(d2) OVER w / (2 * sum(k) OVER w)) * 65.0, 4) AS sigma_nm FROM s WINDOW w AS (ORDER BY frame)", recursive=True))
def _(spark, sf):
    found = postproc.precision(postproc.neighbour_distances(localizations(spark, sf)))
    return found.withColumns({"sigma_px": F.round("sigma_px", 5), "sigma_nm": F.round("sigma_nm", 4)})


@register("psf_patch", O.query(*_LOC, "o AS (SELECT range - 4 AS d FROM range(9))", "SELECT a.d::INT AS dx, b.d::INT AS dy, round(avg(exp(-0.5 * ((a.d - (x - trunc(x))) ** 2 / greatest(sigma_x, 1.0) ** 2 + (b.d - (y - trunc(y))) ** 2 / greatest(sigma_y, 1.0) ** 2))), 6) AS value FROM loc, o a, o b GROUP BY ALL", recursive=True))
def _(spark, sf):
    return rounded(postproc.spread_patch(localizations(spark, sf)))


@register("tracks", O.query(*_LOC, O.TRACKS, "SELECT 'all' AS session, length FROM tracks", recursive=True))
def _(spark, sf):
    own = localizations(spark, sf).withColumn("session", F.lit("all"))
    return postproc.track_lengths(own)


@register("on_time", O.query(*_LOC, O.TRACKS, "SELECT 'all' AS session, length, count(*) AS n FROM tracks GROUP BY length", recursive=True))
def _(spark, sf):
    return postproc.on_time(QUERIES["tracks"](spark, sf))


# Resets and missing payloads.


def known_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Localizations of one session, and its calendar: payloads that are missing or empty, resets, a stage switched off and on."""
    rows = localizations(spark, sf_dir).withColumn("session", F.lit("all")).filter("frame % 4 not in (1, 2)")
    frames = events.frames(events.emitters(spark, sf_dir), frame_us=FRAME_US).select(F.lit("all").alias("session"), "frame")
    told = lambda when, nth, action: frames.filter(when).select("session", "frame", F.lit(nth).cast("long").alias("nth"), F.lit(action).alias("action"))
    controls = told("frame % 5 = 3", 0, calendar.RESET).unionByName(told("frame % 9 = 6", 0, calendar.DISABLE)).unionByName(told("frame % 9 = 7", 1, calendar.ENABLE))
    return rows, calendar.calendar(frames.filter("frame % 4 <> 2"), rows, controls)


_CALENDAR = """
    all_frames AS (SELECT unnest(range(min(frame), max(frame) + 1)) AS frame FROM ev),
    told AS (SELECT frame FROM all_frames WHERE frame % 4 <> 2 OR frame % 5 = 3 OR frame % 9 IN (6, 7)),
    kinds AS (
      SELECT frame, CASE WHEN frame % 4 = 2 THEN 0 WHEN frame % 4 <> 1 AND frame IN (SELECT frame FROM loc) THEN 2 ELSE 1 END AS kind,
             (frame % 5 = 3)::INT + (frame % 9 = 6)::INT AS resets, CASE frame % 9 WHEN 6 THEN true WHEN 7 THEN false END AS off
      FROM all_frames WHERE frame BETWEEN (SELECT min(frame) FROM told) AND (SELECT max(frame) FROM told)
    ), epochs AS (SELECT *, sum(resets) OVER (ORDER BY frame) AS epoch, coalesce(last_value(off IGNORE NULLS) OVER (ORDER BY frame), false) AS is_off FROM kinds),
    cal AS (
      SELECT frame, CASE WHEN is_off THEN 'off' WHEN kind = 2 THEN 'filled' WHEN kind = 1 THEN 'empty' ELSE 'missing' END AS presence, epoch::BIGINT AS epoch,
             CASE WHEN kind > 0 AND NOT is_off THEN count(*) FILTER (kind > 0 AND NOT is_off) OVER (PARTITION BY epoch ORDER BY frame) ELSE 0 END AS step FROM epochs
    ), stepped AS (SELECT loc.*, epoch, step FROM loc JOIN cal USING (frame) WHERE step > 0 AND loc.frame % 4 NOT IN (1, 2))"""


@register("reset_epochs", O.query(*_LOC, _CALENDAR, "SELECT 'all' AS session, frame, presence, epoch, step FROM cal", recursive=True))
def _(spark, sf):
    return known_frames(spark, sf)[1].withColumn("step", F.coalesce("step", F.lit(0)))


@register("epoch_table", O.query(*_LOC, _CALENDAR, "SELECT epoch, frame, cluster_id, row_number() OVER (PARTITION BY epoch ORDER BY frame, cluster_id) - 1 AS id, round(x * 65.0, 2) AS x_nm FROM stepped", recursive=True))
def _(spark, sf):
    rows, known = known_frames(spark, sf)
    table = localize.accumulated(localize.standard(calendar.stepped(rows, known)).withColumn("timestamp_us", F.col("cluster_id")), ["cluster_id"], by=["session", "epoch"])
    return table.select("epoch", "frame", F.col("timestamp_us").alias("cluster_id"), "id", F.round("x_nm", 2).alias("x_nm"))


@register("epoch_tracks", O.query(*_LOC, _CALENDAR, O.TRACKS.replace("SELECT row_number() OVER (ORDER BY frame, cluster_id) AS i, frame, x, y FROM loc", "SELECT row_number() OVER (ORDER BY epoch, step, cluster_id) AS i, epoch * 1000000000 + step AS frame, x, y FROM stepped"), "SELECT length, count(*) AS n FROM tracks GROUP BY length", recursive=True))
def _(spark, sf):
    rows, known = known_frames(spark, sf)
    lengths = postproc.track_lengths(calendar.in_steps(calendar.stepped(rows, known)))
    return lengths.groupBy("length").agg(F.count("*").alias("n"))


@register("epoch_precision", O.query(*_LOC, O.NEIGHBOURS, _CALENDAR, """
    s AS (SELECT epoch, step, sum(distance ** 2) AS d2, count(*) AS k FROM nn JOIN stepped USING (frame, cluster_id) GROUP BY ALL)""",
    "SELECT epoch, step, (sum(k) OVER w)::BIGINT AS n, round(sqrt(sum(d2) OVER w / (2 * sum(k) OVER w)), 5) AS sigma_px FROM s WINDOW w AS (PARTITION BY epoch ORDER BY step)", recursive=True))
def _(spark, sf):
    rows, known = known_frames(spark, sf)
    own = calendar.in_steps(calendar.stepped(rows, known))
    found = postproc.precision(postproc.neighbour_distances(own, by=["session", "frame"]), by=["session"])
    return found.select(F.substring_index("session", "/", -1).cast("long").alias("epoch"), F.col("frame").alias("step"), "n", F.round("sigma_px", 5).alias("sigma_px"))


# Accumulated table and views.

_ACC = """acc AS (
      SELECT row_number() OVER (ORDER BY frame, cluster_id) - 1 AS id, frame, x * 65.0 AS x_nm, y * 65.0 AS y_nm, (sigma_x + sigma_y) / 2 * 65.0 AS sigma_nm,
             0.0::DOUBLE AS intensity, 0.0::DOUBLE AS "offset", (sigma_x + sigma_y) / 2 * 65.0 AS uncertainty_xy_nm, timestamp_us FROM loc)"""
_ACC_ROW = 'SELECT id, frame, round(x_nm, 2) AS x_nm, round(y_nm, 2) AS y_nm, round(sigma_nm, 2) AS sigma_nm, intensity, "offset", round(uncertainty_xy_nm, 2) AS uncertainty_xy_nm, timestamp_us FROM acc'


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localize.accumulated(localize.standard(localizations(spark, sf_dir)), ["cluster_id"])


@register("accumulate_nm", O.query(*_LOC, _ACC, _ACC_ROW, recursive=True))
def _(spark, sf):
    return rounded(table(spark, sf), 2)


@register("fifo_cap", O.query(*_LOC, _ACC, _ACC_ROW + " ORDER BY id DESC LIMIT 50", recursive=True))
def _(spark, sf):
    return rounded(localize.newest(table(spark, sf), 50), 2)


@register("rescale_nm", O.query(*_LOC, _ACC, "SELECT id, round(x_nm * 2, 2) AS x_nm, round(sigma_nm * 2, 2) AS sigma_nm FROM acc", recursive=True))
def _(spark, sf):
    return rounded(localize.rescaled(table(spark, sf), 65.0, 130.0).select("id", "x_nm", "sigma_nm"), 2)


@register("density2d", O.query(*_LOC, _ACC, "SELECT floor(x_nm / 200)::BIGINT AS bin_x, floor(y_nm / 200)::BIGINT AS bin_y, count(*) AS n FROM acc GROUP BY ALL", recursive=True))
def _(spark, sf):
    return localize.density(table(spark, sf), 200.0)


@register("current_table", O.query(*_LOC, "SELECT round(x, 4) AS x_px, round(y, 4) AS y_px, round(sigma_x, 4) AS sigma_x_px, round(sigma_y, 4) AS sigma_y_px, n_events FROM loc WHERE frame = (SELECT max(frame) FROM loc)", recursive=True))
def _(spark, sf):
    return rounded(localize.current(localizations(spark, sf)), 4)


@register("overlay_markers", O.query(*_LOC, "SELECT frame, round(x::FLOAT, 2) AS x, round(y::FLOAT, 2) AS y FROM loc", recursive=True))
def _(spark, sf):
    return localize.markers(localizations(spark, sf)).select("frame", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


# Focus.

_SIGMA = O.focus("(sigma_x + sigma_y) / 2 * 65.0", "sigma_x * 65.0 BETWEEN 40 AND 400 AND sigma_y * 65.0 BETWEEN 40 AND 400")
_ASTIG = O.focus("sigma_x / sigma_y", "sigma_x * 65.0 BETWEEN 40 AND 400 AND sigma_y * 65.0 BETWEEN 40 AND 400 AND abs(sigma_y) > 2.220446049250313e-16")


@register("focus_mean_sigma", O.query(*_LOC, _SIGMA, "SELECT frame, round(metric, 3) AS metric FROM metrics", recursive=True))
def _(spark, sf):
    return rounded(focus.mean_sigma(localizations(spark, sf), **WIDE), 3)


@register("focus_astig", O.query(*_LOC, _ASTIG, "SELECT frame, round(metric, 4) AS metric FROM metrics", recursive=True))
def _(spark, sf):
    return rounded(focus.astigmatism(localizations(spark, sf), **WIDE), 4)


@register("focus_quality", O.query(*_LOC, _SIGMA, """
    SELECT frame, CASE WHEN count(*) OVER w < 4 THEN 'Collecting' WHEN (max(metric) OVER w - metric) / greatest(max(metric) OVER w - min(metric) OVER w, 1e-9) >= 0.66 THEN 'Good'
           WHEN (max(metric) OVER w - metric) / greatest(max(metric) OVER w - min(metric) OVER w, 1e-9) >= 0.33 THEN 'Fair' ELSE 'Poor' END AS quality
    FROM metrics WINDOW w AS (ORDER BY frame ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""", recursive=True))  # fmt: skip
def _(spark, sf):
    return focus.quality(focus.mean_sigma(localizations(spark, sf), **WIDE), Focus.MEAN_SIGMA, 16).select("frame", "quality")


@register("focus_quality_astig", O.query(*_LOC, _ASTIG, "SELECT frame, CASE WHEN abs(metric - 1) <= 0.05 THEN 'Good' WHEN abs(metric - 1) <= 0.12 THEN 'Fair' ELSE 'Poor' END AS quality FROM metrics", recursive=True))
def _(spark, sf):
    return focus.quality(focus.astigmatism(localizations(spark, sf), **WIDE), Focus.ASTIGMATISM).select("frame", "quality")


@register("focus_trend", O.query(*_LOC, _SIGMA, """t AS (
      SELECT frame, count(*) OVER (ORDER BY frame ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS n, avg(metric) OVER (ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS now,
             avg(metric) OVER (ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 3 PRECEDING) AS was FROM metrics)""",
    "SELECT frame, CASE WHEN n < 6 THEN 'flat' WHEN now - was < -0.01 * greatest(abs(was), 1.0) THEN 'down' WHEN now - was > 0.01 * greatest(abs(was), 1.0) THEN 'up' ELSE 'flat' END AS trend FROM t", recursive=True))
def _(spark, sf):
    return focus.trend(focus.mean_sigma(localizations(spark, sf), **WIDE), Focus.MEAN_SIGMA, 16).select("frame", "trend")


@register("focus_history", O.query(*_LOC, _SIGMA, "SELECT frame, round(list_sum(list(metric) OVER w), 2) AS total, len(list(metric) OVER w) AS kept FROM metrics WINDOW w AS (ORDER BY frame ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)", recursive=True))
def _(spark, sf):
    kept = focus.history(focus.mean_sigma(localizations(spark, sf), **WIDE), 16)
    return kept.select("frame", F.round(F.aggregate("history", F.lit(0.0), lambda t, x: t + x), 2).alias("total"), F.size("history").cast("long").alias("kept"))
