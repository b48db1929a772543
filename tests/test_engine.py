"""Operators of the localization engine on small inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blinkframe.config import CandidateSettings, Finding, Fit, FittingSettings, Focus, FocusSettings, GlobalSettings, LocalizationSettings, PostprocSettings, ReconstructionSettings, ThresholdSettings
from blinkframe.functions import ordered
from blinkframe.operators import clusters, fitters, focus, images, localize, postproc, rangejoin
from blinkframe.operators.rangejoin import within
from blinkframe.plans import stages
from blinkframe.registry import QUERIES
from blinkframe.sources import events

SENSOR = {"width": events.WIDTH, "height": events.HEIGHT}
FRAME_US = events.FRAME_US

CD = "frame long, event_seq long, x int, y int, timestamp_us long, polarity boolean"
ONE = [(10, 10), (10, 11), (11, 10), (11, 11), (9, 10), (10, 9), (9, 9), (11, 9), (9, 11), (12, 10)]
TWO = ONE[:5] + [(40, 40), (41, 40), (40, 41), (41, 41), (42, 40)]


def stream(spark, points, frame=0):
    return spark.createDataFrame([(frame, i, x, y, i + 1, True) for i, (x, y) in enumerate(points)], CD)


def sizes(members):
    return sorted(r["count"] for r in members.groupBy("frame", "cluster_id").count().collect())


def test_density_clusters(spark):
    assert sizes(clusters.dbscan(stream(spark, ONE), 1.5, 5)) == [10]
    assert sizes(clusters.dbscan(stream(spark, TWO), 1.5, 4)) == [5, 5]
    assert clusters.dbscan(stream(spark, [(1, 1), (9, 9)]), 1.5, 2).count() == 0


def sequential(points, eps, least):
    """Seed by seed: a border point stays with the first cluster that reaches it."""
    near = [[j for j, q in enumerate(points) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for p in points]
    owner = [None] * len(points)
    for seed in range(len(points)):
        if owner[seed] is None and len(near[seed]) >= least:
            todo = [seed]
            while todo:
                p = todo.pop()
                if owner[p] is None:
                    owner[p] = seed
                    if len(near[p]) >= least:
                        todo += near[p]
    groups = {}
    for i, o in enumerate(owner):
        if o is not None:
            groups.setdefault(o, []).append(i)
    return sorted(sorted(g) for g in groups.values())


def test_density_clusters_as_a_sequential_search(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for frame in range(60):
        points = [tuple(map(int, p)) for p in rng.integers(0, rng.integers(6, 25), (rng.integers(1, 60), 2))]
        rows += [(frame, frame * 1000 + i, x, y, 1, True) for i, (x, y) in enumerate(points)]
        want += [[frame * 1000 + i for i in g] for g in sequential(points, 1.5, 4)]
    got = clusters.dbscan(spark.createDataFrame(rows, CD), 1.5, 4).groupBy("frame", "cluster_id").agg(F.sort_array(F.collect_list("event_seq")).alias("g")).collect()
    assert sorted(r.g for r in got) == sorted(want)


def test_compact_rejects_lines(spark):
    line = [(0, i, 10 + i, 10, 1, True, 0) for i in range(5)]
    blob = [(0, 10 + i, x, y, 1, True, 10) for i, (x, y) in enumerate([(20, 20), (20, 21), (21, 20), (21, 21), (22, 20)])]
    members = spark.createDataFrame(line + blob, CD + ", cluster_id long")
    assert {r.cluster_id for r in clusters.compact(members, 4.0, 0.25).collect()} == {10}


def test_measures_and_histogram(spark):
    members = spark.createDataFrame([(0, 0, 10, 10, 1, True, 0), (0, 1, 10, 10, 2, False, 0), (0, 2, 11, 10, 3, True, 0), (0, 3, 10, 11, 4, True, 0)], CD + ", cluster_id long")
    row = clusters.nested(members).first()
    assert (row.n_events, row.n_positive, row.n_negative, len(row.pixels), row.polarity_balance) == (4, 3, 1, 3, 0.5)
    assert (row.centroid_x, row.centroid_y) == (10.25, 10.25)


def test_image_weights_recent_events_more(spark):
    two = spark.createDataFrame([(0, 0, 2, 1, 10, True), (0, 1, 2, 1, 20, False), (0, 2, 3, 1, 0, True)], CD)
    image = {(r.x, r.y): r.value for r in images.analysis_image(two, False, 1_000, 6, 4).collect()}
    assert image == {(2, 1): 30.0, (3, 1): 1.0}  # nothing weighs less than one
    assert images.analysis_image(two, True, 1_000, 6, 4).filter("x = 2").first().value == -10.0


def test_local_maxima_and_plateaus():
    image = np.zeros((5, 5))
    for x, y, v in [(1, 1, 3), (2, 1, 1), (1, 2, 1), (2, 2, 2), (3, 2, 1), (2, 3, 1), (3, 3, 4)]:
        image[y, x] = v
    assert {(int(x), int(y)) for y, x in zip(*np.nonzero(images.local_maxima(image)), strict=True)} == {(1, 1), (3, 3)}
    flat = np.zeros((5, 5))
    flat[2, 1:4] = 7
    assert images.local_maxima(flat).sum() == 3
    assert not images.local_maxima(np.ones((2, 9))).any()


def test_smoothing_repeats_the_border():
    assert np.array_equal(images.smooth(np.full((7, 9), 3.0), 2), np.full((7, 9), 3.0))
    assert images.centre_of_mass(np.zeros((3, 3)), 1, 2) == (1.0, 2.0)


def test_downsample(spark):
    image = spark.createDataFrame([(0, 6, 5, 200.0), (0, 16, 16, 8.0)], "frame long, x int, y int, value double")
    assert [(r.bx, r.by, r.value) for r in images.downsampled(image.filter("x < 16"), 8, width=16, height=16).collect()] == [(3, 2, 50.0)]
    assert images.downsampled(image.filter("x = 16"), 9, width=17, height=17).first().value == 8.0  # one pixel at the edge


def test_spectral_focus_is_the_naive_transform():
    rng = np.random.default_rng(2)
    image = rng.random((9, 12))
    h, w = image.shape
    centred, total = image - image.mean(), []
    for v in range(h):
        for u in range(w):
            fx = (u if u <= w // 2 else u - w) / (w / 2)
            fy = (v if v <= h // 2 else v - h) / (h / 2)
            if 0.25 <= math.hypot(fx, fy) <= 0.9:
                wave = np.exp(-2j * np.pi * (u * np.arange(w)[None, :] / w + v * np.arange(h)[:, None] / h))
                total.append(abs((centred * wave).sum()) ** 2)
    assert images.ring_power(image) == pytest.approx(np.mean(total))
    assert images.ring_power(np.ones((9, 9))) is None and images.ring_power(rng.random((7, 20))) is None


def pixels(spark, size, cx, cy, sx, sy, a, b, low=0):
    rows = []
    for y in range(low, size):
        for x in range(low, size):
            n = round(b + a * math.exp(-0.5 * ((x - cx) ** 2 / sx**2 + (y - cy) ** 2 / sy**2)))
            if n:
                rows.append((0, 1, x, y, n, 0))
    return spark.createDataFrame(rows, "frame long, cluster_id long, x int, y int, n_pos long, n_neg long")


@pytest.mark.parametrize(
    ("method", "args", "near", "sigma"),
    [
        (Fit.LOG_GAUSSIAN, (11, 6.3, 5.7, 1.4, 1.8, 50, 0, 1), 0.3, (1.4, 1.8)),
        (Fit.GAUSSIAN, (14, 6.2, 7.4, 1.5, 1.8, 45, 2), 0.2, (1.5, 1.8)),
        (Fit.RADIAL, (14, 6.1, 5.9, 1.4, 1.6, 50, 1), 0.3, None),
        (Fit.PHASOR, (12, 5.6, 7.1, 1.3, 1.3, 60, 1), 0.5, None),
        (Fit.MEAN_XY, (14, 6.0, 6.0, 1.4, 1.4, 50, 0), 0.1, None),
    ],
)
def test_fits_recover_the_centre(spark, method, args, near, sigma):
    row = fitters.fit_clusters(pixels(spark, *args), method).first()
    assert abs(row.x - args[1]) < near and abs(row.y - args[2]) < near
    if sigma:
        assert abs(row.sigma_x - sigma[0]) < 0.3 and abs(row.sigma_y - sigma[1]) < 0.3
    assert fitters.fit_clusters(pixels(spark, *args).filter("x < 0"), method).count() == 0


def test_small_clusters(spark):
    few = spark.createDataFrame([(0, 1, 3, 4, 2, 1), (0, 1, 4, 4, 1, 0)], "frame long, cluster_id long, x int, y int, n_pos long, n_neg long")
    for method in (Fit.LOG_GAUSSIAN, Fit.GAUSSIAN, Fit.RADIAL):
        assert fitters.fit_clusters(few, method).count() == 0
    assert fitters.fit_clusters(few, Fit.PHASOR).first().x == 3.25  # one row high: the centroid


def test_window_fit(spark):
    grid = [(0, x, y, 3 + 120 * math.exp(-0.5 * ((x - 10.3) ** 2 + (y - 9.7) ** 2) / 1.6**2)) for x in range(21) for y in range(21)]
    image = spark.createDataFrame(grid, "frame long, x int, y int, value double")
    spots = spark.createDataFrame([(0, 1, 10.0, 10.0), (0, 2, 2.0, 10.0)], "frame long, rank int, com_x double, com_y double")
    rows = fitters.window_fits(image, spots, 4, 1.6, width=21, height=21).collect()
    assert [r.rank for r in rows] == [1]  # the other window leaves the image
    assert abs(rows[0].x - 10.3) < 0.2 and abs(rows[0].sigma_x - 1.6) < 0.25


def test_a_seed_that_cannot_improve_is_no_fit():
    y, x = (v.ravel().astype(float) for v in np.mgrid[:9, :9])
    perfect = np.array([4, 4, 1.6, 1.6, 10, 1.0])
    value = 1 + 10 * np.exp(-0.5 * ((x - 4) ** 2 + (y - 4) ** 2) / 1.6**2)
    assert fitters.gaussian_fit(x, y, value, perfect, 15, -math.inf) is None


LOC = "frame long, cluster_id long, x double, y double, sigma_x double, sigma_y double, amplitude double, background double, timestamp_us long, fit_error double"


def test_accumulated_rows(spark):
    rows = spark.createDataFrame([(4, 0, 3.5, 4.0, 2.0, 2.0, 100.0, 7.5, 55, 0.1), (6, 0, 3.5, 4.0, 2.0, 2.0, 0.0, 7.5, 56, 0.1)], LOC)
    table = localize.accumulated(rows, ["cluster_id"])
    first, second = table.orderBy("id").collect()
    assert (first.id, first.x_nm, first.y_nm, first.sigma_nm, first.intensity, first.offset) == (0, 227.5, 260.0, 130.0, 100.0, 7.5)
    assert first.uncertainty_xy_nm == pytest.approx(13.0) and second.uncertainty_xy_nm == pytest.approx(130.0)
    assert [r.id for r in localize.newest(table, 1).collect()] == [1]
    assert localize.rescaled(table, 65.0, 130.0).orderBy("id").first().x_nm == 455.0
    assert localize.rescaled(table, 65.0, 65.0) is table


def test_limits_and_nan(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, 5, 0.0, 0.2), (2, 2, 0.0, 0.2), (3, 5, 0.9, 0.2), (4, 5, 0.0, nan), (5, 5, 0.0, inf)], "id long, n_events long, polarity_balance double, residual double")
    kept = postproc.passing(rows, PostprocSettings(min_n_events=3, max_polarity_imbalance=0.5))
    assert {r.id for r in kept.collect()} == {1, 5}
    fits = rows.withColumns({"sigma_x": F.lit(2.0), "sigma_y": F.lit(2.0)})
    assert {r.id for r in fitters.accepted(fits, Fit.LOG_GAUSSIAN, FittingSettings()).collect()} == {1, 2, 3, 4}


def points(spark, xy, frame=0):
    return spark.createDataFrame([(frame, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "frame long, cluster_id long, x double, y double")


BASE = [(10, 10), (30, 12), (16, 22), (40, 41), (23, 35)]


def test_drift(spark):
    same = points(spark, BASE)
    row = postproc.shifts(same, same).first()
    assert abs(row.shift_x) <= 0.1 and abs(row.shift_y) <= 0.1
    drifted = points(spark, [(x + 3, y - 2) for x, y in BASE])
    row = postproc.shifts(same, drifted).first()
    assert (row.shift_x, row.shift_y) == (-3.0, 2.0)
    assert postproc.moved(drifted, postproc.shifts(same, drifted), physical=True).orderBy("cluster_id").first().x == 10.0
    assert postproc.moved(drifted, postproc.shifts(same, drifted)).orderBy("cluster_id").first().x == 16.0
    far = postproc.shifts(same, points(spark, [(x + 500, y) for x, y in BASE])).first()
    assert (far.shift_x, far.shift_y, far.overlap) == (-8.0, -8.0, 0)
    alone = postproc.shifts(same, points(spark, BASE, 7)).first()
    assert (alone.frame, alone.shift_x) == (7, 0.0)


def test_drift_with_feedback(spark):
    rows = spark.createDataFrame([("s", f, i, float(x + 2 * f), float(y)) for f in range(3) for i, (x, y) in enumerate(BASE)], "session string, frame long, cluster_id long, x double, y double")
    kept = postproc.drift_fold(rows, 5, physical=True).filter("cluster_id = 0").orderBy("frame").collect()
    assert [r.x for r in kept] == pytest.approx([10.0, 10.0, 10.0])


def test_neighbours_and_precision(spark):
    rows = points(spark, [(0, 0), (3, 0), (10, 0)]).unionByName(points(spark, [(5, 5)], 1)).unionByName(points(spark, [(1, 1), (1, 1), (90, 90)], 2))
    found = postproc.neighbour_distances(rows).orderBy("frame", "cluster_id").collect()
    assert [r.distance for r in found[:5]] == [3.0, 3.0, 7.0, 0.0, 0.0] and found[5].distance == pytest.approx(89 * math.sqrt(2))
    sigma = postproc.precision(postproc.neighbour_distances(rows).filter("frame = 0")).first()
    assert sigma.sigma_px == pytest.approx(math.sqrt((9 + 9 + 49) / 6)) and sigma.sigma_nm == pytest.approx(65 * sigma.sigma_px)


def test_patch_keeps_the_sign_of_fractions(spark):
    rows = spark.createDataFrame([(-1.25, 2.0, 0.5, 2.0)], "x double, y double, sigma_x double, sigma_y double")
    patch = {(r.dx, r.dy): r.value for r in postproc.spread_patch(rows).collect()}
    assert len(patch) == 81 and patch[0, 0] == pytest.approx(math.exp(-0.5 * 0.25**2)) and patch[1, 2] == pytest.approx(math.exp(-0.5 * (1.25**2 + 1)))


def test_tracks(spark):
    tracks = postproc.Tracks()
    assert tracks.step([(0, 0), (10, 10)]) == []
    assert tracks.step([(1, 0), (1.4, 0)]) == [1]  # the second finds the track taken
    assert sorted(t[2] for t in tracks.active) == [1, 2]
    tie = postproc.Tracks(active=[(0.0, 0.0, 5), (2.0, 0.0, 9)])
    assert tie.step([(1.0, 0.0)]) == [5]  # the later of equals goes on
    rows = spark.createDataFrame([("a", 0, 0, 1.0, 1.0), ("a", 1, 0, 1.0, 1.0), ("a", 3, 0, 1.0, 1.0)], "session string, frame long, cluster_id long, x double, y double")
    assert sorted(r.length for r in postproc.track_lengths(rows).collect()) == [1, 2]  # the gap ends it


def moving_points(sessions=3, frames=14, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(sessions):
        at = rng.uniform(0, 14, (12, 2))
        for f in sorted(rng.choice(frames + 4, frames, replace=False).tolist()):
            at = at + rng.normal(0.2, 0.6, at.shape)
            rows += [(f"s{s}", int(f), i, float(x), float(y)) for i, (x, y) in enumerate(at[: rng.integers(3, 13)])]
    return rows


LOCATED = "session string, frame long, cluster_id long, x double, y double"


def test_tracks_against_a_plain_loop(spark):
    rows = moving_points()
    want = []
    for session in sorted({r[0] for r in rows}):
        own = {}
        for _, f, i, x, y in (r for r in rows if r[0] == session):
            own.setdefault(f, []).append((i, x, y))
        tracks = postproc.Tracks()
        for f in range(min(own), max(own) + 1):
            want += [(session, n) for n in tracks.step([(x, y) for _, x, y in sorted(own.get(f, []))])]
        want += [(session, n) for *_, n in tracks.active]
    found = postproc.track_lengths(spark.createDataFrame(rows, LOCATED).repartition(5))
    assert sorted((r.session, r.length) for r in found.collect()) == sorted(want) and max(n for _, n in want) > 3
    histogram = postproc.on_time(found).collect()
    assert [(r.session, r.length) for r in histogram] == sorted({*want}) and sum(r.n for r in histogram) == len(want)
    assert postproc.track_lengths(spark.createDataFrame([], LOCATED)).count() == 0


def test_drift_with_gaps_against_a_plain_loop(spark):
    rows = moving_points(seed=5)
    window, reach = 3, postproc.MAX_SHIFT
    away = lambda v: int(math.copysign(math.floor(abs(v) + 0.5), v))
    for session in sorted({r[0] for r in rows}):
        own = {}
        for _, f, _, x, y in (r for r in rows if r[0] == session):
            own.setdefault(f, []).append((x, y))
        corrected, want = {}, {}
        for f in sorted(own):
            reference = [(away(x), away(y)) for g in range(f - window, f) for x, y in corrected.get(g, [])]
            score = {}
            for x, y in own[f]:
                for u, v in reference:
                    key = (v - away(y), u - away(x))
                    score[key] = score.get(key, 0) + 1
            dy, dx = max(((sy, sx) for sy in range(-reach, reach + 1) for sx in range(-reach, reach + 1)), key=lambda s: (score.get(s, 0), -s[0], -s[1])) if reference else (0, 0)

            def vertex(a, b, c):
                return 0.0 if abs(a - 2 * b + c) < 1e-9 else min(max(0.5 * (a - c) / (a - 2 * b + c), -0.5), 0.5)

            at = lambda y, x: score.get((y, x), 0)
            sx, sy = (dx + vertex(at(dy, dx - 1), at(dy, dx), at(dy, dx + 1)), dy + vertex(at(dy - 1, dx), at(dy, dx), at(dy + 1, dx))) if reference else (0.0, 0.0)
            want[f] = (round(sx, 9), round(sy, 9))
            corrected[f] = [(x - sx, y - sy) for x, y in own[f]]
        some = [r for r in rows if r[0] == session]
        found = postproc.drift_fold(spark.createDataFrame(some, LOCATED).repartition(3), window).select("frame", "shift_x", "shift_y").distinct().collect()
        assert {r.frame: (round(r.shift_x, 9), round(r.shift_y, 9)) for r in found} == want


def test_stages_take_the_sensor_from_the_host(spark):
    own = stream(spark, [(500, 400)] * 60)
    bright = stages.run(own, known=GlobalSettings()).results["threshold"].collect()
    assert [(r.x, r.y) for r in bright] == [(500, 400)]
    assert stages.run(own, known=GlobalSettings(sensor_width=128, sensor_height=96)).results["threshold"].count() == 0


def metric_rows(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "frame long, metric double")


def test_quality_and_trend(spark):
    rows = metric_rows(spark, [10, 9, 8, 7, 6, 5])
    assert [r.quality for r in focus.quality(rows, Focus.MEAN_SIGMA).orderBy("frame").collect()] == ["Collecting"] * 3 + ["Good"] * 3
    assert [r.trend for r in focus.trend(rows, Focus.MEAN_SIGMA).orderBy("frame").collect()] == ["flat"] * 5 + ["down"]
    ratio = metric_rows(spark, [1.3, 1.3, 1.3, 1.1, 1.04, 1.0])
    assert [r.quality for r in focus.quality(ratio, Focus.ASTIGMATISM).orderBy("frame").collect()] == ["Poor"] * 3 + ["Fair", "Good", "Good"]
    assert focus.trend(ratio, Focus.ASTIGMATISM).orderBy(F.desc("frame")).first().trend == "toward 1.0"
    assert len(focus.history(rows, 4).orderBy(F.desc("frame")).first().history) == 4


def test_running_and_rolling_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 4)
    at = [f * 3 - 20 for f in range(23) if f % 5]
    rows = spark.createDataFrame([(f, float(f % 7)) for f in at], "frame long, metric double").repartition(3)
    assert {r.frame: r.total for r in ordered.running(rows, "frame", total="metric").collect()} == {f: sum(g % 7 for g in at[: i + 1]) for i, f in enumerate(at)}
    for depth in (1, 3, 4, 6, 40):
        found = {r.frame: r.history for r in focus.history(rows, depth).collect()}
        assert found == {f: [float(g % 7) for g in at[max(i + 1 - depth, 0) : i + 1]] for i, f in enumerate(at)}
    assert focus.history(rows.filter("frame > 999"), 3).count() == 0


def test_focus_labels(spark):
    rows = spark.createDataFrame([(0, 123.456), (1, 0.00123456), (2, None)], "frame long, metric double")
    text = lambda method: [r.label for r in focus.labelled(rows, method).orderBy("frame").collect()]
    assert text(Focus.MEAN_SIGMA) == ["Current mean sigma: 123.46 nm", "Current mean sigma: 0.00 nm", "Current metric: n/a"]
    assert text(Focus.FFT)[:2] == ["Current FFT metric: 1.235e2", "Current FFT metric: 1.235e-3"]
    assert text(Focus.ASTIGMATISM)[0] == "Current sigma_x/sigma_y ratio: 123.456"


def test_focus_drops_fits_without_width(spark):
    rows = spark.createDataFrame([(0, 2.0, 2.0), (0, 0.0, 0.0)], "frame long, sigma_x double, sigma_y double")
    assert focus.mean_sigma(rows).first().metric == 130.0 and focus.astigmatism(rows).first().metric == 1.0


def test_range_join_meets_every_pair(spark):
    rng = np.random.default_rng(1)
    xy = rng.integers(-20, 20, (80, 2))
    rows = points(spark, xy)
    got = within(rows, rows, 3.5).count()
    assert got == sum(((a - b) ** 2).sum() <= 12.25 for a in xy for b in xy)


def test_sources(spark):
    raw = spark.createDataFrame([(1, 2, 0, 5), (1, 2, -1, 6)], "x int, y int, polarity int, timestamp_us long")
    assert [r.polarity for r in events.converted(raw).orderBy("timestamp_us").collect()] == [False, True]
    cd = stream(spark, [(1, 1)], 2).unionByName(stream(spark, [(2, 2)], 5))
    assert [r.frame for r in events.frames(cd, 10).orderBy("frame").collect()] == [2, 3, 4, 5]
    assert events.frames(cd.filter("frame > 9"), frame_us=FRAME_US).count() == 0


def test_times(spark):
    near = stream(spark, [(10, 10), (10, 12), (90, 90)])
    rows = spark.createDataFrame([(0, 1, 10.0, 10.0), (0, 2, 50.0, 50.0)], "frame long, rank int, x double, y double")
    got = {r["rank"]: r.timestamp_us for r in localize.timed(rows, near, 4.0, 1000).collect()}
    assert got == {1: round((1 + 2 / 5) / (1 + 1 / 5)), 2: 500}


@pytest.mark.parametrize(
    ("settings", "key", "value", "kept"),
    [
        (LocalizationSettings(), "threshold_factor", 9, 4.0), (LocalizationSettings(), "fit_radius_px", 1, 2), (LocalizationSettings(), "nm_per_pixel", 1, 20.0),
        (ReconstructionSettings(), "max_localizations", 1, 10_000), (FocusSettings(), "history_depth", 999, 360), (FocusSettings(), "method", 7, Focus.MEAN_SIGMA),
        (CandidateSettings(), "finding_method", 2, Finding.FRAME_BASED), (CandidateSettings(), "min_isotropy", -1, 0.0), (CandidateSettings(), "max_candidates", 0, 1),
        (FittingSettings(), "fit_method", 1, Fit.GAUSSIAN), (FittingSettings(), "max_fit_residual", 11, 10.0), (PostprocSettings(), "max_fit_residual", 1e6, math.inf),
        (PostprocSettings(), "drift_window_frames", 0, 1), (PostprocSettings(), "drift_correction_enabled", True, True), (ThresholdSettings(), "threshold", 9999, 4096),
    ],
)
def test_settings_clamp(settings, key, value, kept):
    assert getattr(settings.put(key, value), key) == kept


def test_settings_errors_and_pairs():
    for key, value in (("fit_radius_px", 2.5), ("fit_radius_px", True), ("fit_radius_px", -1), ("show_overlay", 1), ("threshold_factor", "x")):
        with pytest.raises(TypeError):
            LocalizationSettings().put(key, value)
    with pytest.raises(KeyError):
        LocalizationSettings().put("nothing", 1)
    assert FittingSettings().put("sigma_min_nm", 300).sigma_max_nm == 300
    assert FittingSettings().put("sigma_max_nm", 50).sigma_min_nm == 50
    assert LocalizationSettings().get("nm_per_pixel") is None and "nm_per_pixel" not in {s["key"] for s in LocalizationSettings().schema()}
    assert GlobalSettings(nm_per_pixel=100.0).nm(65.0) == 100.0 and GlobalSettings().nm(65.0) == 65.0


def test_stages_and_views(spark):
    own = events.emitters(spark, "/root/testdata/sf0.001")
    done = stages.run(own, known=GlobalSettings(frame_us=events.FRAME_US))
    assert set(done.results) == {"events", *(s.name for s in stages.STAGES)} and not done.said
    done.publish("t_")
    assert spark.table("t_fits").count() == done.results["fits"].count() and done.generation["fits"] == 1
    compact = stages.view(done, "fits.compact")
    assert compact.dtypes == [("x_px", "double"), ("y_px", "double"), ("sigma_x_px", "double"), ("sigma_y_px", "double"), ("n_events", "bigint")]
    assert stages.view(done, "nothing") is None and [v.name for v in stages.VIEWS if v.dataset == "accumulated"][:2] == ["accumulated.table", "accumulated.density"]
    import dataclasses

    off = [dataclasses.replace(s, enabled=s.name != "candidates") for s in stages.STAGES]
    part = stages.run(own, off)
    assert "fits" not in part.results and ("info", "fits", "needs candidates") in part.said
    assert part.diagnostics(spark).count() == len(part.said)


def test_empty_frames_have_status(spark):
    own = stream(spark, ONE).unionByName(stream(spark, [(1, 1)], 2))
    members = clusters.dbscan(own, 1.5, 5)
    fits = fitters.fit_clusters(clusters.histogram(members), Fit.MEAN_XY)
    rows = localize.frame_status(events.frames(own, frame_us=FRAME_US), own, members, None, fits).orderBy("frame").collect()
    assert [(r.n_events, r.n_candidates, r.n_accepted, r.n_rejected) for r in rows] == [(10, 1, 1, 0), (0, 0, 0, 0), (1, 0, 0, 0)]


def test_pandas_grid_is_dense():
    assert images.dense(pd.DataFrame({"x": [1], "y": [0], "value": [2.0]}), 3, 2).tolist() == [[0, 2, 0], [0, 0, 0]]


def test_neighbours_pair_places_not_events(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(2)), int(i % 380), int(rng.integers(6)), int(rng.integers(6)), 0, True) for i in range(400)]
    rows += [(0, 900, None, 3, 0, True), (None, 901, 3, 3, 0, True), (0, None, 3, 3, 0, True)]
    made = []
    monkeypatch.setattr(rangejoin, "within", lambda *a: made.append(within(*a)) or made[-1])
    got = {(r.frame, r.event_seq): (r.n, r.d2) for r in rangejoin.neighbours(spark.createDataFrame(rows, CD), 2.0).collect()}
    want = {}
    for f, seq, x, y, *_ in rows:
        for g, _, u, v, *_ in rows:
            if f is not None and f == g and None not in (x, u) and (x - u) ** 2 + (y - v) ** 2 <= 4:
                n, d2 = want.get((f, seq), (0, 0.0))
                want[f, seq] = n + 1, d2 + (x - u) ** 2 + (y - v) ** 2
    assert got == want
    # Two frames of 36 places have at most 13 places within two pixels of each; the events have many more pairs.
    assert made[0].count() <= 2 * 36 * 13 < sum(n for n, _ in want.values()) / 5


def test_query_of_neighbours_takes_no_pairs_of_events(spark, monkeypatch):
    """More events on the same places give no more pairs."""
    made = []
    monkeypatch.setattr(rangejoin, "within", lambda *a: made.append(within(*a)) or made[-1])
    folder = "/root/testdata/sf0.001"
    events_of = lambda s, f: real(s, f).unionByName(real(s, f).withColumn("event_seq", F.col("event_seq") + 1_000_000))
    real = events.scattered
    QUERIES["neighbour_pairs"](spark, folder)
    monkeypatch.setattr(events, "scattered", events_of)
    twice = QUERIES["neighbour_pairs"](spark, folder)
    assert twice.count() == 2 * real(spark, folder).count()
    assert made[0].count() == made[1].count()
