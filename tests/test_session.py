"""Calendar, epochs and the session stream: presence, resets and switches, in batch and over any cut into batches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blinkframe.operators import clusters, images, localize, postproc
from blinkframe.plans import stages
from blinkframe.sources import calendar, events
from blinkframe.streaming import session

POINTS = "session string, frame long, cluster_id long, x double, y double, sigma_x double, sigma_y double"


def points_of(rng, frames, drift=0.0):
    """Emitters seen in most frames, moved by a drift."""
    spots = [(rng.uniform(10, 60), rng.uniform(10, 60)) for _ in range(12)]
    return [("s", f, i, x + drift * f + rng.gauss(0, 0.1), y - drift * f, rng.uniform(0.8, 2), rng.uniform(0.8, 2)) for f in frames for i, (x, y) in enumerate(spots) if rng.random() < 0.7]


@pytest.fixture(scope="module")
def case(spark):
    """Points with payloads that are missing (3, 9) and empty (5), resets (7 and again 7), and a stage off at 11 and 12."""
    rng = random.Random(4)
    points = points_of(rng, [f for f in range(16) if f not in (3, 5, 9)], 0.4)
    rows = spark.createDataFrame(points, POINTS)
    payloads = spark.createDataFrame([("s", 5), ("s", 0), (None, 2)], "session string, frame long")
    controls = spark.createDataFrame([("s", 7, 0, "reset"), ("s", 7, 1, "reset"), ("s", 11, 0, "disable"), ("s", 13, 0, "enable"), ("s", 14, 0, "what")], calendar.CONTROLS)
    return points, rows, payloads, controls


def test_calendar(case):
    _, rows, payloads, controls = case
    got = {(r.session, r.frame): (r.presence, r.epoch, r.step) for r in calendar.calendar(payloads, rows, controls).collect()}
    filled = lambda f, e, s: {("s", f): ("filled", e, s)}
    want = {(None, 2): ("empty", 0, 1), ("s", 3): ("missing", 0, None), ("s", 5): ("empty", 0, 5), ("s", 9): ("missing", 2, None), ("s", 11): ("off", 3, None), ("s", 12): ("off", 3, None)}
    for f, e, s in [(0, 0, 1), (1, 0, 2), (2, 0, 3), (4, 0, 4), (6, 0, 6), (7, 2, 1), (8, 2, 2), (10, 2, 3), (13, 3, 1), (14, 3, 2), (15, 3, 3)]:
        want |= filled(f, e, s)
    assert got == want


def test_calendar_of_nothing_and_over_blocks(spark):
    none = spark.createDataFrame([], "session string, frame long")
    marks = spark.createDataFrame([], calendar.CONTROLS)
    assert calendar.calendar(none, none, marks).count() == 0
    far = spark.createDataFrame([("a", -5), ("a", 9_000), ("b", None)], "session string, frame long")
    known = calendar.calendar(far, none, spark.createDataFrame([("a", 5_000, 0, "reset"), (None, None, 0, "reset")], calendar.CONTROLS))
    counts = {(r.presence, r.epoch): r["count"] for r in known.groupBy("presence", "epoch").count().collect()}
    assert counts == {("empty", 0): 1, ("missing", 0): 5_004, ("missing", 1): 4_000, ("empty", 1): 1}
    assert [r.step for r in known.filter("frame = 9000").collect()] == [1]
    assert calendar.diagnostics(known, "postproc").count() == 9_004


def test_state_starts_anew_in_batch(case):
    _, rows, payloads, controls = case
    own = calendar.stepped(rows, calendar.calendar(payloads, rows, controls))
    table = localize.accumulated(localize.standard(own.withColumns({"timestamp_us": F.lit(0), "residual": F.lit(0.0)})), ["cluster_id"], by=["session", "epoch"])
    ids = {r.epoch: (r.low, r.high, r.n) for r in table.groupBy("epoch").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).collect()}
    assert set(ids) == {0, 2, 3} and all((low, high) == (0, n - 1) for low, high, n in ids.values())
    assert {r.epoch for r in calendar.newest_epoch(own).collect()} == {3}


def drain(spark, stream, name):
    query = stream.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name)


def messages(points):
    """The case's input as stream rows; a last frame closes the one before."""
    out = [("s", f, "point", i, x, y, a, b) for _, f, i, x, y, a, b in points]
    out += [("s", f, kind, None, None, None, None, None) for f, kind in [(3, "missing"), (5, "empty"), (7, "reset"), (7, "reset"), (9, "missing"), (11, "disable"), (13, "enable"), (16, "missing"), (17, "missing")]]
    return sorted(out, key=lambda r: (r[1], r[2] == "point"))


@pytest.mark.parametrize("cuts", [(), (7, 20, 21, 60, 95)])
def test_stream_equals_batch(spark, case, tmp_path, cuts):
    points, rows, payloads, controls = case
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", session.ROCKS)
    told = messages(points)
    for a, b in zip([0, *cuts], [*cuts, len(told)], strict=True):
        part = told[a:b]
        random.Random(a).shuffle(part)
        spark.createDataFrame(part, session.INPUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(session.INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    closed = drain(spark, session.processed(stream, window=3), f"closed_{len(cuts)}").persist()

    known = calendar.calendar(payloads, rows, controls)
    own = calendar.in_steps(calendar.stepped(rows, known))
    got = {(r.frame): (r.presence, r.epoch, r.step) for r in closed.filter("frame < 16").collect()}
    assert got == {r.frame: (r.presence, r.epoch, r.step) for r in known.filter("session = 's'").collect()}

    drifted = postproc.drift_fold(own, 3)
    listed = closed.select("epoch", "step", F.explode(F.arrays_zip("nth", "x", "y")).alias("p")).select(F.concat(F.lit("s/"), "epoch").alias("session"), "step", "p.*")
    both = drifted.select("session", F.col("frame").alias("step"), F.col("cluster_id").alias("nth"), F.col("x").alias("bx"), F.col("y").alias("by")).join(listed, ["session", "step", "nth"], "full")
    off = both.select(F.max(F.coalesce(F.abs(F.col("x") - F.col("bx")) + F.abs(F.col("y") - F.col("by")), F.lit(9.0)))).first()[0]
    assert off < 1e-9 and drifted.filter("shift_x <> 0").count() > 20

    lengths = {(r.epoch, r.length): r.n for r in session.folded_tracks(closed).collect()}
    batch = postproc.track_lengths(drifted).groupBy("session", "length").count().collect()
    assert lengths == {(int(r.session.split("/")[1]), r.length): r["count"] for r in batch}
    sums = {r.epoch: (r.n, r.sigma_px) for r in session.folded_precision(closed).collect()}
    for r in postproc.precision(postproc.neighbour_distances(drifted, by=["session", "frame"]), by=["session"]).groupBy("session").agg(F.max_by(F.struct("n", "sigma_px"), "frame").alias("last")).collect():
        n, sigma = sums[int(r.session.split("/")[1])]
        assert n == r["last"].n and abs(sigma - r["last"].sigma_px) < 1e-9
    for epoch in (0, 2, 3):
        want = {(r.dx, r.dy): r.value for r in postproc.spread_patch(drifted.filter(F.col("epoch") == epoch)).collect()}
        found = {(r.dx, r.dy): r.value for r in session.folded_patch(closed).filter(F.col("epoch") == epoch).collect()}
        assert found.keys() == want.keys() and max(abs(found[k] - want[k]) for k in want) < 1e-9


def test_watermark_closes_the_last_frame(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", session.ROCKS)
    kind = session.INPUT + ", ends timestamp"
    for n, (key, frame) in enumerate([("a", 0), ("b", 50), ("b", 51)]):
        row = spark.createDataFrame([(key, frame, "point", 0, 1.0, 1.0, 1.0, 1.0)], session.INPUT).withColumn("ends", F.timestamp_seconds(F.lit(1000 + frame * 10)))
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    closed = drain(spark, session.processed(stream, ends="ends"), "closed_by_time")
    assert ("a", 0) in {(r.session, r.frame) for r in closed.collect()}


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 50, 400):
        points = np.round(rng.uniform(0, 30, (n, 2)), 1)
        d = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1)) + np.diag([np.inf] * n)
        assert np.allclose(session.nearest(points), d.min(1) if n > 1 else [])


def test_lonely_neighbours_by_rings(spark):
    rng = random.Random(9)
    rows = [(f, i, rng.uniform(-3000, 3000), rng.uniform(0, 400)) for f in range(3) for i in range(150)] + [(7, 0, 1.0, 1.0), (8, 0, 0.0, 0.0), (8, 1, 90_000.0, 0.0), (9, 0, float("nan"), 1.0), (9, 1, 1.0, None), (9, 2, 5.0, 5.0)]
    rows += [(10, i, 100 + 0.001 * i, 0.0) for i in range(300)] + [(10, 999, 0.0, 0.0)]
    got = {(r.frame, r.cluster_id): r.distance for r in postproc.neighbour_distances(spark.createDataFrame(rows, "frame long, cluster_id long, x double, y double")).collect()}
    want = {}
    for f, i, x, y in rows:
        near = [np.hypot(x - p, y - q) for g, j, p, q in rows if g == f and j != i and q is not None and p == p] if y is not None and x == x else []
        if near:
            want[f, i] = min(near)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_window_shifts_as_by_every_point(spark):
    rng = random.Random(6)
    points = [(p[1], p[3], p[4]) for p in points_of(rng, [0, 1, 2, 3, 4, 8, 9, 20, 21, 22, 23], 0.6)] + [(30, 5.0, 5.0), (31, 400.0, 5.0), (40, -0.5, -7.5), (41, -3.5, -0.5)]
    rows = spark.createDataFrame(points, "frame long, x double, y double")
    for window in (1, 3, 50):
        want = {r.frame: r for r in postproc.shifts(postproc.window_reference(rows, window), rows).collect()}
        got = {r.frame: r for r in postproc.window_shifts(rows, window).collect()}
        assert got.keys() == want.keys()
        for f in want:
            assert abs(got[f].shift_x - want[f].shift_x) + abs(got[f].shift_y - want[f].shift_y) < 1e-12 and got[f].overlap == want[f].overlap, (window, f)


def test_shift_of_the_same_points_is_zero(spark):
    rng = random.Random(2)
    spots = [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(40)]
    rows = spark.createDataFrame([(f, x, y) for f in range(4) for x, y in spots], "frame long, x double, y double").withColumn("session", F.lit("a"))
    assert {(r.shift_x, r.shift_y) for r in postproc.window_shifts(rows, 2, by=["session"]).collect()} == {(0.0, 0.0)}


def test_frame_without_events_is_imaged_from_counts(spark):
    kind = "frame long, event_seq long, x int, y int, timestamp_us long, polarity boolean"
    raw = spark.createDataFrame([(0, 0, 1, 1, 5, True)], kind)
    own = spark.createDataFrame([(0, 1, 2, 2, 7, True), (1, 2, 3, 3, 17, False)], kind)
    preview = spark.createDataFrame([(0, 9, 9, 4), (2, 5, 6, 3), (2, 99, 6, 3)], "frame long, x int, y int, n long")
    frames = spark.range(4).withColumnRenamed("id", "frame")
    told = events.source_of(raw, own, preview, frames)
    assert {r.frame: r.source for r in told.collect()} == {0: "raw", 1: "frame", 2: "counts", 3: "none"}
    image = images.sourced_image(raw, own, preview, told, True, 10, 20, 20)
    assert {(r.frame, r.x, r.y, r.value) for r in image.collect()} == {(0, 1, 1, 5.0), (1, 3, 3, -7.0), (2, 5, 6, 3.0)}
    assert [(r.frame, r.severity) for r in events.source_warnings(told, "localization").orderBy("frame").collect()] == [(2, "warning"), (3, "warning")]


def test_stages_wait_for_optional_results(spark):
    """The table takes corrected fits whatever the order of the list."""
    fits = stages.Stage("fits", "", "derived", (), stages.PostprocSettings(), lambda have, s, g: have["events"])
    corrected = stages.Stage("postproc", "", "derived", ("fits",), stages.PostprocSettings(), lambda have, s, g: have["fits"].withColumn("x", F.lit(100.0)))
    table = next(s for s in stages.STAGES if s.name == "accumulated")
    rows = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 0, 1.0), ("b", 0, 0, 1.0)], "session string, frame long, cluster_id long, x double")
    rows = rows.withColumns({c: F.lit(1.0) for c in ("y", "sigma_x", "sigma_y", "residual")}).withColumn("timestamp_us", F.lit(0))
    done = stages.run(rows, [table, corrected, fits])
    assert {(r.session, r.id, r.x_nm) for r in done.results["accumulated"].collect()} == {("a", 0, 6500.0), ("a", 1, 6500.0), ("b", 0, 6500.0)}
    assert {(r.session, r.id) for r in localize.newest(done.results["accumulated"], 1, ["session"]).collect()} == {("a", 1), ("b", 0)}
    assert {(r.x_nm) for r in stages.run(rows, [table, fits]).results["accumulated"].collect()} == {65.0}


@pytest.mark.parametrize("tile", [1, 7, 100])
def test_tiles_change_no_cluster(spark, tile):
    rng = random.Random(2)
    rows = [(f, i + 1000 * f, rng.randrange(-5, 40), rng.randrange(0, 40)) for f in range(2) for i in range(260)]
    own = spark.createDataFrame(rows, "frame long, event_seq long, x int, y int")
    told = lambda df: sorted(map(tuple, df.select("frame", "event_seq", "cluster_id").collect()))
    assert told(clusters.dbscan(own, 2.0, 4, tile)) == told(clusters.dbscan(own, 2.0, 4))
