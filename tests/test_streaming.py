"""Streaming forms against the batch ones."""

from pyspark.sql import functions as F

from blinkframe.operators import postproc
from blinkframe.streaming import live


def drain(spark, query_name, frame, mode):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(query_name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(query_name)


def test_frames_past_the_watermark(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") / 10).alias("ts"), (F.col("id") % 3).cast("int").alias("x"), F.lit(1).alias("y"), (F.col("id") % 2 == 0).alias("polarity"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = drain(spark, "frames_out", live.frame_counts(stream, "1 second", "0 seconds"), "append")
    closed = {r.window_start: r.n for r in got.groupBy("window_start").agg(F.sum("n").alias("n")).collect()}
    assert len(closed) == 9 and set(closed.values()) == {10}


def test_tracks_and_precision_over_batches(spark, tmp_path):
    xy = [(0, [(0.0, 0.0), (3.0, 0.0)]), (1, [(0.5, 0.0), (9.0, 9.0)]), (2, [(0.6, 0.2)]), (5, [(0.6, 0.2)])]
    for frame, points in xy:
        part = spark.createDataFrame([("s", frame, i, x, y) for i, (x, y) in enumerate(points)], "session string, frame long, nth long, x double, y double").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, frame long, nth long, x double, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(spark, "tracks_out", live.evaluated(stream), "append").orderBy("frame").collect()
    assert [r.n_ended for r in got] == [0, 1, 1, 1] and got[-1].sum_length == 3
    rows = spark.createDataFrame([(f, i, x, y) for f, ps in xy for i, (x, y) in enumerate(ps)], "frame long, cluster_id long, x double, y double")
    batch = postproc.precision(postproc.neighbour_distances(rows)).orderBy(F.desc("frame")).first()
    assert abs(got[-1].sigma_px - batch.sigma_px) < 1e-9 and got[-1].n_distances == batch.n


def test_focus_history_over_batches(spark, tmp_path):
    told = [("value", 5.0), ("value", 4.0), ("missing", None), ("value", 3.0), ("reset", None), ("missing", None), ("value", 9.0)]
    kind = "session string, frame long, kind string, metric double"
    for frame, (what, metric) in enumerate(told):
        spark.createDataFrame([("s", frame, what, metric)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    got = drain(spark, "focus_out", live.focused(stream, 2), "append").orderBy("frame").collect()
    assert [r.history for r in got] == [[5.0], [5.0, 4.0], [5.0, 4.0], [4.0, 3.0], [], [], [9.0]]
    assert [r.metric for r in got] == [5.0, 4.0, 4.0, 3.0, None, None, 9.0] and [r.missing for r in got] == [w == "missing" for w, _ in told]


def test_append_only_table(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    live.append_table(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 5 and {r.generation for r in out.select("generation").collect()} == {0}
