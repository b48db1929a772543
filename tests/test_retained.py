"""Retained history in blocks, and tables published by generation."""

import pytest
from pyspark.sql import functions as F

from blinkframe.config import GlobalSettings
from blinkframe.plans import stages
from blinkframe.sources import events, published
from blinkframe.sources.retained import EVENTS, History
from blinkframe.sources.shared import children

FIXTURE = "/root/testdata/sf0.001"


def made(spark, times):
    return spark.createDataFrame([(0 if t is None else t // 10, i, 1, 1, t, True) for i, t in enumerate(times)], EVENTS)


def times(rows):
    return sorted(r.timestamp_us for r in rows.collect())


@pytest.fixture
def kept(tmp_path):
    return History(str(tmp_path / "history"), 100)


def test_a_range_reads_its_blocks_alone(spark, kept):
    kept.add(made(spark, range(0, 1000, 10)), "a")
    assert kept.blocks(spark) == list(range(10))
    found = kept.read(spark, 250, 400)
    assert times(found) == list(range(250, 400, 10))
    read = {f.split("block=")[1].split("/")[0] for f in found.inputFiles()}
    assert read == {"2", "3"}
    assert "timestamp_us" in found._jdf.queryExecution().toString().split("PushedFilters")[1]
    assert times(kept.read(spark, None, 30)) == [0, 10, 20]
    assert times(kept.read(spark, 970)) == [970, 980, 990]
    assert kept.read(spark).count() == 100


def test_bounds_and_empty_history(spark, kept):
    assert kept.blocks(spark) == [] and kept.expire(spark, 10**9) == []
    assert kept.read(spark, 0, 100).count() == 0
    kept.add(made(spark, []), "none")
    kept.add(made(spark, [-1, -100, -101, 0, 99, 100, None]), "a")
    assert kept.blocks(spark) == [-2, -1, 0, 1]
    assert times(kept.read(spark, -100, 100)) == [-100, -1, 0, 99]
    assert kept.read(spark, 50, 50).count() == kept.read(spark, 60, 50).count() == 0
    assert kept.read(spark, 5000, 6000).columns == kept.read(spark).columns
    with pytest.raises(ValueError, match="block"):
        kept.add(made(spark, [1]).withColumn("block", F.lit(1)), "b")


def test_a_delivery_that_comes_again_replaces_itself(spark, kept):
    for _ in range(2):
        kept.add(made(spark, [5, 5, 105]), "a")
        kept.add(made(spark, [5, 205]), "b")
    assert times(kept.read(spark)) == [5, 5, 5, 105, 205]


def test_blocks_before_the_horizon_are_gone(spark, kept):
    kept.add(made(spark, range(0, 500, 50)), "a")
    assert kept.expire(spark, 199) == [0]
    assert kept.expire(spark, 250) == [1]
    assert times(kept.read(spark, 0, 300)) == [200, 250]


def test_stream_of_deliveries(spark, kept, tmp_path):
    made(spark, range(0, 300, 20)).coalesce(1).write.parquet(str(tmp_path / "in"))
    check = str(tmp_path / "check")

    def go():
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        kept.stream(stream, 250, check).awaitTermination()

    go()
    assert times(kept.read(spark)) == list(range(0, 300, 20))
    made(spark, [10, 580]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    # 580 - 250 lies in block 3: blocks 0 to 2 are gone, with the late event of block 0.
    assert times(kept.read(spark)) == [580]


def test_full_blocks_are_split(spark, kept):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        rows = spark.range(200_000).selectExpr("0L as frame", "id as event_seq", "1 as x", "1 as y", "id % 100 as timestamp_us", "true as polarity")
        kept.add(rows, "a")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert kept.blocks(spark) == [0]
    assert len(kept.read(spark).inputFiles()) > 1 and kept.read(spark).count() == 200_000


def test_generation_stays_with_the_content(spark, tmp_path):
    folder = str(tmp_path / "table")
    rows = spark.createDataFrame([(1, None, [1, None]), (2, "b", None), (2, "b", None)], "a long, b string, `c.d` array<long>")
    assert published.publish(rows, folder) == 1
    assert published.publish(rows.repartition(3).orderBy(F.desc("a")), folder) == 1
    assert published.read(spark, folder).count() == 3 and len(children(spark, f"{folder}/data")) == 1
    assert published.publish(rows.distinct(), folder) == 2
    assert published.publish(rows, folder) == 3
    assert published.publish(rows.withColumnRenamed("b", "e"), folder) == 4
    assert [r.generation for r in published.manifest(spark, folder).orderBy("generation").collect()] == [1, 2, 3, 4]
    assert published.read(spark, folder, 2).count() == 2
    with pytest.raises(ValueError, match="generation 9"):
        published.read(spark, folder, 9)
    assert published.prune(spark, folder, 1) == [4]
    assert published.read(spark, folder).columns == ["a", "e", "c.d"]
    assert published.publish(rows, folder) == 5


def test_content_tells_nulls_apart(spark):
    told = lambda values, kinds: tuple(published.content(spark.createDataFrame(values, kinds)).first())
    assert told([(None, 1)], "a long, b long") != told([(1, None)], "a long, b long")
    assert told([([1, None],)], "a array<long>") != told([([None, 1],)], "a array<long>")
    assert told([(1,), (2,)], "a long") == told([(2,), (1,)], "a long")
    assert told([(1,), (1,)], "a long") != told([(1,)], "a long")
    assert told([], "a long") != told([], "a int")


def test_empty_table_and_unknown_folder(spark, tmp_path):
    folder = str(tmp_path / "table")
    assert published.manifest(spark, folder).count() == 0
    with pytest.raises(ValueError, match="no generation"):
        published.read(spark, folder)
    empty = spark.createDataFrame([], "a long")
    assert published.publish(empty, folder) == published.publish(empty, folder) == 1
    assert published.read(spark, folder).count() == 0


def test_a_run_that_ended_before_its_manifest(spark, tmp_path):
    folder = str(tmp_path / "table")
    spark.range(3).write.parquet(f"{folder}/data/lost")
    assert published.publish(spark.range(2), folder) == 1
    assert published.read(spark, folder).count() == 2
    published.prune(spark, folder)
    assert "lost" not in children(spark, f"{folder}/data")


def test_stages_keep_generations_across_runs(spark, tmp_path):
    known = GlobalSettings(sensor_width=events.WIDTH, sensor_height=events.HEIGHT, frame_us=events.FRAME_US)
    only = [s for s in stages.STAGES if s.name == "threshold"]
    told = []
    for rows in (events.scattered(spark, FIXTURE), events.scattered(spark, FIXTURE).repartition(5), events.scattered(spark, FIXTURE).filter("frame < 3")):
        done = stages.run(rows, only, known)
        done.publish("kept_", str(tmp_path))
        told.append(done.generation["threshold"])
        assert spark.table("kept_threshold").count() == done.results["threshold"].count()
    assert told == [1, 1, 2]
