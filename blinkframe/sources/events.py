"""Event tables: camera events by frame, from any table or stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blinkframe.config import Polarity

#: Sensor of the fixtures, for queries and tests alone.
WIDTH, HEIGHT = 128, 96
#: Frame length of the fixtures, microseconds of compressed time.
FRAME_US = 259_200_000
EPOCH_US = 1_704_067_200_000_000
POSITIVE = ("click", "purchase", "view")
#: Frames that one task lists.
BLOCK = 65_536
RAW, FRAME, COUNTS, NONE = "raw", "frame", "counts", "none"


def _time(ts: str) -> Column:
    return F.expr(f"(unix_micros(cast({ts} as timestamp)) - {EPOCH_US}) div 1000")


def _mapped(events: DataFrame, x: str, y: str, frame_us: int) -> DataFrame:
    rows = events.withColumn("timestamp_us", _time("ts"))
    return rows.select(
        F.expr(f"timestamp_us div {frame_us}").alias("frame"),
        F.col("event_id").alias("event_seq"),
        F.expr(x).cast("int").alias("x"),
        F.expr(y).cast("int").alias("y"),
        "timestamp_us",
        F.col("event_type").isin(*POSITIVE).alias("polarity"),
    )


def scattered(spark: SparkSession, sf_dir: str, frame_us: int = FRAME_US) -> DataFrame:
    """Events spread over the sensor: clusters of a few events. Columns frame, event_seq, x, y, timestamp_us, polarity."""
    x = "(user_id * 37) % 120 + 4 + (event_id * 31) % 5 - 2"
    y = "(user_id * 53) % 88 + 4 + ((event_id div 5) * 17) % 5 - 2"
    return _mapped(spark.read.parquet(f"{sf_dir}/events.parquet"), x, y, frame_us)


def emitters(spark: SparkSession, sf_dir: str, frame_us: int = FRAME_US) -> DataFrame:
    """Events of fifteen blinking emitters, offsets of about 1.6 pixels."""
    digit = lambda k: f"((h div {3**k}) % 3)"
    x = f"(user_id % 5) * 24 + 16 + {' + '.join(map(digit, range(4)))} - 4"
    y = f"((user_id div 5) % 3) * 28 + 20 + {' + '.join(map(digit, range(4, 8)))} - 4"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("h", F.expr("(event_id * 7919 + user_id * 104729) % 6561"))
    return _mapped(events, x, y, frame_us)


def converted(raw: DataFrame) -> DataFrame:
    """Camera rows (x, y, polarity as a number, timestamp): any polarity but 0 is positive."""
    return raw.withColumn("polarity", F.col("polarity") != 0)


def with_polarity(events: DataFrame, which: Polarity) -> DataFrame:
    if which is Polarity.POSITIVE:
        return events.filter("polarity")
    return events.filter("not polarity") if which is Polarity.NEGATIVE else events


def inside(events: DataFrame, width: int, height: int) -> DataFrame:
    """Events on the sensor; null positions are nowhere."""
    return events.filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def preferred(first: DataFrame, second: DataFrame, frames: DataFrame) -> DataFrame:
    """Events of the first source where a frame has any, else those of the second; ``frames`` holds every frame."""
    have = first.select("frame").distinct()
    return first.join(frames.select("frame"), "frame", "left_semi").unionByName(second.join(have, "frame", "left_anti").join(frames.select("frame"), "frame", "left_semi"))


def frames(events: DataFrame, frame_us: int) -> DataFrame:
    """Every frame from the first to the last, empty ones too, with its half-open window.

    Blocks of frames are listed first and dealt out, so that no task makes all frames of a long record.
    """
    span = events.agg(F.min("frame").alias("low"), F.max("frame").alias("high")).filter("low is not null")
    blocks = span.select("low", "high", F.explode(F.expr(f"sequence(floor(low / {BLOCK}), floor(high / {BLOCK}))")).alias("block")).repartition("block")
    listed = blocks.select(F.explode(F.expr(f"sequence(greatest(low, block * {BLOCK}), least(high, block * {BLOCK} + {BLOCK - 1}))")).alias("frame"))
    return listed.select("frame", (F.col("frame") * frame_us).alias("window_start_us"), ((F.col("frame") + 1) * frame_us).alias("window_end_us"))


def source_of(first: DataFrame, second: DataFrame, preview: DataFrame, frames: DataFrame) -> DataFrame:
    """frame, source of every frame: its raw events if there are any, else the frame's own, else preview counts, else none."""
    has = lambda rows, name: rows.groupBy("frame").agg(F.lit(True).alias(name))
    out = frames.select("frame").join(has(first, "_raw"), "frame", "left").join(has(second, "_own"), "frame", "left").join(has(preview, "_counts"), "frame", "left")
    return out.select("frame", F.when(F.col("_raw"), RAW).when(F.col("_own"), FRAME).when(F.col("_counts"), COUNTS).otherwise(NONE).alias("source"))


def source_warnings(sources: DataFrame, stage: str) -> DataFrame:
    """frame, severity, stage, message of every frame that has no events in either source; what a run finds in its data."""
    told = F.when(F.col("source") == COUNTS, "Raw events are missing for this frame; preview counts are used.").otherwise("This frame has neither events nor preview counts.")
    return sources.filter(F.col("source").isin(COUNTS, NONE)).select("frame", F.lit("warning").alias("severity"), F.lit(stage).alias("stage"), told.alias("message"))


def history(events: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Retained events of a half-open time range; a filter that reaches the scan."""
    return events.filter((F.col("timestamp_us") >= start_us) & (F.col("timestamp_us") < end_us))


def history_range(events: DataFrame, start_us: int, end_us: int, *more: Column) -> DataFrame:
    """One row: frame_count, first and last frame, event count and oldest timestamp of a time range, and ``more`` aggregates."""
    return history(events, start_us, end_us).agg(
        F.countDistinct("frame").alias("frame_count"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.count("*").alias("event_count"), F.min("timestamp_us").alias("oldest_timestamp_us"), *more,
    )
