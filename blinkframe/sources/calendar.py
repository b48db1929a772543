"""The calendar of a session: which frames brought a payload, and where its state starts anew.

Stateful operators don't count frames but steps. A frame whose payload is missing takes no step and leaves all state alone; a
frame with an empty payload takes one. A reset raises the epoch ahead of its frame, and switching a stage off does the same;
its frames then take no step until it is on again. State never crosses epochs: batch forms have the segment (session and
epoch) as a key and steps as frames, streams get the same marks in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blinkframe.functions.ordered import running

FILLED, EMPTY, MISSING, OFF = "filled", "empty", "missing", "off"
RESET, DISABLE, ENABLE = "reset", "disable", "enable"
CONTROLS = "session string, frame long, nth long, action string"


def calendar(payloads: DataFrame, rows: DataFrame, controls: DataFrame) -> DataFrame:
    """session, frame, presence, epoch, step of every frame of a session, from its first payload, row or control to its last.

    ``payloads`` (session, frame) tells which frames brought one, empty or not; a frame with ``rows`` (session, frame)
    brought one in any case. ``controls`` (session, frame, nth, action) take effect ahead of their frame, by ``nth`` within
    it; what is not known as an action does nothing. Steps count from 1 in each epoch and are null where none is taken.
    Frames are dealt by blocks, so that no task numbers a whole session.
    """
    listed = lambda df: df.select(F.col("session").cast("string").alias("session"), F.col("frame").cast("long").alias("frame"))
    told = listed(payloads).withColumn("kind", F.lit(0)).unionByName(listed(rows).withColumn("kind", F.lit(1))).unionByName(listed(controls).withColumn("kind", F.lit(-1)))
    brought = told.filter("kind >= 0 and frame is not null").groupBy("session", "frame").agg(F.max("kind").alias("kind"))
    known = told.filter("frame is not null").groupBy("session").agg(F.min("frame").alias("low"), F.max("frame").alias("high"))
    block = 4096
    blocks = known.select("session", "low", "high", F.explode(F.expr(f"sequence(floor(low / {block}), floor(high / {block}))")).alias("block"))
    frames = blocks.select("session", F.explode(F.expr(f"sequence(greatest(low, block * {block}), least(high, block * {block} + {block - 1}))")).alias("frame"))

    order = F.struct(F.col("nth"), F.col("action"))
    switch = F.max(F.when(F.col("action").isin(ENABLE, DISABLE), order))["action"]
    marks = controls.filter("frame is not null").groupBy(F.col("session").cast("string").alias("session"), F.col("frame").cast("long").alias("frame")).agg(
        F.count_if(F.col("action").isin(RESET, DISABLE)).alias("resets"), switch.alias("switch")
    )
    all_ = _matched(_matched(frames, brought), marks)
    # The last switch so far: the frame is in the number, and whether it is off.
    all_ = all_.withColumn("code", F.when(F.col("switch").isNotNull(), F.col("frame") * 2 + (F.col("switch") == DISABLE).cast("long")))
    all_ = all_.withColumn("resets", F.coalesce("resets", F.lit(0)))
    all_ = running(running(all_, "frame", ["session"], epoch="resets"), "frame", ["session"], F.max, last="code")
    off = F.coalesce(F.pmod("last", F.lit(2)) == 1, F.lit(False))
    all_ = all_.withColumn("presence", F.when(off, OFF).when(F.col("kind") == 1, FILLED).when(F.col("kind") == 0, EMPTY).otherwise(MISSING))
    all_ = all_.withColumn("taken", F.col("presence").isin(FILLED, EMPTY).cast("long"))
    counted = running(all_, "frame", ["session", "epoch"], step="taken")
    return counted.select("session", "frame", "presence", "epoch", F.when(F.col("taken") == 1, F.col("step")).alias("step"))


def _matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on session and frame, null sessions alike."""
    far = right.withColumnsRenamed({"session": "_session", "frame": "_frame"})
    return left.join(far, F.col("session").eqNullSafe(F.col("_session")) & (F.col("frame") == F.col("_frame")), "left").drop("_session", "_frame")


def segment(session: str = "session", epoch: str = "epoch") -> Column:
    """One key for session and epoch; what stands after the last slash is the epoch."""
    return F.concat(F.coalesce(F.col(session).cast("string"), F.lit("")), F.lit("/"), F.col(epoch).cast("string"))


def stepped(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of frames that take a step, with epoch, step and segment; those of frames that take none are left out."""
    steps = known.filter("step is not null").select(F.col("session").alias("_session"), F.col("frame").alias("_frame"), "epoch", "step")
    out = rows.join(steps, F.col("session").cast("string").eqNullSafe(F.col("_session")) & (F.col("frame") == F.col("_frame"))).drop("_session", "_frame")
    return out.withColumn("segment", segment())


def in_steps(rows: DataFrame) -> DataFrame:
    """Rows of :func:`stepped` as a stateful operator takes them: the segment as session, the step as frame."""
    return rows.withColumns({"session": F.col("segment"), "frame": F.col("step")})


def newest_epoch(rows: DataFrame) -> DataFrame:
    """Rows of each session's last epoch: what is left after its last reset."""
    last = rows.groupBy(F.col("session").alias("_session")).agg(F.max("epoch").alias("_epoch"))
    return rows.join(last, F.col("session").eqNullSafe(F.col("_session")) & (F.col("epoch") == F.col("_epoch"))).drop("_session", "_epoch")


def diagnostics(known: DataFrame, stage: str, message: str = "No payload came for this frame.") -> DataFrame:
    """frame, severity, stage, message of every frame whose payload is missing while the stage is on."""
    return known.filter(F.col("presence") == MISSING).select("session", "frame", F.lit("info").alias("severity"), F.lit(stage).alias("stage"), F.lit(message).alias("message"))
