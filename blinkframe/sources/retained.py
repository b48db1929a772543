"""Retained history: events kept in blocks of time, so that a range reads its blocks alone and old blocks can go.

``folder/block=B/delivery=D`` holds the events of a block that a delivery brought. A delivery that comes again replaces what
it brought before. Keeping history is a choice: nothing is kept unless ``add`` or ``stream`` is called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blinkframe.sources.events import history
from blinkframe.sources.shared import children, remove

EVENTS = "frame long, event_seq long, x int, y int, timestamp_us long, polarity boolean"


@dataclass(frozen=True)
class History:
    """Events in ``folder`` by blocks of ``block_us`` microseconds, which may not change once there are events.

    ``columns`` are those of the events; ``block`` and ``delivery`` are taken.
    """

    folder: str
    block_us: int
    columns: str = EVENTS

    def add(self, events: DataFrame, delivery: str) -> None:
        """Keep events, which may touch any blocks; those without a timestamp have no place in time and aren't kept.

        Rows are sorted by block and time into as many parts as they need: a full block is split, a block of few events
        isn't. ``delivery`` names these events; the same name again replaces them block by block.
        """
        if taken := {"block", "delivery"} & set(events.columns):
            raise ValueError(f"taken by retained history: {', '.join(sorted(taken))}")
        block = F.expr(f"(timestamp_us - pmod(timestamp_us, {self.block_us})) div {self.block_us}")
        placed = events.filter("timestamp_us is not null").withColumn("block", block).withColumn("delivery", F.lit(delivery))
        ordered = placed.repartitionByRange("block", "timestamp_us").sortWithinPartitions("block", "timestamp_us")
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block", "delivery").parquet(self.folder)

    def blocks(self, spark: SparkSession) -> list[int]:
        """Blocks that hold events, in order; as many as the time that is kept has blocks."""
        return sorted(int(name.removeprefix("block=")) for name in children(spark, self.folder) if name.startswith("block="))

    def read(self, spark: SparkSession, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
        """Retained events of a half-open range, open where a bound is None, with their block; no other block is even listed."""
        if start_us is not None and end_us is not None and end_us <= start_us:
            return spark.createDataFrame([], f"{self.columns}, block long")
        low = None if start_us is None else start_us // self.block_us
        high = None if end_us is None else (end_us - 1) // self.block_us
        held = [b for b in self.blocks(spark) if (low is None or b >= low) and (high is None or b <= high)]
        if not held:
            return spark.createDataFrame([], f"{self.columns}, block long")
        found = spark.read.schema(f"{self.columns}, block long, delivery string").option("basePath", self.folder).parquet(*[f"{self.folder}/block={b}" for b in held]).drop("delivery")
        if start_us is not None and end_us is not None:
            return history(found, start_us, end_us)
        if start_us is not None:
            return found.filter(F.col("timestamp_us") >= start_us)
        return found if end_us is None else found.filter(F.col("timestamp_us") < end_us)

    def expire(self, spark: SparkSession, before_us: int) -> list[int]:
        """Remove blocks that lie wholly before a time; the blocks that went. A block that reaches beyond it stays whole."""
        gone = [b for b in self.blocks(spark) if (b + 1) * self.block_us <= before_us]
        for block in gone:
            remove(spark, f"{self.folder}/block={block}")
        return gone

    def stream(self, events: DataFrame, keep_us: int, checkpoint: str):
        """Keep the events of a stream, at least the last ``keep_us`` up to the newest event; started, over what is available.

        A batch is a delivery, so one that is run again after a failure leaves no event twice. An event older than what
        is kept makes its block anew, and the same batch removes it.
        """

        def keep(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            self.add(batch, f"{number:012d}")
            if held := self.blocks(spark):
                newest = self.read(spark, held[-1] * self.block_us).agg(F.max("timestamp_us")).first()[0]
                self.expire(spark, newest - keep_us)

        return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
