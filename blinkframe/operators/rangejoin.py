"""Range joins as equi-joins on grid cells: an inequality alone would compare every pair."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, radius: float, how: str = "inner") -> DataFrame:
    """Pairs of one frame no farther apart than ``radius``: all columns of ``left``, r_ columns of ``right``, and d2.

    Both sides have frame, x and y. Right rows go to the nine cells around them; a left row has one cell.
    """
    cell = max(math.ceil(radius), 1)
    at = lambda c: F.floor(F.col(c) / cell)
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    far = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    far = far.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
    far = far.withColumns({"_cx": at("r_x") + F.col("_dx"), "_cy": at("r_y") + F.col("_dy")}).drop("_dx", "_dy")
    here = left.withColumns({"_lx": at("x"), "_ly": at("y")})
    d2 = (F.col("x") - F.col("r_x")) * (F.col("x") - F.col("r_x")) + (F.col("y") - F.col("r_y")) * (F.col("y") - F.col("r_y"))
    match = (here["frame"] == far["r_frame"]) & (here["_lx"] == far["_cx"]) & (here["_ly"] == far["_cy"]) & (d2 <= radius * radius)
    return here.join(far, match, how).withColumn("d2", d2.cast("double")).drop("_lx", "_ly", "_cx", "_cy", "r_frame")


def neighbours(rows: DataFrame, radius: float, key: str = "event_seq") -> DataFrame:
    """frame, key, n, d2: how many rows of its frame are within ``radius`` of each key's rows, themselves too, and the sum of squared distances.

    Rows of one place have the same neighbours, so places are paired, not rows: pairs grow with the places of a frame.
    """
    places = rows.groupBy("frame", "x", "y").agg(F.count("*").alias("rows"))
    told = within(places.drop("rows"), places, radius).groupBy("frame", "x", "y").agg(F.sum("r_rows").alias("n"), F.sum(F.col("r_rows") * F.col("d2")).alias("d2"))
    return rows.join(told, ["frame", "x", "y"]).groupBy("frame", key).agg(F.sum("n").alias("n"), F.sum("d2").alias("d2"))
