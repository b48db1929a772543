"""Connected components of links within groups, by rounds of joins; nothing of a graph is held in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blinkframe.sources.shared import checkpoint


def components(links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, id, root): least id reachable for every id of ``links`` (by, u, v); groups of ``by`` have graphs of their own.

    Each round links every id's larger neighbours to its least one, then its smaller ones too; rounds grow with the logarithm
    of the longest path. Loops and repeated links change nothing.
    """
    keys = list(by)
    turned = links.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = checkpoint(turned.filter("u <> v").distinct())
    state, before = _state(now), None
    while state[0] and state != before:
        both = now.union(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, [*keys, "u"]).filter("v > u and v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(lowest, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.union(lowest.select(*keys, "u", F.col("m").alias("v"))).filter("u <> v").distinct())
        state, before = _state(now), state
    roots = now.select(*keys, F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(*keys, F.col("u").alias("id"), F.col("v").alias("root")).union(roots)


def _state(links: DataFrame) -> tuple:
    """Count and sum of hashes: equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64(*links.columns).cast("decimal(38,0)"))).first())
