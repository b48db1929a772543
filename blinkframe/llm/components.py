"""Connected components of a table of links, by alternating stars; nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blinkframe.llm.frames import checkpoint


def _link(u: str, v: str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _each(links: DataFrame, *made: Column) -> DataFrame:
    """Several links of each row; unlike a union, the rows are read once and stay in as many parts."""
    return links.select(F.explode(F.array(*made)).alias("link")).select("link.u", "link.v")


def _stars(links: DataFrame) -> bool:
    """Whether distinct links that point down are stars: every id has one link down, or else only links from above."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("down")))).alias("end"))
    return ends.groupBy("end.id").agg(F.sum("end.down").alias("downs"), F.min("end.down").alias("least")).filter("downs > 1 or (downs > 0 and least = 0)").isEmpty()


def _large(links: DataFrame) -> DataFrame:
    """Link each vertex's larger neighbours to its least one; links may come several times."""
    both = _each(links, _link("u", "v"), _link("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    """Link each vertex and its smaller neighbours to the least of these; links point down."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return _each(links.join(least, "u"), _link("v", "m"), _link("u", "m")).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): least id reachable, for every id that occurs in ``links`` (u, v).

    The number of rounds grows with the logarithm of the longest path. Loops and repeated links change nothing.
    """
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = checkpoint(links)
    while not _stars(links):
        links = checkpoint(_small(_large(links)))
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
