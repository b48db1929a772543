"""Running and rolling values over a whole ordered table, by blocks of rows instead of in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def running(rows: DataFrame, order: str, by: Sequence[str] = (), fold: Callable[[str], Column] = F.sum, **sums: str) -> DataFrame:
    """Add, for each name, the sum of a column over all rows up to this one; ``order`` holds whole numbers, none twice.

    ``by`` names columns whose groups are summed apart; ``fold`` may be another aggregate that can be put together from
    parts, such as a maximum. Blocks of neighbouring numbers are summed on their own; what is summed in one task is a row
    for each block. Nulls count for nothing; without any value so far a sum is 0, any other fold null.
    """
    parts = list(by)
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in parts]
    own = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    totals = own.groupBy(*parts, "_block").agg(*[fold(c).alias(f"_before_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy(*parts).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_of_{c}") for c in parts], F.col("_block").alias("_of_block"), *[fold(f"_before_{name}").over(earlier).alias(f"_before_{name}") for name in sums])
    inner = Window.partitionBy(*parts, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = own.select("*", *[fold(c).over(inner).alias(f"_own_{name}") for name, c in sums.items()])
    out = out.join(before, [out["_block"] == before["_of_block"], *same])

    def joined(name: str) -> Column:
        """Both parts by the same fold; for sums and extremes one aggregate over the pair."""
        first, last = F.col(f"_before_{name}"), F.col(f"_own_{name}")
        if fold is F.sum:
            return F.coalesce(first, F.lit(0)) + F.coalesce(last, F.lit(0))
        return (F.greatest if fold is F.max else F.least)(first, last)

    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[joined(name).alias(name) for name in sums])


def rolling(rows: DataFrame, order: str, depth: int, build: Callable[[Callable], dict[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """Add the columns of ``build(last)``, where ``last(n, skip)`` is the window of the last ``n`` rows without the newest ``skip``.

    ``n`` is ``depth`` at most; windows stay within groups of ``by``. Rows are numbered in ``order`` and dealt by blocks,
    each with the ``depth`` - 1 rows before it.
    """
    size = max(BLOCK, depth)
    numbered = running(rows.withColumn("_one", F.lit(1)), order, by, _nth="_one").drop("_one")
    block = F.floor((F.col("_nth") - 1) / size)
    near = F.when((F.col("_nth") - 1) % size > size - depth, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = numbered.withColumns({"_home": block, "_block": near}).withColumn("_block", F.explode("_block"))

    def last(n: int, skip: int = 0):
        return Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(1 - n, -skip)

    made = build(last)
    out = dealt.select("*", *[c.alias(name) for name, c in made.items()]).filter("_block = _home")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c not in made], *made)
