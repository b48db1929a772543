"""Focus metrics by frame, their rolling history, quality and trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blinkframe.config import Focus
from blinkframe.functions.ordered import rolling
from blinkframe.operators.localize import in_sigma_range

EPSILON = 2.220446049250313e-16


def mean_sigma(rows: DataFrame, low_nm: float = 100.0, high_nm: float = 190.0, nm: float = 65.0) -> DataFrame:
    """Mean width of the localizations within the sigma limits, nm; frames without any have no row."""
    return in_sigma_range(rows, low_nm, high_nm, nm).groupBy("frame").agg(F.avg((F.col("sigma_x") + F.col("sigma_y")) / 2 * nm).alias("metric"))


def astigmatism(rows: DataFrame, low_nm: float = 100.0, high_nm: float = 190.0, nm: float = 65.0) -> DataFrame:
    """Mean ratio of the two widths."""
    kept = in_sigma_range(rows, low_nm, high_nm, nm).filter(F.abs("sigma_y") > EPSILON)
    return kept.groupBy("frame").agg(F.avg(F.col("sigma_x") / F.col("sigma_y")).alias("metric"))


def history(metrics: DataFrame, depth: int = 120, by: Sequence[str] = ()) -> DataFrame:
    """Metrics kept at each frame: the last ``depth``, oldest first; columns of ``by``, such as an epoch, are apart."""
    return rolling(metrics, "frame", depth, lambda last: {"history": F.collect_list("metric").over(last(depth))}, by)


def _moved(now: Column, before: Column, method: Focus) -> Column:
    by = F.greatest(F.abs(before), F.lit(1.0)) * 0.01
    if method is Focus.ASTIGMATISM:
        was, is_ = F.abs(before - 1), F.abs(now - 1)
        return F.when(is_ + by < was, "toward 1.0").when(is_ > was + by, "away from 1.0").otherwise("flat")
    return F.when(now - before < -by, "down").when(now - before > by, "up").otherwise("flat")


def quality(metrics: DataFrame, method: Focus, depth: int = 120, by: Sequence[str] = ()) -> DataFrame:
    """Add quality: by deviation from 1, or by place within the span of the history once it has four values."""
    m = F.col("metric")
    if method is Focus.ASTIGMATISM:
        off = F.abs(m - 1)
        return metrics.withColumn("quality", F.when(off <= 0.05, "Good").when(off <= 0.12, "Fair").otherwise("Poor"))

    def told(last) -> dict[str, Column]:
        low, high, n = (f("metric").over(last(depth)) for f in (F.min, F.max, F.count))
        place = (high - m if method is Focus.MEAN_SIGMA else m - low) / F.greatest(high - low, F.lit(1e-9))
        graded = F.when(place >= 0.66, "Good").when(place >= 0.33, "Fair").otherwise("Poor")
        return {"quality": F.when(n < 4, "Collecting").otherwise(graded)}

    return rolling(metrics, "frame", depth, told, by)


def trend(metrics: DataFrame, method: Focus, depth: int = 120, by: Sequence[str] = ()) -> DataFrame:
    """Add trend: the last three metrics against the rest of the history, flat below six."""

    def told(last) -> dict[str, Column]:
        now, before = F.avg("metric").over(last(3)), F.avg("metric").over(last(depth, 3))
        return {"trend": F.when(F.count("metric").over(last(depth)) < 6, "flat").otherwise(_moved(now, before, method))}

    return rolling(metrics, "frame", max(depth, 3), told, by)


def labelled(metrics: DataFrame, method: Focus) -> DataFrame:
    """Add label, the current metric as text; exponents are written without plus and leading zeros."""
    m = F.col("metric")
    power = F.regexp_replace(F.regexp_replace(F.format_string("%.3e", m), r"e\+0*(\d)", "e$1"), r"e-0*(\d)", "e-$1")
    text = {
        Focus.MEAN_SIGMA: F.format_string("Current mean sigma: %.2f nm", m),
        Focus.FFT: F.concat(F.lit("Current FFT metric: "), power),
        Focus.ASTIGMATISM: F.format_string("Current sigma_x/sigma_y ratio: %.3f", m),
    }[method]
    return metrics.withColumn("label", F.when(m.isNull(), "Current metric: n/a").otherwise(text))
