"""Break fits that follow a stream of vertices: sums by area bin, kept with a watermark.

The batch operators need no stream; this keeps slope-area bins current where vertices arrive over time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slope_area_bins(points: DataFrame, late: str = "1 hour", window: str = "1 day", width: float = 0.1) -> DataFrame:
    """(window, bin, n, sx, sy, sxx, sxy, syy) of a stream (ts, logA, logS); rows later than `late` go."""
    x, y = F.col("logA"), F.col("logS")
    sums = {"sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}
    return points.withWatermark("ts", late).groupBy(F.window("ts", window), F.floor(x / width).alias("bin")).agg(F.count("*").alias("n"), *(F.sum(e).alias(k) for k, e in sums.items()))
