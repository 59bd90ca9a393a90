"""Exact quantiles of large columns in a few passes over them, without a sort or a buffer of all values."""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import keep

#: Parts that an interval is cut into each pass.
CUTS = 256
#: Values that the last pass may count one by one.
GATHERED = 20_000


def exact_quantiles(rows: DataFrame, value: str, shares: list[float], by: str | None = None) -> dict:
    """group -> quantiles of value at the given shares, between ranks as by linear interpolation.

    by: a column of few groups (without it the one group None). Nulls and NaN are left out; infinities count as least
    and greatest. Each pass counts the values in CUTS parts of every interval that still holds a wanted rank; what reaches
    the driver are those counts. Intervals shrink to the least and greatest value in the part that has the rank, until these
    are equal or no more than GATHERED values are left in all of them, which are then counted one by one.
    """
    t = rows.select((F.col(by) if by else F.lit(None).cast("int")).alias("g"), F.col(value).cast("double").alias("x"))
    t = keep(t.filter(F.col("x").isNotNull() & ~F.isnan("x")), "values")
    least, most = F.lit(-math.inf), F.lit(math.inf)
    inside = F.when((F.col("x") > least) & (F.col("x") < most), F.col("x"))
    whole = {r.g: r for r in t.groupBy("g").agg(
        F.count("*").alias("n"), F.sum((F.col("x") == least).cast("long")).alias("below"), F.sum((F.col("x") == most).cast("long")).alias("above"),
        F.min(inside).alias("lo"), F.max(inside).alias("hi")).collect()}
    places = {g: [s * (r.n - 1) for s in shares] for g, r in whole.items()}
    found, left = {}, {}  # an interval: its ends, the values before it and in it
    for g, k in {(g, k) for g, ps in places.items() for p in ps for k in (math.floor(p), math.ceil(p))}:
        r = whole[g]
        if k < r.below or k >= r.n - r.above:
            found[g, k] = -math.inf if k < r.below else math.inf
        else:
            left[g, k] = (r.lo, r.hi, r.below, r.n - r.below - r.above)
    kind = t.schema["g"].dataType.simpleString()
    while True:
        found |= {key: lo for key, (lo, hi, *_) in left.items() if lo == hi}
        left = {key: x for key, x in left.items() if key not in found}
        if not left:
            break
        sizes = {(g, lo, hi): n for (g, _), (lo, hi, _, n) in left.items()}
        number = {s: k for k, s in enumerate(sizes)}
        table = rows.sparkSession.createDataFrame([(k, *s, _scale(*s[1:])) for s, k in number.items()], f"span int, g2 {kind}, lo double, hi double, scale double")
        met = t.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("g2")) & F.col("x").between(F.col("lo"), F.col("hi")))
        if last := sum(sizes.values()) <= GATHERED:
            part = F.col("x")
        else:
            at = lambda c: F.col(c) * F.col("scale")
            part = F.least(F.lit(CUTS - 1), F.floor((at("x") - at("lo")) / (at("hi") - at("lo")) * CUTS))
        parts: dict[int, list] = {}
        for r in met.groupBy("span", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            parts.setdefault(r.span, []).append((r.part, r.n, r.lo, r.hi))
        ends = {s: list(accumulate(p[1] for p in sorted(ps))) for s, ps in parts.items()}
        ordered = {s: sorted(ps) for s, ps in parts.items()}
        for (g, k), (lo, hi, below, _) in left.items():
            s = number[g, lo, hi]
            at_part = bisect_right(ends[s], k - below)
            _, n, a, b = ordered[s][at_part]
            left[g, k] = (a, b, below + ends[s][at_part] - n, n)
        assert not last or all(lo == hi for lo, hi, *_ in left.values())

    def between(g, p: float) -> float:
        a, b = found[g, math.floor(p)], found[g, math.ceil(p)]
        return a if a == b or p == math.floor(p) else a + (p - math.floor(p)) * (b - a)

    return {g: [between(g, p) for p in ps] for g, ps in places.items()}


def _scale(lo: float, hi: float) -> float:
    """What values are multiplied by so that the interval's width is a finite number."""
    return 1.0 if math.isfinite(hi - lo) else 0.25


def group_medians(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """(by, n, values): exact medians of columns in each of few groups."""
    got = [exact_quantiles(rows, v, [0.5], by) for v in values]
    n = {r[by]: r.n for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
    table = [(g, k, *(m[g][0] if g in m else None for m in got)) for g, k in n.items()]
    return rows.sparkSession.createDataFrame(
        table, f"{by} {rows.schema[by].dataType.simpleString()}, n long, " + ", ".join(f"{v} double" for v in values))
