"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def steady_state_slope(k: float, m: float, n: float, uplift: float, area: Column) -> Column:
    """Channel slope at which erosion balances uplift."""
    return F.lit((uplift / k) ** (1 / n)) * F.pow(area, F.lit(-m / n))


#: Units of accumulation and how a plot's axis names them.
ACCUMULATION_LABELS = {"m2": "Drainage area (m^2)", "km2": "Drainage area (km^2)", "cumecs": "Discharge (m^3/s)", "cfs": "Discharge (ft^3/s)"}


def accumulation_label(units: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(units == kv[0], kv[1]), ACCUMULATION_LABELS.items(),
        F.when(F.lit(False), "")).otherwise("Flow accumulation")


def unit_scaled(a: Column, factor: float) -> Column:
    return a * F.lit(float(factor))


#: D8 codes by direction: code, step in row, step in column.
D8 = ((1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1), (8, 0, 1))


def cell_of(x: Column, y: Column, west: float, north: float, ew: float, ns: float, cols: int, rows: int) -> tuple[Column, Column]:
    """Row and column of a point; the outer edges belong to the last cells, points outside get null."""
    c, r = F.floor((x - west) / ew), F.floor((north - y) / ns)
    inside = (x >= west) & (x <= west + cols * ew) & (y <= north) & (y >= north - rows * ns)
    return F.when(inside, F.least(r, F.lit(rows - 1)).cast("int")), F.when(inside, F.least(c, F.lit(cols - 1)).cast("int"))
