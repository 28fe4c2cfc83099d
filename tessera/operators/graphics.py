"""What plots show, as tables: distribution functions, quantile pairs, densities, smooths and binned planes.

All of them are sums over bins or running counts over ranges, so a group of any size is many tasks and only
as many rows as there are bins, grid points or distinct values are left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import row_number_within, scanned
from tessera.operators.verbs import join_groups

# Coefficients of a rational approximation of the normal quantile (relative error below 1.2e-9).
_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)
_MIDDLE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
_MIDDLE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_FROM = 0.02425


def _polynomial(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def normal_quantile_sql(p: str) -> str:
    """The standard normal quantile of a share strictly between 0 and 1, as an expression of SQL."""
    tail = lambda q: f"({_polynomial(_TAIL, q)} / {_polynomial(_TAIL_BELOW, q)})"
    middle = f"(({p} - 0.5e0) * {_polynomial(_MIDDLE, f'(({p} - 0.5e0) * ({p} - 0.5e0))')} / {_polynomial(_MIDDLE_BELOW, f'(({p} - 0.5e0) * ({p} - 0.5e0))')})"
    return f"CASE WHEN {p} < {TAIL_FROM}e0 THEN {tail(f'sqrt(-2e0 * ln({p}))')} WHEN {p} > 1e0 - {TAIL_FROM}e0 THEN -{tail(f'sqrt(-2e0 * ln(1e0 - {p}))')} ELSE {middle} END"


def ecdf(df: DataFrame, by: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """(by, value, ecdf): the share of a group's values up to each distinct one; nulls aside, null keys a group."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__m"))
    seen = scanned(counted, [*by, value], ranges, __upto=F.col("__m"))
    groups = seen.groupBy(*by).agg(F.min(F.col("__upto") - F.col("__m")).alias("__start"), F.sum("__m").alias("__n"))
    known = join_groups(seen, groups, by) if by else seen.join(F.broadcast(groups))  # one row
    return known.select(*by, value, ((F.col("__upto") - F.col("__start")) / F.col("__n")).alias("ecdf"))


def qq_normal(df: DataFrame, by: list[str], value: str, key: list[str], ranges: int | None = None) -> DataFrame:
    """Each row with the normal quantile that its place in its group has; equal values stand in order of the key.

    The share of place i of n is (i - a) / (n + 1 - 2a), a = 3/8 for up to ten values and 1/2 for more.
    """
    rows = df.where(F.col(value).isNotNull())
    groups = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    placed = row_number_within(rows, by, [value, *key], "__i", ranges)
    known = join_groups(placed, groups, by)
    a = F.when(F.col("__n") <= 10, 0.375).otherwise(0.5)
    share = (F.col("__i") - a) / (F.col("__n") + 1 - 2 * a)
    return known.withColumn("__p", share).withColumn("theoretical", F.expr(normal_quantile_sql("__p"))).drop("__p", "__i", "__n")


def _binned(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> Column:
    return F.least(F.lit(bins), F.width_bucket(F.col(value).cast("double"), F.lit(low), F.lit(high), F.lit(bins))).cast("int")


def _grid(low: float, high: float, points: int) -> Column:
    """Evenly spaced places from low to high as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.lit(low) + k * F.lit((high - low) / (points - 1)))


def density(df: DataFrame, by: list[str], value: str, low: float, high: float, points: int = 64, bins: int = 1024) -> DataFrame:
    """(by, x, density): Gaussian kernel density on a grid, by rule-of-thumb bandwidth, from binned counts."""
    width = (high - low) / bins
    inside = df.where(F.col(value).between(low, high))
    counts = inside.groupBy(*by, _binned(df, by, value, low, high, bins).alias("__bin")).agg(F.count("*").alias("__m"))
    at = counts.withColumn("__c", F.lit(low) + (F.col("__bin") - 0.5) * width)
    moments = at.groupBy(*by).agg(F.sum("__m").alias("__n"), F.sum(F.col("__m") * F.col("__c")).alias("__s1"))
    centred = join_groups(at, moments, by).withColumn("__mean", F.col("__s1") / F.col("__n"))
    spread = centred.groupBy(*by).agg(F.sum(F.col("__m") * (F.col("__c") - F.col("__mean")) ** 2).alias("__ss"))
    sd = F.sqrt(F.col("__ss") / F.greatest(F.col("__n") - 1, F.lit(1)))
    bandwidth = 0.9 * F.when(sd > 0, sd).otherwise(width) * F.pow(F.col("__n").cast("double"), F.lit(-0.2))
    each = join_groups(centred, spread, by).withColumn("__h", bandwidth).withColumn("x", F.explode(_grid(low, high, points)))  # bins times points
    kernel = F.sum(F.col("__m") * F.exp(-0.5 * ((F.col("x") - F.col("__c")) / F.col("__h")) ** 2))
    return each.groupBy(*by, "x", "__n", "__h").agg(kernel.alias("__k")).select(*by, "x", (F.col("__k") / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi))).alias("density"))


def smooth(df: DataFrame, by: list[str], x: str, y: str, low: float, high: float, bandwidth: float, points: int = 80, bins: int = 1024) -> DataFrame:
    """(by, x, fitted): local linear regression with tricube weights on a grid, from sums by bin.

    A grid point without two bins of other means in reach has the weighted mean, one without any is null.
    """
    used = df.where(F.col(x).between(low, high) & F.col(y).isNotNull())
    sums = used.groupBy(*by, _binned(df, by, x, low, high, bins).alias("__bin")).agg(F.count("*").alias("__m"), F.avg(F.col(x).cast("double")).alias("__bx"), F.avg(F.col(y).cast("double")).alias("__by_"))
    each = sums.withColumn("x", F.explode(_grid(low, high, points))).withColumn("__u", F.abs(F.col("__bx") - F.col("x")) / bandwidth)
    near = F.when(F.col("__u") < 1, F.pow(1 - F.pow(F.col("__u"), F.lit(3.0)), F.lit(3.0))).otherwise(0.0)
    d = F.col("__bx") - F.col("x")
    weighed = each.withColumns({"__w": F.col("__m") * near, "__d": d})
    total = lambda c: F.sum(F.col("__w") * c)
    fit = weighed.groupBy(*by, "x").agg(F.sum("__w").alias("__s0"), total(F.col("__d")).alias("__s1"), total(F.col("__d") * F.col("__d")).alias("__s2"), total(F.col("__by_")).alias("__t0"), total(F.col("__d") * F.col("__by_")).alias("__t1"))
    whole = F.col("__s0") * F.col("__s2") - F.col("__s1") * F.col("__s1")
    fitted = F.when(whole > 1e-12 * F.col("__s0") * F.col("__s2"), (F.col("__s2") * F.col("__t0") - F.col("__s1") * F.col("__t1")) / whole).when(F.col("__s0") > 0, F.col("__t0") / F.col("__s0"))
    return fit.select(*by, "x", fitted.alias("fitted"))


def bin_2d(df: DataFrame, by: list[str], x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """(by, column, row, n): rows by cell of a plane."""
    cell = lambda c, w: F.floor(F.col(c).cast("double") / w).cast("long")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, cell(x, x_width).alias("column"), cell(y, y_width).alias("row")).agg(F.count("*").alias("n"))


def bin_hex(df: DataFrame, by: list[str], x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """(by, hex_x, hex_y, n): rows by the nearest centre of a lattice of hexagons.

    Centres are those of a grid of cells and of its cells' middles; the vertical distance counts threefold, which
    makes the hexagons regular where y_width is x_width times the root of 3.
    """
    across, up = F.col(x).cast("double") / x_width, F.col(y).cast("double") / y_width
    corner = lambda c: F.floor(c + 0.5)
    middle = lambda c: F.floor(c) + 0.5
    far = lambda f: (across - f(across)) * (across - f(across)) + 3 * ((up - f(up)) * (up - f(up)))
    first = far(corner) <= far(middle)
    centre = lambda c, w: (F.when(first, corner(c).cast("double")).otherwise(middle(c)) * w)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, centre(across, x_width).alias("hex_x"), centre(up, y_width).alias("hex_y")).agg(F.count("*").alias("n"))
