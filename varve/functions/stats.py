"""Aggregates and column expressions of series statistics. NULL is the only missing value."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A range this small against the largest magnitude is no variation: 32 machine epsilons.
CONSTANT = 32 * 2.220446049250313e-16


def finite(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def finite_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: finite(F.col(n)) for n in names})


def number(c: Column) -> Column:
    """A number, or NULL for text that is none."""
    return finite(c.try_cast("double"))


def constant(x: Column) -> Column:
    """Aggregate: whether x does not vary."""
    return (F.max(x) - F.min(x)) <= F.lit(CONSTANT) * F.greatest(F.lit(1.0), F.max(F.abs(x)))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation of the rows where both are present; NULL where one does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    return F.when(~constant(a) & ~constant(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def effective_n(n: Column, lag_x: Column, lag_y: Column) -> Column:
    """Sample size after autocorrelation, within 3 and n (n below 3 stays)."""
    product = lag_x * lag_y
    return F.when(n < 3, n.cast("double")).otherwise(F.greatest(F.lit(3.0), F.least(n.cast("double"), n * (1 - product) / (1 + product))))


def t_value(r: Column, n_eff: Column) -> Column:
    return r * F.sqrt(F.greatest(n_eff - 2, F.lit(0.0)) / F.greatest(1 - r * r, F.lit(2.220446049250313e-16)))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument beyond 8."""
    x = np.asarray(x, dtype=float).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    z = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / x - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function by its continued fraction, evaluated on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c = np.ones_like(z)
    h = d.copy()
    for m in range(1, 300):
        for term in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    inside = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(swap, 1 - inside, inside)


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Student's two-sided tail for any positive degrees of freedom."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def half_beta(a: Column) -> Column:
    """1 / B(a, 1/2): the ratio of gamma functions a half apart, by its series beyond 8."""
    z = a + 8.0
    series = F.lit(0.0)
    for c in reversed((1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432)):
        series = series / z + c
    out = F.sqrt(z) * series / float(np.sqrt(np.pi))
    for k in range(8):
        out = out * (a + float(k)) / (a + (k + 0.5))
    return out


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t, in the JVM; NULL where t is missing; degrees of freedom are at least 1.

    The tail is the regularized incomplete beta function of x = df / (df + t^2) with df/2 and 1/2, by the
    convergents of its continued fraction on the side where they converge fast, in steps that follow the
    root of the degrees of freedom.
    """

    def tail(v: Column) -> Column:
        p, q, z = v["p"], v["q"], v["z"]
        count = (30 + F.least(F.sqrt(v["a"]), F.lit(400.0))).cast("int")
        terms = F.transform(F.transform(F.sequence(F.lit(1), count), lambda k: k.cast("double")), lambda m: F.struct((m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))).alias("e"), (-(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))).alias("o")))

        def step(s: Column, d: Column) -> Column:
            # two more convergents above and below, scaled so that the last one below is 1
            above, below = s["above"] + d["e"] * s["above0"], 1 + d["e"] * s["below0"]
            return F.struct(((above + d["o"] * s["above"]) / (below + d["o"])).alias("above"), (above / (below + d["o"])).alias("above0"), (below / (below + d["o"])).alias("below0"))

        start = 1.0 / (1 - (p + q) * z / (p + 1))
        fraction = F.aggregate(terms, F.struct(start.alias("above"), start.alias("above0"), start.alias("below0")), step, lambda s: s["above"])
        inside = F.when(z <= 0, 0.0).otherwise(half_beta(v["a"]) * F.pow(z, p) * F.pow(1 - z, q) / p * fraction)
        return F.when(v["swap"], 1 - inside).otherwise(inside)

    def sides(s: Column) -> Column:
        a, x, rest = s["df"] / 2, s["df"] / (s["df"] + s["t"] * s["t"]), s["t"] * s["t"] / (s["df"] + s["t"] * s["t"])
        swap = x > (a + 1) / (a + 2.5)
        return F.struct(a.alias("a"), swap.alias("swap"), F.when(swap, 0.5).otherwise(a).alias("p"), F.when(swap, a).otherwise(F.lit(0.5)).alias("q"), F.when(swap, rest).otherwise(x).alias("z"))

    given = F.struct(finite(t).alias("t"), F.greatest(finite(df), F.lit(1.0)).alias("df"))
    return F.when(finite(t).isNotNull() & finite(df).isNotNull(), let(let(given, sides), tail))


def holm(df: DataFrame, p: str, out: str, keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Step-down adjustment within keys: the running maximum of (m - rank + 1) p, at most 1."""
    by = Window.partitionBy(*keys)
    ranked = by.orderBy(F.col(p).asc_nulls_last(), *order)
    m = F.count(p).over(by)
    df = df.withColumn("__m", m).withColumn("__k", F.row_number().over(ranked))
    step = (F.col("__m") - F.col("__k") + 1) * F.col(p)
    running = F.max(F.when(F.col(p).isNotNull(), step)).over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), running))).drop("__m", "__k")


def benjamini_hochberg(df: DataFrame, p: str, out: str, keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Step-up adjustment within keys: the running minimum from the largest p of p m / rank, at most 1."""
    by = Window.partitionBy(*keys)
    ranked = by.orderBy(F.col(p).asc_nulls_last(), *order)
    df = df.withColumn("__m", F.count(p).over(by)).withColumn("__k", F.row_number().over(ranked))
    step = F.when(F.col(p).isNotNull(), F.col(p) * F.col("__m") / F.col("__k"))
    down = by.orderBy(F.col("__k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(step).over(down)))).drop("__m", "__k")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; longitudes may be in either convention."""
    d_lon = F.radians(F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0)
    d_lat = F.radians(lat2 - lat1)
    h = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lon / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))))
