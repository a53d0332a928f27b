"""Gap filling along time: linear, nearest, harmonic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _neighbours(series: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """Adds the last and next observation (dp, vp, dn, vn): one shuffle, both frames in one select."""
    back = Window.partitionBy(*key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy(time).rowsBetween(0, Window.unboundedFollowing)
    day = F.when(F.col(value).isNotNull(), F.col(time))
    return series.select("*", F.last(day, True).over(back).alias("dp"), F.last(value, True).over(back).alias("vp"), F.first(day, True).over(ahead).alias("dn"), F.first(value, True).over(ahead).alias("vn"))


def fill_linear(series: DataFrame, key: list[str], time: str, value: str, out: str = "filled") -> DataFrame:
    """Piecewise linear, constant beyond the ends, 0 for a series without observations."""
    t = F.col(time)
    inner = F.col("vp") + (F.col("vn") - F.col("vp")) * (t - F.col("dp")) / F.nullif(F.col("dn") - F.col("dp"), F.lit(0))
    return _neighbours(series, key, time, value).withColumn(out, F.coalesce(F.col(value), inner, "vp", "vn", F.lit(0.0))).drop("dp", "vp", "dn", "vn")


def fill_nearest(series: DataFrame, key: list[str], time: str, value: str, out: str = "filled") -> DataFrame:
    """The nearest observation in time, the earlier one on ties; 0 without observations."""
    t = F.col(time)
    later = F.col("dp").isNull() | (F.col("dn").isNotNull() & (t - F.col("dp") > F.col("dn") - t))
    return _neighbours(series, key, time, value).withColumn(out, F.coalesce(F.col(value), F.when(later, F.col("vn")).otherwise(F.col("vp")), F.lit(0.0))).drop("dp", "vp", "dn", "vn")


def fill_harmonic(series: DataFrame, key: list[str], time: str, value: str, period: float, out: str = "filled") -> DataFrame:
    """c + a cos x + b sin x by the 3 x 3 normal equations in SQL; the mean for fewer than 3 observations."""
    x = F.col(time).cast("double") / F.lit(float(period)) * F.lit(2 * math.pi)
    s = series.withColumn("_c", F.cos(x)).withColumn("_s", F.sin(x))
    seen = F.col(value).isNotNull()
    term = lambda e: F.sum(F.when(seen, e))
    c, d, v = F.col("_c"), F.col("_s"), F.col(value)
    sums = s.groupBy(*key).agg(
        F.count(value).alias("n"), term(c).alias("sc"), term(d).alias("ss"), term(c * c).alias("cc"), term(d * d).alias("dd"), term(c * d).alias("cd"), F.sum(value).alias("sv"), term(v * c).alias("vc"), term(v * d).alias("vd"),
    )
    n, sc, ss, cc, dd, cd, sv, vc, vd = (F.col(a) for a in ("n", "sc", "ss", "cc", "dd", "cd", "sv", "vc", "vd"))

    def det(a, b, c_, d_, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d_ * i - f * g) + c_ * (d_ * h - e * g)

    whole = det(n, sc, ss, sc, cc, cd, ss, cd, dd)
    fits = sums.withColumn("_d", whole).select(
        *key, "n", F.try_divide(sv, n).alias("_mean"), F.try_divide(det(sv, sc, ss, vc, cc, cd, vd, cd, dd), F.col("_d")).alias("_k0"),
        F.try_divide(det(n, sv, ss, sc, vc, cd, ss, vd, dd), F.col("_d")).alias("_k1"), F.try_divide(det(n, sc, sv, sc, cc, vc, ss, cd, vd), F.col("_d")).alias("_k2"),
    )
    curve = F.when(F.col("n") < 3, F.coalesce("_mean", F.lit(0.0))).otherwise(F.col("_k0") + F.col("_k1") * c + F.col("_k2") * d)
    return s.join(fits, key).withColumn(out, F.coalesce(F.col(value), curve)).drop("_c", "_s", "n", "_mean", "_k0", "_k1", "_k2")


def fill_harmonics(series: DataFrame, key: list[str], time: str, value: str, period: float, frequencies: int, out: str = "filled") -> DataFrame:
    """Any number of frequencies by least squares; no more parameters than observations."""
    if frequencies < 1:
        raise ValueError("frequencies must be at least 1")
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + f", `{out}` double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[time].to_numpy(np.float64) / period * 2 * np.pi
        y = pdf[value].to_numpy(np.float64)
        seen = ~np.isnan(y)
        n = int(seen.sum())
        m = min(2 * frequencies - 1, n if n % 2 else max(n - 1, 1))
        cols = [np.ones_like(x)]
        for j in range(1, (m - 1) // 2 + 1):
            cols += [np.cos(j * x), np.sin(j * x)]
        a = np.column_stack(cols)
        curve = a @ np.linalg.lstsq(a[seen], y[seen], rcond=None)[0] if n else np.zeros_like(x)
        return pdf.assign(**{out: np.where(seen, y, curve)})

    return series.groupBy(*key).applyInPandas(fit, schema)
