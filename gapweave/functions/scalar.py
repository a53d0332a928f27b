"""Column expressions over cells and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_mean(c: str) -> Column:
    """Mean of a column of two decimals through integers: the same whatever the order of the sum."""
    return F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / (F.count(c) * F.lit(100.0))


def portable_hash(*cols: Column, seed: int = 0) -> Column:
    """Pseudo-random order in 0 .. 2^31 - 2 from plain integer arithmetic, so that any engine can repeat it."""
    total = F.lit(0).cast("long")
    for c, m in zip(cols, (7919, 104729, 1299709)):
        total = total + c * m
    by, plus = 48271 + 194 * seed % 2147483647, (12345 + 1566083941 * seed) % 2147483647  # another order for each seed
    return F.pmod(F.pmod(total, F.lit(1000003)) * by + plus, F.lit(2147483647))


def vertex(x: Column, y: Column, height: int) -> Column:
    return x * height + y


def project_value(c: Column, src_min: float, src_max: float, dst_min: float, dst_max: float) -> Column:
    """Linear rescaling; null where the source range is empty."""
    return F.try_divide((c - src_min) * (dst_max - dst_min), F.lit(float(src_max - src_min))) + dst_min


def mean_abs_error(a: str, b: str) -> Column:
    """Mean over bands of |a - b|."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d) / F.size(a)


def day_label(day: Column, year: int) -> Column:
    """Day of the year as 'Jan 01 2018'."""
    return F.date_format(F.date_add(F.make_date(F.lit(year), F.lit(1), F.lit(1)), (day - 1).cast("int")), "MMM dd yyyy")


def error_label(mae: Column) -> Column:
    return F.when(mae == 0, F.lit("n.a. ")).otherwise(F.format_string("%4.1f", mae))


# How a random-field report is named, and its parts in order (case does not matter).
NAME = r"(?i)^MRF_S(\d+(?:_\d+)?)_([a-z][a-z0-9]*)_([a-z][a-z0-9]*)_(\d+(?:_\d+)?)_([a-z0-9]+)_([a-z]+)_em(\d+)_(\d+)Means_(.+)$"
NAME_PARTS = ("stop", "tprior", "sprior", "lam", "shape", "predict", "em", "k", "hide")


def parse_report_name(c: Column) -> list[Column]:
    """Columns stop and lam (double), priors, shape, predict, em, k, hide; null where the name is another."""
    out = []
    for i, name in enumerate(NAME_PARTS, 1):
        part = F.when(c.rlike(NAME), F.regexp_extract(c, NAME, i))
        if name in ("stop", "lam"):
            part = F.replace(part, F.lit("_"), F.lit(".")).cast("double")
        elif name in ("em", "k"):
            part = part.cast("int")
        out.append(part.alias(name))
    return out
