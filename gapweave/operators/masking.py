"""Folds and artificial gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import portable_hash

_BUCKETS = 1024


def assign_folds(cells: DataFrame, n_vertices: int, k: int, shuffle_seed: int | None = None) -> DataFrame:
    """Adds fold: consecutive vertex ranges of equal size, or ranges of a seeded order of the vertices.

    The plain form is arithmetic on v; the shuffled one ranks vertices within hash buckets.
    """
    if not 2 <= k <= n_vertices:
        raise ValueError("folds must be at least 2 and at most the number of vertices")
    at = F.col("v")
    if shuffle_seed is not None:
        v = running(cells.select("v").distinct().withColumn("fold", F.lit(0)), portable_hash(F.col("v"), seed=shuffle_seed), ["v"], F.lit(1))
        cells = cells.join(v.select("v", F.col("before").alias("_at")), "v")
        at = F.col("_at")
    fold = F.floor(((at + 1) * k - 1) / n_vertices).cast("int")
    return cells.withColumn("fold", fold).drop("_at")


def running(df: DataFrame, order, ties: list[str], weight) -> DataFrame:
    """Adds before: the sum of weights before a row, in the fold's order.

    Rows are ranked within hash buckets and the buckets' totals added up, so a fold is spread over tasks.
    """
    b = df.withColumn("_o", order).withColumn("_w", weight.cast("long")).withColumn("_b", F.floor(F.col("_o") / (2147483647 / _BUCKETS)).cast("int"))
    totals = b.groupBy("fold", "_b").agg(F.sum("_w").alias("_s"))
    offset = totals.select("fold", "_b", F.coalesce(F.sum("_s").over(Window.partitionBy("fold").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inside = F.coalesce(F.sum("_w").over(Window.partitionBy("fold", "_b").orderBy("_o", *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("_in", inside).join(offset, ["fold", "_b"]).withColumn("before", F.col("_off") + F.col("_in")).drop("_o", "_w", "_b", "_in", "_off")


def _target(cells: DataFrame, amount: float) -> DataFrame:
    return F.broadcast(cells.where("observed").groupBy("fold").agg(F.floor(F.count("*") * F.lit(amount)).cast("long").alias("target")))


def hide_latest(cells: DataFrame, amount: float, seed: int = 0) -> DataFrame:
    """(fold, t, v): whole dates from the last one back, until the share is reached; the seed plays no part."""
    by_t = cells.where("observed").groupBy("fold", "t").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("fold").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dates = by_t.withColumn("before", before).join(_target(cells, amount), "fold").where("before < target").select("fold", "t")
    return cells.where("observed").join(F.broadcast(dates), ["fold", "t"]).select("fold", "t", "v")


def hide_random(cells: DataFrame, amount: float, seed: int = 0) -> DataFrame:
    """(fold, t, v): exactly the share of observed cells."""
    own = running(cells.where("observed").select("fold", "t", "v"), portable_hash(F.col("v"), F.col("t"), seed=seed), ["v", "t"], F.lit(1))
    return own.join(_target(cells, amount), "fold").where("before < target").select("fold", "t", "v")


def hide_random_spatials(cells: DataFrame, amount: float, seed: int = 0) -> DataFrame:
    """(fold, t, v): all observed dates of random vertices, until the share is reached."""
    seen = cells.where("observed")
    own = running(seen.groupBy("fold", "v").agg(F.count("*").alias("n")), portable_hash(F.col("v"), seed=seed), ["v"], F.col("n"))
    chosen = own.join(_target(cells, amount), "fold").where("before < target").select("fold", "v")
    return seen.join(chosen, ["fold", "v"]).select("fold", "t", "v")


def template(width: int, shape: str = "circle") -> np.ndarray:
    """Boolean gap shape: a disc, or a cloud made of four discs."""
    c = np.arange(width) - (width - 1) / 2
    x, y = c[:, None] / max(width, 1), c[None, :] / max(width, 1)
    if shape == "circle":
        return x * x + y * y <= 0.25
    if shape == "cloud":
        discs = ((0.0, 0.0, 0.3), (-0.1, -0.25, 0.2), (0.12, 0.22, 0.24), (0.16, -0.1, 0.22))
        return np.any([(x - a) ** 2 + (y - b) ** 2 <= r * r for a, b, r in discs], axis=0)
    raise ValueError(f"no shape {shape!r}")


def hide_shapes(cells: DataFrame, amount: float, shape: str, width: int, seed: int = 0) -> DataFrame:
    """(fold, t, v): gaps of one shape placed greedily on free observed cells, in a seeded order of the cells.

    A candidate (its top left cell and date) is placed if the whole shape is observed, inside the fold and not
    yet hidden.  Shapes on different dates never touch, so each date is a task of its own; of all placements of
    a fold the first ones in order are kept, until the share is reached.  Fails if candidates run out before.
    The walk over one date is one after another by definition: a task holds one image of one fold (some 60 bytes a
    cell), however many dates and folds there are.
    """
    stamp = np.argwhere(template(width, shape))
    target = _target(cells, amount)
    order = F.pmod(F.xxhash64(F.lit(seed), "fold", "t", "v"), F.lit(2147483647))
    marked = cells.select("fold", "t", "x", "y", "v", "observed", order.alias("o")).join(target, "fold")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "v"])
        x, y, v, o = (pdf[c].to_numpy() for c in ("x", "y", "v", "o"))
        free = np.zeros((x.max() + width + 1, y.max() + width + 1), bool)
        free[x, y] = pdf["observed"].to_numpy()
        ids = np.zeros(free.shape, np.int64)
        ids[x, y] = v
        target, hidden, picked = int(pdf["target"].iloc[0]), 0, []
        for i in range(len(pdf)):
            if hidden >= target:  # no later placement of this date can be among the first
                break
            a, b = x[i] + stamp[:, 0], y[i] + stamp[:, 1]
            if free[a, b].all():
                free[a, b] = False
                hidden += len(stamp)
                picked.append((pdf["fold"].iloc[0], pdf["t"].iloc[0], o[i], v[i], ids[a, b]))
        return pd.DataFrame(picked, columns=["fold", "t", "o", "at", "vs"])

    placed = marked.groupBy("fold", "t").applyInPandas(place, "fold int, t int, o long, at long, vs array<long>")
    total = placed.groupBy("fold").agg(F.sum(F.size("vs")).alias("total"))
    short = F.raise_error(F.format_string(f"fold %d: no room for more {shape} gaps of width {width}", "fold"))
    folds = target.join(total, "fold", "left").select("fold", "target", F.when(F.coalesce("total", F.lit(0)) < F.col("target"), short).otherwise(F.lit(True)).alias("enough"))
    first = running(placed, F.col("o"), ["t", "at"], F.size("vs")).join(F.broadcast(folds), "fold").where("enough AND before < target")
    return first.select("fold", "t", F.explode("vs").alias("v"))


def hide_spatial_gaps(cells: DataFrame, amount: float, width: int = 5, seed: int = 0) -> DataFrame:
    return hide_shapes(cells, amount, "circle", width, seed)


def hide_spatial_clouds(cells: DataFrame, amount: float, width: int = 5, seed: int = 0) -> DataFrame:
    return hide_shapes(cells, amount, "cloud", width, seed)


HIDE = {f.__name__.removeprefix("hide_"): f for f in (hide_latest, hide_random, hide_random_spatials, hide_spatial_gaps, hide_spatial_clouds)}


def hide(cells: DataFrame, method: str, amount: float, dates: list[int] | None = None, **options) -> DataFrame:
    """The gaps of a registered method; with ``dates`` only cells of these count as observed and are hidden."""
    if method.lower() not in HIDE:
        raise NotImplementedError(f"no hide method {method!r}; there are {sorted(HIDE)}")
    if dates is not None:
        cells = cells.withColumn("observed", F.col("observed") & F.col("t").isin(dates))
    return HIDE[method.lower()](cells, amount, **options)


def masked_view(cells: DataFrame, hidden: DataFrame) -> DataFrame:
    """Cells with hidden, and bands null where a cell is a gap or hidden."""
    marked = cells.join(hidden.withColumn("hidden", F.lit(True)), ["fold", "t", "v"], "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))
    return marked.withColumn("seen", F.when(F.col("observed") & ~F.col("hidden"), F.col("bands")))
