"""Scores of a prediction on hidden cells, fold reports and what is drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import parse_report_name


def errors(pred: DataFrame) -> DataFrame:
    """One row per hidden cell and band: fold, t, v, band, y, p.  ``pred`` has bands, pred, hidden."""
    return pred.where("hidden").select("fold", "t", "v", F.posexplode(F.arrays_zip("bands", "pred")).alias("band", "z")).select("fold", "t", "v", "band", F.col("z.bands").alias("y"), F.col("z.pred").alias("p"))


def _mae() -> Column:
    return F.avg(F.abs(F.col("p") - F.col("y")))


def _rmse() -> Column:
    return F.sqrt(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))))


def metrics(pred: DataFrame, sets: list[list[str]]) -> DataFrame:
    """MAE and RMSE for several groupings in one pass (grouping sets over fold, t); a cell counts by its first band."""
    e = errors(pred)
    cols = [F.col("fold"), F.col("t")]
    return e.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.count_if(F.col("band") == 0).alias("n_cells"), _mae().alias("mae"), _rmse().alias("rmse"))


def r2(pred: DataFrame, *keys: str) -> DataFrame:
    """Coefficient of determination by band and its plain mean: constant bands give 1 if met exactly, else 0."""
    by = band_r2(pred, *keys)
    return by.groupBy(*keys).agg(F.avg("r2").alias("r2")) if keys else by.agg(F.avg("r2").alias("r2"))


def band_r2(pred: DataFrame, *keys: str) -> DataFrame:
    e = errors(pred)
    # moments about the band's mean: two combinable aggregates instead of a difference of large sums
    means = F.broadcast(e.groupBy(*keys, "band").agg(F.avg("y").alias("m")))  # a row for each group and band
    s = e.join(means, [*keys, "band"]).groupBy(*keys, "band").agg(F.count("*").alias("n"), F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("res"), F.sum((F.col("y") - F.col("m")) * (F.col("y") - F.col("m"))).alias("tot"))
    value = F.when(F.col("n") < 2, F.lit(None).cast("double")).when(F.col("tot") == 0, F.when(F.col("res") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide("res", "tot"))
    return s.select(*keys, "band", "n", value.alias("r2"))


def ssim(cells: DataFrame, a: str, b: str, data_range: float = 2.0, win: int = 7) -> DataFrame:
    """Structural similarity by date over dense images: (t, ssim).

    ``cells``: t, x, y and two band arrays.  Uniform window, sample covariance, mean over the pixels whose
    window lies inside and over bands.  Moments are running sums along y, then along x.
    """
    half, n = win // 2, float(win * win)
    long = cells.select("t", "x", "y", F.posexplode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("band", "z")).select("t", "x", "y", "band", "z.a", "z.b")
    long = long.withColumns({"aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b")})
    names = ["a", "b", "aa", "bb", "ab"]
    along_y = Window.partitionBy("t", "band", "x").orderBy("y").rowsBetween(-half, half)
    along_x = Window.partitionBy("t", "band", "y").orderBy("x").rowsBetween(-half, half)
    one = long.select("t", "band", "x", "y", *[F.sum(c).over(along_y).alias(c) for c in names], F.count("*").over(along_y).alias("ny"))
    two = one.select("t", "band", *[F.sum(c).over(along_x).alias(c) for c in names], "ny", F.count("*").over(along_x).alias("nx")).where((F.col("nx") == win) & (F.col("ny") == win))
    mu_a, mu_b = F.col("a") / n, F.col("b") / n
    norm = n / (n - 1)
    va, vb, vab = norm * (F.col("aa") / n - mu_a * mu_a), norm * (F.col("bb") / n - mu_b * mu_b), norm * (F.col("ab") / n - mu_a * mu_b)
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    value = ((2 * mu_a * mu_b + c1) * (2 * vab + c2)) / ((mu_a * mu_a + mu_b * mu_b + c1) * (va + vb + c2))
    return two.groupBy("t").agg(F.avg(value).alias("ssim"))


def timed_report(report: DataFrame, pred: DataFrame, seconds: dict[int, tuple[float, float]]) -> DataFrame:
    """A fold report in the order of its file: adds day (null for totals), and t_train and t_pred of the fold.

    ``pred``: cells with t and day; ``seconds``: fold -> (training, prediction).
    """
    days = F.broadcast(pred.select(F.col("t").cast("string").alias("t"), "day").distinct())
    took = F.create_map(*[F.lit(x) for f, s in seconds.items() for x in (int(f), F.struct(F.lit(float(s[0])).alias("t_train"), F.lit(float(s[1])).alias("t_pred")))])
    return report.join(days, "t", "left").withColumn("_s", took[F.col("fold")]).select("fold", *([c for c in ("version",) if c in report.columns]), "t", "day", "obs", "miss", "hid", "mae", "rmse", "r2", "ssim", "_s.t_train", "_s.t_pred")


# Columns of report files, by kind.
FOLD_FILE = "t string, day int, obs long, miss long, hid long, mae double, rmse double, r2 double, ssim double, t_train double, t_pred double"
CV_FILE = "t string, day int, obs long, miss long, hid long, mae double, mae_std double, rmse double, rmse_std double, r2 double, r2_std double, ssim double, ssim_std double, t_train double, t_pred double"


def read_reports(spark, folder: str, kind: str = CV_FILE) -> DataFrame:
    """Report files below ``folder`` in partition folders (version=..., and fold=... for fold reports); 'n.a.' is null."""
    return spark.read.schema(kind).option("header", True).option("nullValue", "n.a.").option("basePath", folder).csv(folder)


def fold_report(pred: DataFrame) -> DataFrame:
    """fold, t ('all' for totals), obs, miss, hid, mae, rmse, r2, ssim.

    Totals score all hidden cells jointly; their miss counts only dates that have hidden cells.
    SSIM compares the image of the fold's cells (0 elsewhere) with the prediction put on hidden cells.
    """
    box = pred.groupBy("fold").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    dates = pred.select("fold", "t", F.size("bands").alias("d")).distinct()
    grid = dates.join(F.broadcast(box), "fold").select("fold", "t", "d", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("fold", "t", "d", "x", F.explode(F.sequence("y0", "y1")).alias("y"))
    zero = F.array_repeat(F.lit(0.0), F.col("d"))
    dense = grid.join(pred.select("fold", "t", "x", "y", "bands", F.when(F.col("hidden"), F.col("pred")).otherwise(F.col("bands")).alias("put")), ["fold", "t", "x", "y"], "left")
    dense = dense.select(F.struct("fold", "t").alias("t"), "x", "y", F.coalesce("bands", zero).alias("bands"), F.coalesce("put", zero).alias("put"))
    similar = ssim(dense, "bands", "put").select("t.fold", "t.t", "ssim")
    counts = pred.groupBy("fold", "t").agg(F.count_if(F.col("observed") & ~F.col("hidden")).alias("obs"), F.count_if(~F.col("observed")).alias("miss"), F.count_if("hidden").alias("hid"), F.count("*").alias("size"))
    scored = metrics(pred, [["fold", "t"], ["fold"]])
    by_t = counts.join(scored.where("t IS NOT NULL").drop("n_cells"), ["fold", "t"], "left").join(r2(pred, "fold", "t"), ["fold", "t"], "left").join(similar, ["fold", "t"], "left")
    zeroed = [F.when(F.col("hid") > 0, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("mae", "rmse", "r2", "ssim")]
    rows = by_t.select("fold", F.col("t").cast("string").alias("t"), "obs", "miss", "hid", *zeroed)
    miss = F.sum(F.when(F.col("hid") > 0, F.col("miss")).otherwise(0))
    total = by_t.groupBy("fold").agg(F.sum("size").alias("size"), miss.alias("miss"), F.sum("hid").alias("hid"), F.avg(F.when(F.col("hid") > 0, F.col("ssim"))).alias("ssim"))
    total = total.join(scored.where("t IS NULL").select("fold", "mae", "rmse"), "fold", "left").join(r2(pred, "fold"), "fold", "left")
    total = total.select("fold", F.lit("all").alias("t"), (F.col("size") - F.col("hid") - F.col("miss")).alias("obs"), "miss", "hid", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mae", "rmse", "r2", "ssim")])
    return rows.unionByName(total)


def cv_report(folds: DataFrame) -> DataFrame:
    """By version and t over folds: summed counts, means and population deviations weighted by hidden cells.

    Zeros where nothing is hidden; the 'all' row takes the plain mean then.  Where the fold reports have day, t_train and
    t_pred, so has the result, with the mean seconds over the folds of each version.
    """
    w = F.col("hid").cast("double")
    scores = ("mae", "rmse", "r2", "ssim")
    means = folds.groupBy("version", "t").agg(*[F.sum(c).alias(c) for c in ("obs", "miss", "hid")], *[F.coalesce(F.try_divide(F.sum(w * F.col(c)), F.sum(w)), F.when(F.col("t") == "all", F.avg(c)).otherwise(0.0)).alias(c) for c in scores])
    spread = folds.join(means.select("version", "t", *[F.col(c).alias(f"m_{c}") for c in scores]), ["version", "t"]).groupBy("version", "t").agg(*[F.sqrt(F.coalesce(F.try_divide(F.sum(w * (F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}"))), F.sum(w)), F.lit(0.0))).alias(f"{c}_std") for c in scores])
    out = ["version", "t", "obs", "miss", "hid"] + [x for c in scores for x in (c, f"{c}_std")]
    report = means.join(spread, ["version", "t"])
    if "t_train" not in folds.columns:
        return report.select(*out)
    took = F.broadcast(folds.where("t = 'all'").groupBy("version").agg(F.avg("t_train").alias("t_train"), F.avg("t_pred").alias("t_pred")))
    days = F.broadcast(folds.select("t", "day").distinct())
    return report.join(took, "version", "left").join(days, "t", "left").select("version", "t", "day", *out[2:], "t_train", "t_pred")


def comparison_report(reports: DataFrame) -> DataFrame:
    """The total row of each version; deviations and seconds are null where a report has none."""
    has = [c if c in reports.columns else F.lit(None).cast("double").alias(c) for c in ("mae_std", "rmse_std", "r2_std", "ssim_std")]
    return reports.where("t = 'all'").select("version", "obs", "miss", "hid", "mae", has[0], "rmse", has[1], "r2", has[2], "ssim", has[3], *[c for c in ("t_train", "t_pred") if c in reports.columns])


def cumulative_error(report: DataFrame) -> DataFrame:
    """Running share of the error over dates, scaled to the total row; dates without error are left out."""
    total = F.broadcast(report.where("t = 'all'").select("version", F.col("mae").alias("total")))
    rows = report.where("t <> 'all' AND mae <> 0").withColumn("t", F.col("t").cast("int")).join(total, "version")
    own = Window.partitionBy("version")
    run = own.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("version", "t", (F.sum("mae").over(run) / F.sum("mae").over(own) * F.col("total")).alias("error"))


def error_by_lambda(comparison: DataFrame) -> DataFrame:
    """(series, lam, error): random-field versions by all but lambda; others as level lines over the range of lambda."""
    rows = comparison.select("version", "mae", *parse_report_name(F.col("version")))
    field = rows.where("lam IS NOT NULL")
    name = F.concat_ws(",", F.col("stop").cast("string"), "shape", "tprior", "sprior", "predict", F.col("em").cast("string"), F.col("k").cast("string"), "hide")
    ends = field.agg(F.coalesce(F.min("lam"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("lam"), F.lit(1.0)).alias("hi"))
    level = rows.where("lam IS NULL").crossJoin(F.broadcast(ends)).select(F.col("version").alias("series"), F.explode(F.array("lo", "hi")).alias("lam"), F.col("mae").alias("error"))
    return field.select(name.alias("series"), "lam", F.col("mae").alias("error")).unionByName(level)


def coverage(report: DataFrame) -> DataFrame:
    """(version, t, kind, n): obs, miss and hid of each date as rows."""
    return report.where("t <> 'all'").unpivot(["version", "t"], ["obs", "miss", "hid"], "kind", "n")


def downsample(series: DataFrame, key: str, order: str, most: int = 2000) -> DataFrame:
    """Every ceil(n / most)-th point of each series."""
    own = Window.partitionBy(key)
    n = series.withColumn("_i", F.row_number().over(own.orderBy(order)) - 1).withColumn("_n", F.count("*").over(own))
    return n.where(F.col("_i") % F.ceil(F.col("_n") / float(most)) == 0).drop("_i", "_n")
