"""Cross-validated gap filling from a cube to its reports."""

from __future__ import annotations

import argparse
import hashlib
import json
import time
from concurrent.futures import ThreadPoolExecutor
from copy import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, masking, space
from ..sources import cubes
from .methods import Method, get_method
from .tables import stored


class Validation:
    """Folds and artificial gaps of a cube; all folds are one table with ``fold`` as a key.

    The seed orders shuffled folds and places gaps.  With ``state`` the split and the gaps are kept there as Parquet and
    taken up again by the next run.
    """

    def __init__(self, cube: DataFrame, kfolds: int = 2, shuffle: bool = False, amount: float = 0.2, hide: str = "spatial_clouds", seed: int = 0, dates: list[int] | None = None, state: str | None = None, **options) -> None:
        n = cube.agg(F.max("v")).first()[0] + 1
        cells = masking.assign_folds(cube, n, kfolds, seed if shuffle else None)
        self.kfolds, self.hide = kfolds, f"{hide.lower()}{str(amount).replace('.', '_')}"
        if state:
            spark = cube.sparkSession
            split = _kept(spark, f"{state}/folds", lambda: cells.select("v", "fold").distinct())
            cells = cells.drop("fold").join(split, "v")
            hidden = _kept(spark, f"{state}/{self.hide}", lambda: masking.hide(cells, hide, amount, dates, seed=seed, **options))
        else:
            hidden = masking.hide(cells, hide, amount, dates, seed=seed, **options)
        self.cells, self.hidden = cells, hidden
        self.masked = stored(masking.masked_view(cells, hidden))

    def run(self, method: Method, at_once: int = 1) -> DataFrame:
        """Cells with pred: each fold is predicted by a model fitted on the others.

        A method that learns nothing predicts all folds in one pass; others are fitted fold by fold, ``at_once`` of
        them at the same time.  ``seconds`` holds the time of training and prediction of each fold, work included.
        """

        def one(f: int):
            own, began = copy(method), time.time()
            own.fit(self.masked.where(F.col("fold") != f))
            fitted = time.time()
            pred = stored(own.predict(self.masked.where(F.col("fold") == f)))
            return pred, (round(fitted - began, 4), round(time.time() - fitted, 4))

        if method.fits:
            with ThreadPoolExecutor(max(1, at_once)) as pool:
                found = list(pool.map(one, range(self.kfolds)))
            parts, self.seconds = [p for p, _ in found], {f: s for f, (_, s) in enumerate(found)}
        else:
            began = time.time()
            parts = [stored(method.predict(self.masked))]
            self.seconds = {f: (0.0, round((time.time() - began) / self.kfolds, 4)) for f in range(self.kfolds)}
        pred = parts[0]
        for p in parts[1:]:
            pred = pred.unionByName(p)
        return stored(self.masked.join(pred, ["fold", "t", "v"]))

    def report(self, predicted: DataFrame, version: str, timed: bool = False) -> DataFrame:
        """The fold report of a version; ``timed`` adds day, t_train and t_pred."""
        report = evaluate.fold_report(predicted).withColumn("version", F.lit(version))
        return evaluate.timed_report(report, predicted, self.seconds) if timed else report


def _kept(spark: SparkSession, path: str, make) -> DataFrame:
    """A table that is made once and read from then on."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def config_hash(config: dict) -> str:
    """State folders are named by this, so a run never takes up another one's state."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def pictures(predicted: DataFrame, valid: Validation, source: cubes.Source, folder: str, name: str) -> list[str]:
    """The picture files of a run: data, gaps, prediction products, outlines, errors, and each fold's test area and gaps."""
    out = []

    def grey(df: DataFrame, column: str, where: str, label: str):
        out.extend(space.save_pictures(space.encode_png(space.render_bw(df, column), "grey"), f"{folder}/{where}", label))

    def colour(df: DataFrame, column: str, where: str):
        rgb = space.render_rgb(df.select("t", "x", "y", F.col(column).alias("bands")), source.shown, source.low, source.high)
        out.extend(space.save_pictures(space.encode_png(rgb, "rgb"), f"{folder}/{where}", "img"))

    depth = predicted.select(F.size("bands").alias("d")).first().d
    made = space.products(predicted)
    flat = space.outline_colour(source.low, source.high, depth, source.shown)
    edged = space.outlined(predicted, space.outline_width(source.gap_width), flat)
    colour(valid.cells, "bands", "data")
    colour(predicted.withColumn("z", F.when(F.col("observed"), F.col("bands")).otherwise(F.transform("bands", lambda b: F.lit(0.0)))), "z", "observed")
    for column, where in (("pred_hidden", f"pred_hidden_{name}"), ("pred_gaps", f"pred_{name}")):
        colour(made, column, where)
    for column, where in (("pred_outline", f"pred_outline_{name}"), ("original_outline", "original_outline")):
        colour(edged, column, where)
    grey(made, "error", f"pred_error_{name}", "img")
    split = space.split_images(valid.cells, valid.hidden)
    for f in range(valid.kfolds):
        own = split.where(F.col("fold") == f)
        grey(own.where("t = 0"), "test", f"cv_{f}_test", "test")
        grey(own, "hidden", f"cv_{f}_test", valid.hide)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Fill gaps of a cube and score the result")
    p.add_argument("-d", "--data", default="board", help="a registered source, source:path, or C to clean up the folder of -o")
    p.add_argument("-r", "--range", default=None, help="x0,x1,y0,y1")
    p.add_argument("-k", "--kfolds", type=int, default=2)
    p.add_argument("-H", "--hide", type=float, default=0.2)
    p.add_argument("-M", "--hide-method", default="spatial_clouds")
    p.add_argument("-s", "--shuffle", action="store_true")
    p.add_argument("-S", "--seed", type=int, default=0)
    p.add_argument("-m", "--method", default="LIN")
    p.add_argument("-c", "--config", default="default")
    p.add_argument("-I", "--iterations", type=int, default=2)
    p.add_argument("-C", "--cpus", type=int, default=1, help="folds that are fitted at the same time")
    p.add_argument("-o", "--out", default=None)
    p.add_argument("--images", action="store_true", help="write pictures as well")
    return p


#: Options that the first run in a folder fixes for the later ones.
SETUP = ("data", "range", "kfolds", "shuffle", "seed")


def _setup(spark: SparkSession, a: argparse.Namespace) -> None:
    """Takes up the setup that stands in the folder, or leaves this one there."""
    path = f"{a.out}/config"
    made = _kept(spark, path, lambda: spark.createDataFrame([(json.dumps({k: getattr(a, k) for k in SETUP}),)], "config string"))
    for k, v in json.loads(made.first().config).items():
        setattr(a, k, v)


def cleanup(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    """The cross-validation report.  With -o: folds/, report/ and comparison/ as CSV (by version), curves/ as plot data."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.data == "C":
        if a.out:
            cleanup(spark, a.out)
        return None
    if a.out:
        _setup(spark, a)
    source = cubes.get_source(a.data.split(":", 1)[0])
    cube = cubes.get_cube(spark, a.data, cache=f"{a.out}/cube" if a.out else None)
    if a.range:
        x0, x1, y0, y1 = map(int, a.range.split(","))
        w, h = cube.agg(F.max("x") + 1, F.max("y") + 1).first()
        cube = cubes.subrange(cube, x0, x1, y0, y1, w, h)
    method = get_method(a.method, a.config)
    if hasattr(method, "rounds"):
        method.rounds, method.seed = a.iterations, a.seed
    state = f"{a.out}/state/{config_hash({k: getattr(a, k) for k in SETUP})}" if a.out else None
    valid = Validation(cube, a.kfolds, a.shuffle, a.hide, a.hide_method, a.seed, source.hide_dates, state)
    predicted = valid.run(method, a.cpus)
    name = f"{method.name()}_{valid.hide}"
    folds = valid.report(predicted, name, timed=True)
    if not a.out:
        return evaluate.cv_report(folds)
    for f in range(a.kfolds):
        folds.where(F.col("fold") == f).drop("fold", "version").coalesce(1).write.mode("overwrite").csv(f"{a.out}/folds/version={name}/fold={f}", header=True)
    report = evaluate.cv_report(evaluate.read_reports(spark, f"{a.out}/folds", evaluate.FOLD_FILE).where(F.col("version") == name))
    report.drop("version").coalesce(1).write.mode("overwrite").csv(f"{a.out}/report/version={name}", header=True)
    every = evaluate.read_reports(spark, f"{a.out}/report")
    compared = evaluate.comparison_report(every)
    compared.orderBy("version").coalesce(1).write.mode("overwrite").csv(f"{a.out}/comparison", header=True)
    evaluate.cumulative_error(every).orderBy("version", "t").coalesce(1).write.mode("overwrite").csv(f"{a.out}/curves/error_over_time", header=True)
    evaluate.error_by_lambda(compared).orderBy("series", "lam").coalesce(1).write.mode("overwrite").csv(f"{a.out}/curves/error_by_lambda", header=True)
    if a.images:
        pictures(predicted, valid, source, f"{a.out}/imgs", name)
    return report


if __name__ == "__main__":
    shown = main()
    if shown is not None:
        shown.show(truncate=False)
