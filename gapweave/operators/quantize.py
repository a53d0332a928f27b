"""Vector quantisation of band vectors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def _distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)


def fit_centroids(rows: DataFrame, column: str, k: int, seed: int = 0) -> DataFrame:
    """(state, centroid) by k-means."""
    model = KMeans(k=k, seed=seed, featuresCol="_f").fit(rows.select(array_to_vector(F.col(column)).alias("_f")))
    table = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return rows.sparkSession.createDataFrame(table, "state int, centroid array<double>")


def label(rows: DataFrame, column: str, centroids: DataFrame, bound: int = 4096) -> DataFrame:
    """Adds state and squared distance of the nearest centroid (the smaller state on ties); null vectors stay null.

    The centroid table goes along as one array (its size is checked), so the search is one expression per row.
    """
    if centroids.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} centroids")
    one = F.broadcast(centroids.agg(F.array_sort(F.collect_list(F.struct("state", "centroid"))).alias("_c")))
    best = F.array_min(F.transform("_c", lambda c: F.struct(_distance(F.col(column), c["centroid"]).alias("d"), c["state"].alias("state"))))
    out = rows.crossJoin(one).withColumn("_b", F.when(F.col(column).isNotNull(), best))
    return out.withColumn("state", F.col("_b.state")).withColumn("d2", F.col("_b.d")).drop("_b", "_c")


def restore(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Adds the centroid of each state."""
    return rows.join(F.broadcast(centroids), "state", "left")


def quantisation_rmse(rows: DataFrame, column: str, centroids: DataFrame) -> DataFrame:
    """Root mean squared difference, over all components, between vectors and their centroids."""
    return label(rows, column, centroids).where(F.col("d2").isNotNull()).agg(F.sqrt(F.sum("d2") / F.sum(F.size(column))).alias("rmse"))


def similarity(centroids: DataFrame) -> DataFrame:
    """(s0, s1, logsim): distances scaled so that the nearest pair has 1 and the farthest 0, rows normalised, log."""
    a, b = centroids.select(F.col("state").alias("s0"), F.col("centroid").alias("c0")), centroids.select(F.col("state").alias("s1"), F.col("centroid").alias("c1"))
    pairs = a.crossJoin(F.broadcast(b)).select("s0", "s1", F.round(F.sqrt(_distance("c0", "c1")), 9).alias("d"))
    whole = Window.partitionBy(F.lit(0))
    lo, hi = F.min("d").over(whole), F.max("d").over(whole)
    sim = pairs.withColumn("sim", F.coalesce(1 - F.try_divide(F.col("d") - lo, hi - lo), F.lit(1.0)))
    share = F.col("sim") / F.sum("sim").over(Window.partitionBy("s0"))
    return sim.select("s0", "s1", F.when(share > 0, F.log(share)).alias("logsim"))
