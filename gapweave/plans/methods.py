"""Gap-filling methods over a masked cube, by name."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import field, quantize, space, temporal


class Method:
    """fit() sees the cells of the other folds, predict() returns (fold, t, v, pred) for all cells of the folds.

    Cells: fold, t, day, x, y, v, bands, observed, hidden, seen (bands where known).
    """

    default = ""
    #: Whether fit() learns anything; if not, all folds are predicted in one pass.
    fits = False

    def __init__(self, config: str = "default") -> None:
        self.config = self.default if config == "default" else config
        self.configure()

    def configure(self) -> None:
        if self.config:
            raise RuntimeError(f"{type(self).__name__} takes no configuration")

    def name(self) -> str:
        return type(self).__name__.upper()

    def fit(self, cells: DataFrame) -> None:
        pass

    def predict(self, cells: DataFrame) -> DataFrame:
        raise NotImplementedError


class _Series(Method):
    def fill(self, long: DataFrame) -> DataFrame:
        raise NotImplementedError

    def predict(self, cells: DataFrame) -> DataFrame:
        n = F.size("bands")
        long = cells.select("fold", "t", "day", "v", F.posexplode(F.coalesce("seen", F.array_repeat(F.lit(None).cast("double"), n))).alias("band", "value"))
        filled = self.fill(long).groupBy("fold", "t", "v").agg(F.array_sort(F.collect_list(F.struct("band", "filled"))).alias("b"))
        return filled.select("fold", "t", "v", F.transform("b", lambda s: s["filled"]).alias("pred"))


class Lin(_Series):
    def fill(self, long):
        return temporal.fill_linear(long, ["fold", "v", "band"], "day", "value")


class NN(_Series):
    def fill(self, long):
        return temporal.fill_nearest(long, ["fold", "v", "band"], "day", "value")


class Hants(_Series):
    default = "2,365"

    def configure(self):
        parts = self.config.split(",")
        if len(parts) != 2 or not parts[0].isdigit() or int(parts[0]) < 1:
            raise RuntimeError("harmonic filling needs frequencies,period")
        self.nof, self.period = int(parts[0]), float(parts[1])

    def fill(self, long):
        key = ["fold", "v", "band"]
        if self.nof == 2:
            return temporal.fill_harmonic(long, key, "day", "value", self.period)
        return temporal.fill_harmonics(long, key, "day", "value", self.period, self.nof)


class Nspi(Method):
    default = "30,4,0.0,10000.0"

    def configure(self):
        parts = self.config.split(",")
        if len(parts) != 4:
            raise RuntimeError("similarity filling needs min_similar,num_class,DN_min,DN_max")
        self.similar, self.classes, self.low, self.high = int(parts[0]), int(parts[1]), float(parts[2]), float(parts[3])

    def predict(self, cells):
        good = cells.select("fold", "t", "day", "x", "y", "v", "bands", F.col("seen").isNotNull().alias("good"))
        # a vertex lies in one fold, so folds can be filled together
        pred = space.similar_fill(good, self.classes, self.similar, self.low, self.high).select("t", "v", F.col("pred").alias("found"))
        return cells.join(pred, ["t", "v"], "left").select("fold", "t", "v", F.coalesce("seen", "found", F.transform("bands", lambda b: b * 0)).alias("pred"))


class KMeansStates:
    """Discretiser of band vectors; others with these three methods and ``info`` can take its place."""

    def info(self, k: int) -> str:
        return f"{k}Means"

    def fit(self, rows: DataFrame, column: str, k: int) -> DataFrame:
        return quantize.fit_centroids(rows, column, k)

    def label(self, rows: DataFrame, column: str, centroids: DataFrame) -> DataFrame:
        return quantize.label(rows, column, centroids)

    def restore(self, rows: DataFrame, centroids: DataFrame) -> DataFrame:
        return quantize.restore(rows, centroids)


class RandomField(Method):
    # Fixed value: the configuration by default.
    default = "0.01r,chain,noprior:noprior,0.1,map,8"
    rounds = 2
    fits = True
    seed = 0
    discretiser = KMeansStates()
    #: Hooks of the optimiser, see field.maximise.
    hooks: dict = {}

    def configure(self):
        self.spec = field.FieldConfig.parse(self.config)

    def name(self):
        stop, shape, prior, lam, predict, _ = self.config.replace(".", "_").split(",")
        return f"MRF_S{stop[:-1]}_{prior.replace(':', '_')}_{lam}_{shape}_{predict}_em{self.rounds}_{self.discretiser.info(self.spec.k)}"

    def _slices(self, cells: DataFrame) -> DataFrame:
        s = self.spec
        stencil = [(0, 0, 0)] if s.width == 1 else space.cross(s.width)
        known = cells.select("t", "x", "y", "v", "seen", F.col("seen").isNotNull().alias("observed"))
        near = space.gather(known, stencil, ["seen"])
        labelled = self.discretiser.label(near.select("v", (F.col("t") * len(stencil) + F.col("s")).cast("int").alias("node"), "seen"), "seen", self.centroids)
        return field.node_states(labelled.select("v", "node", "state"))

    def fit(self, cells):
        s = self.spec
        self.dates = cells.agg(F.max("t")).first()[0] + 1
        self.centroids = self.discretiser.fit(cells.where("seen IS NOT NULL"), "seen", s.k)
        self.table = np.array([r.centroid for r in self.centroids.orderBy("state").collect()])  # k rows
        k = len(self.table)
        self.links = field.edge_list(self.dates, s.width)
        slices = self._slices(cells)
        prior = lam = None
        if "noprior" not in (s.tprior, s.sprior):
            time = self._prior(s.tprior, slices, k, field.date_links(self.dates, s.width))
            space_ = self._prior(s.sprior, slices, k, field.leaf_links(self.dates, s.width))
            # a row of edges over time comes first
            prior = np.stack([time if e < self.dates - 1 else space_ for e in range(len(self.links))])
            ends = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(int(u)).alias("u"), F.lit(int(w)).alias("w")) for e, (u, w) in enumerate(self.links)])
            gone = slices.select(F.explode(ends).alias("l"), "nodes").groupBy("l.e").agg(F.avg(((F.get("nodes", F.col("l.u")) < 0) | (F.get("nodes", F.col("l.w")) < 0)).cast("int")).alias("g"))
            lam = np.zeros(len(self.links))
            for r in gone.collect():  # a row for each edge
                lam[r.e] = s.lam * r.g
        self.theta, self.paths = field.train(slices, self.links, k, self.rounds, s.stop, s.stop_kind, prior, lam, **self.hooks)

    def _prior(self, kind: str, slices: DataFrame, k: int, links: np.ndarray) -> np.ndarray:
        """The k x k matrix of one kind of edges; transition counts are those over ``links`` of all slices."""
        if kind == "l2" or not len(links):
            return np.zeros((k, k))
        if kind == "es":
            table, col = quantize.similarity(self.centroids), "logsim"
        else:
            table, col = field.transitions(slices, field.slice_pairs(slices, links), k), "logp"
        out = np.full((k, k), -30.0)
        for r in table.collect():  # k * k rows
            if r[col] is not None:
                out[r.s0, r.s1] = r[col]
        return out

    def save(self, spark, folder: str) -> None:
        """The fitted field as two Parquet tables: weights by edge and pair of states, and centroids."""
        weights = [(e, int(u), int(w), self.theta[e].ravel().tolist()) for e, (u, w) in enumerate(self.links)]
        spark.createDataFrame(weights, "e int, u int, w int, theta array<double>").withColumn("config", F.lit(self.config)).withColumn("dates", F.lit(int(self.dates))).write.mode("overwrite").parquet(f"{folder}/edges")
        self.centroids.write.mode("overwrite").parquet(f"{folder}/centroids")

    @classmethod
    def load(cls, spark, folder: str) -> RandomField:
        rows = spark.read.parquet(f"{folder}/edges").orderBy("e").collect()  # a row for each edge
        self = cls(rows[0].config)
        self.dates, self.links = rows[0].dates, np.array([(r.u, r.w) for r in rows], np.int64)
        self.centroids = spark.read.parquet(f"{folder}/centroids")
        self.table = np.array([r.centroid for r in self.centroids.orderBy("state").collect()])  # k rows
        k = len(self.table)
        self.theta = np.array([r.theta for r in rows]).reshape(len(rows), k, k)
        return self

    def predict(self, cells):
        size, centre = 2 * self.spec.width - 1, self.spec.width - 1
        got = field.infer(self._slices(cells), self.links, self.theta, self.spec.predict, self.table, self.seed)
        got = got.where(F.col("node") % size == centre).select(F.floor(F.col("node") / size).cast("int").alias("t"), "v", "pred")
        return cells.join(got, ["t", "v"]).select("fold", "t", "v", F.coalesce("seen", "pred").alias("pred"))


METHODS = {"lin": Lin, "nn": NN, "hants": Hants, "nspi": Nspi, "randomfield": RandomField}


def get_method(name: str, config: str = "default") -> Method:
    if name.lower() not in METHODS:
        raise NotImplementedError(f"no method {name!r}; there are {sorted(METHODS)}")
    return METHODS[name.lower()](config)
