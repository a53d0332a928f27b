"""Registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalar import day_label, error_label, parse_report_name, portable_hash, project_value
from .operators import evaluate, field, masking, quantize, space, temporal
from .plans.methods import Lin, RandomField, get_method
from .plans.tables import stored
from .sources import cubes

W, H, K, AMOUNT = 50, 25, 2, 0.2


# -- inputs of several queries ----------------------------------------------------------------------
def _series(spark, d):
    return cubes.events_series(spark, d)


def _folds(spark, d):
    return masking.assign_folds(cubes.lineitem_cube(spark, d), W * H, K)


def _masked(spark, d):
    cells = _folds(spark, d)
    return masking.masked_view(cells, masking.hide_random(cells, AMOUNT))


def _pred(spark, d):
    m = stored(_masked(spark, d))
    return stored(m.join(Lin().predict(m), ["fold", "t", "v"]))


def _bands(df: DataFrame, column: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.round(F.col(column)[i], 6).alias(f"b{i}") for i in range(3)])


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def _centroids(spark, d, k=10, dims=64):
    """Mean of the vectors of each label, rounded so that any order of the sums gives the same table."""
    v = _vectors(spark, d).where(F.col("label") < k)
    means = v.groupBy(F.col("label").alias("state")).agg(*[F.round(F.avg(F.col("e")[i]), 6).alias(f"c{i}") for i in range(dims)])
    return means.select("state", F.array(*[f"c{i}" for i in range(dims)]).alias("centroid"))


def _states(spark, d):
    """A state of 0..3 for each seen cell of the masked cube, from its first band."""
    state = F.when(F.col("seen").isNotNull(), F.least(F.floor(F.col("seen")[0] / 13), F.lit(3))).cast("int")
    return _masked(spark, d).select("fold", "t", "x", "y", "v", state.alias("state"))


def _reports(spark, d):
    """Fold reports of three made-up versions: the scores of one prediction, scaled."""
    r = stored(_round(evaluate.fold_report(_pred(spark, d)), "mae", "rmse", "r2", "ssim", digits=4))
    names = ["LIN_random0_2", "MRF_S0_01_l2_l2_0_1_chain_map_em2_8Means_random0_2", "MRF_S0_01_l2_l2_0_5_chain_map_em2_8Means_random0_2"]
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("version"), F.lit(i + 1).alias("by")) for i, n in enumerate(names)]))
    return r.withColumn("_v", v).select("_v.version", "fold", "t", "obs", "miss", "hid", (F.col("mae") * F.col("_v.by")).alias("mae"), (F.col("rmse") * F.col("_v.by")).alias("rmse"), "r2", "ssim")


def _gaps(spark, d):
    return cubes.lineitem_cube(spark, d).withColumnRenamed("observed", "good")


# -- queries ----------------------------------------------------------------------------------------
def series_grid(spark, d):
    return _round(_series(spark, d), "v")


def mask_counts(spark, d):
    return _series(spark, d).groupBy("dno").agg(F.count("v").alias("obs"), F.count_if(F.col("v").isNull()).alias("miss"))


def cloud_cover(spark, d):
    return cubes.lineitem_cube(spark, d).groupBy("t").agg(F.round(1 - F.avg(F.col("observed").cast("int")), 6).alias("cover"))


def gapfill_linear(spark, d):
    return _round(temporal.fill_linear(_series(spark, d), ["user_id"], "dno", "v"), "v", "filled")


def gapfill_nearest(spark, d):
    return _round(temporal.fill_nearest(_series(spark, d), ["user_id"], "dno", "v"), "v", "filled")


def _monthly(spark, d):
    s = _series(spark, d)
    first = F.broadcast(s.agg(F.min("dno").alias("first")))
    return s.crossJoin(first).select("user_id", (F.col("dno") - F.col("first") + 1).alias("dno"), "v")


def gapfill_harmonic(spark, d):
    return _round(temporal.fill_harmonic(_monthly(spark, d), ["user_id"], "dno", "v", 31.0), "v", "filled", digits=4)


def gapfill_harmonic_n(spark, d):
    return temporal.fill_harmonics(_monthly(spark, d), ["user_id"], "dno", "v", 31.0, 3)


def fold_assignment(spark, d):
    return _folds(spark, d).select("t", "v", "fold")


def fold_sizes(spark, d):
    return _folds(spark, d).groupBy("fold").agg(F.count_distinct("v").alias("vertices"), F.count("*").alias("cells"))


def shuffled_folds(spark, d):
    return masking.assign_folds(cubes.lineitem_cube(spark, d), W * H, K, shuffle_seed=5).select("v", "fold").distinct()


def train_complement(spark, d):
    return _folds(spark, d).where("fold <> 0").select("t", "v")


def hide_latest(spark, d):
    return masking.hide_latest(_folds(spark, d), AMOUNT)


def hide_random(spark, d):
    return masking.hide_random(_folds(spark, d), AMOUNT)


def hide_random_spatials(spark, d):
    return masking.hide_random_spatials(_folds(spark, d), AMOUNT)


def hide_spatial_gaps(spark, d):
    return masking.hide_spatial_gaps(masking.assign_folds(cubes.board(spark), 4096, 2), 0.05, width=7)


def hide_spatial_clouds(spark, d):
    return masking.hide_spatial_clouds(masking.assign_folds(cubes.board(spark), 4096, 2), 0.05, width=9)


def masked_view(spark, d):
    return _bands(_masked(spark, d), "seen", "fold", "t", "v", "observed", "hidden")


def metrics_by_time(spark, d):
    return _round(evaluate.metrics(_pred(spark, d), [["fold", "t"]]), "mae", "rmse", digits=4)


def metrics_total(spark, d):
    return _round(evaluate.metrics(_pred(spark, d), [["fold"]]).drop("t"), "mae", "rmse", digits=4)


def metrics_grouping_sets(spark, d):
    return _round(evaluate.metrics(_pred(spark, d), [["fold", "t"], ["fold"], []]), "mae", "rmse", digits=4)


def r2_by_band(spark, d):
    return _round(evaluate.band_r2(_pred(spark, d), "fold"), "r2")


def ssim_by_time(spark, d):
    p = _pred(spark, d).select("t", "x", "y", "bands", F.when(F.col("hidden"), F.col("pred")).otherwise(F.col("bands")).alias("put"))
    return _round(evaluate.ssim(p, "bands", "put"), "ssim")


def fold_report(spark, d):
    return _round(evaluate.fold_report(_pred(spark, d)).drop("ssim"), "mae", "rmse", "r2", digits=4)


def cv_report(spark, d):
    scores = [x for c in ("mae", "rmse", "r2", "ssim") for x in (c, f"{c}_std")]
    return _round(evaluate.cv_report(_reports(spark, d)), *scores, digits=3)


def comparison_report(spark, d):
    return evaluate.comparison_report(cv_report(spark, d))


def cumulative_error(spark, d):
    return _round(evaluate.cumulative_error(cv_report(spark, d)), "error", digits=3)


def error_by_lambda(spark, d):
    return evaluate.error_by_lambda(comparison_report(spark, d))


def coverage_unpivot(spark, d):
    return evaluate.coverage(cv_report(spark, d).select("version", "t", "obs", "miss", "hid"))


def subrange(spark, d):
    return _bands(cubes.subrange(cubes.lineitem_cube(spark, d), 10, 30, 5, 25, W, H), "bands", "t", "x", "y", "v", "observed")


def date_check(spark, d):
    return cubes.check_dates(cubes.lineitem_cube(spark, d))


def neighbour_cross3(spark, d):
    g = space.gather(cubes.lineitem_cube(spark, d), space.cross(3), ["bands"])
    return g.select("t", "v", "s", "observed", F.round(F.col("bands")[0], 6).alias("b0"))


def outline_dilation(spark, d):
    return space.outline(cubes.lineitem_cube(spark, d).withColumn("mark", ~F.col("observed")), 2)


def error_image(spark, d):
    # rounded by plain arithmetic, which any engine repeats to the last bit
    return space.products(_pred(spark, d)).select("t", "v", (F.floor(F.col("error") * 100 + 0.5) / 100).alias("error"))


def outline_products(spark, d):
    out = space.outlined(_pred(spark, d), 1, space.outline_colour(0, 3000, 3, (0, 2)))
    return out.select("t", "v", *[F.round(F.col(c)[i], 6).alias(f"{c}_{i}") for c in ("pred_outline", "original_outline") for i in range(3)])


def split_images(spark, d):
    cells = stored(_folds(spark, d))
    return space.split_images(cells, masking.hide_random(cells, AMOUNT)).select("fold", "t", "x", "y", "test", "hidden")


def hide_one_date(spark, d):
    """Gaps on a single date: other dates count as unobserved."""
    return masking.hide(_folds(spark, d), "random", AMOUNT, dates=[1], seed=3)


def fill_only_gaps(spark, d):
    return _bands(space.products(_pred(spark, d)), "pred_gaps", "t", "v")


def prediction_store(spark, d):
    return _bands(space.products(_pred(spark, d)), "pred_hidden", "t", "v")


def render_bw(spark, d):
    img = cubes.lineitem_cube(spark, d).withColumn("q", F.round(F.col("bands")[0], 2))
    return space.render_bw(img, "q").select("t", "v", "grey")


def render_rgb(spark, d):
    r = space.render_rgb(cubes.lineitem_cube(spark, d), (0, 1, 2), 0.0, 60.0)
    return r.select("t", "v", *[F.col("rgb")[i].alias(c) for i, c in enumerate("rgb")])


def render_png(spark, d):
    return space.encode_png(space.render_bw(cubes.board(spark).withColumn("q", F.col("bands")[0]), "q"), "grey").select("t", F.length("png").cast("long").alias("size"))


def downsample_series(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", "event_id", "value")
    return evaluate.downsample(e, "event_type", "event_id", 200)


def nearest_centroid(spark, d):
    return _round(quantize.label(_vectors(spark, d), "e", _centroids(spark, d)).select("vec_id", "state", "d2"), "d2")


def centroid_lookup(spark, d):
    return quantize.restore(_vectors(spark, d).select("vec_id", F.col("label").alias("state")), _centroids(spark, d)).select("vec_id", "state", F.col("centroid")[0].alias("c0"), F.col("centroid")[63].alias("c63"))


def quantisation_rmse(spark, d):
    return _round(quantize.quantisation_rmse(_vectors(spark, d), "e", _centroids(spark, d)), "rmse")


def quantisation_sweep(spark, d):
    v = stored(_vectors(spark, d))
    out = None
    for k in (2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48):
        one = quantize.quantisation_rmse(v, "e", quantize.fit_centroids(v, "e", k)).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def kmeans_fit(spark, d):
    return quantize.fit_centroids(_vectors(spark, d), "e", 8).select("state", F.size("centroid").alias("dims"))


def state_similarity(spark, d):
    return _round(quantize.similarity(_centroids(spark, d)), "logsim", digits=4)


def transition_prior_temporal(spark, d):
    s = _states(spark, d)
    return _round(field.transitions(s, field.temporal_pairs(s), 4), "logp")


def transition_prior_spatial(spark, d):
    s = _states(spark, d)
    return _round(field.transitions(s, field.spatial_pairs(s), 4), "logp")


def edges_chain(spark, d):
    return field.edges(spark, 7)


def edges_cross(spark, d):
    return field.edges(spark, 7, 3)


def _nodes(spark, d):
    return _states(spark, d).select("v", F.col("t").alias("node"), "state")


def adaptive_lambda(spark, d):
    return _round(field.adaptive_lambda(_nodes(spark, d), field.edges(spark, 7), 0.1), "lam")


def edge_statistics(spark, d):
    return field.edge_statistics(_nodes(spark, d), field.edges(spark, 7))


def _field(how):
    def query(spark, d):
        from .plans.run import Validation

        v = Validation(cubes.lineitem_cube(spark, d), K, False, AMOUNT, "random")
        pred = v.run(get_method("RandomField", f"20t,chain,tp:tp,0.1,{how},4"))
        return _bands(pred, "pred", "t", "v")

    query.__name__ = f"mrf_{how}"
    return query


def mrf_train(spark, d):
    slices = field.node_states(_nodes(spark, d))
    theta, paths = field.train(slices, field.edge_list(7), 4, rounds=2, stop=10, kind="t")
    return spark.createDataFrame([(i, j, float(x)) for i, p in enumerate(paths) for j, x in enumerate(p)], "round int, step int, objective double")


def nspi_input(spark, d):
    return space.input_image(_gaps(spark, d))


def nspi_similar_topk(spark, d):
    g = _gaps(spark, d)
    return _bands(space.similar_pixels(g, space.input_image(g), 3, 10), "pred", "t", "v", "n")


def nspi_fill(spark, d):
    return _bands(space.similar_fill(_gaps(spark, d)), "pred", "t", "v")


def cross_validation(spark, d):
    from .plans.run import Validation

    v = Validation(cubes.lineitem_cube(spark, d), K, False, AMOUNT, "random")
    pred = v.run(get_method("NN"))
    return _round(evaluate.cv_report(v.report(pred, "NN")), "mae", "rmse", "r2", digits=3).select("version", "t", "obs", "miss", "hid", "mae", "rmse", "r2")


def slice_priors(spark, d):
    """Transition counts over the slices of a cross: along time (kind 0) and within dates (kind 1)."""
    cells = stored(_states(spark, d))
    near = space.gather(cells.withColumn("observed", F.col("state").isNotNull()), space.cross(3), ["state"])
    slices = stored(field.node_states(near.select("v", (F.col("t") * 5 + F.col("s")).cast("int").alias("node"), "state")))
    parts = [field.transitions(slices, field.slice_pairs(slices, links(7, 3)), 4).withColumn("kind", F.lit(i)) for i, links in enumerate((field.date_links, field.leaf_links))]
    return _round(parts[0].unionByName(parts[1]), "logp")


def image_classes(spark, d):
    """Pixels of each date, and how many of the five k-means classes they use."""
    out = space.image_classes(_gaps(spark, d), 5)
    return out.groupBy("t").agg(F.count("*").alias("n"), F.count_distinct("class").alias("classes"))


def board(spark, d):
    return cubes.board(spark, lost_date=1).select("t", "x", "y", "observed", *[F.col("bands")[i].alias(f"b{i}") for i in range(3)])


def report_name_parse(spark, d):
    made = RandomField("0.01r,cross3,l2:tp,0.1,map,32")
    names = [f"{made.name()}_spatial_clouds0_2", "MRF_S10_es_tp_0_5_cross3_sup_em2_8Means_random0_5", "mrf_s0_01_tp_tp_0_1_cross3_sup_em5_32means_spatial_clouds0_2", "LIN_random0_2"]
    rows = spark.range(4).select(F.get(F.array(*map(F.lit, names)), F.col("id").cast("int")).alias("name"))
    return rows.select("name", *parse_report_name(F.col("name")))


def day_labels(spark, d):
    return spark.range(1, 366, 13).select(F.col("id").alias("dno"), day_label(F.col("id"), 2018).alias("label"), error_label((F.col("id") % 2) * 1.25).alias("error"), project_value(F.col("id").cast("double"), 1.0, 365.0, 0.0, 255.0).alias("scaled"))


def order_hash(spark, d):
    return _folds(spark, d).select("t", "v", portable_hash(F.col("v"), F.col("t")).alias("h"))


#: SQL can express none of these: least squares, greedy walks, k-means, optimisation, adaptive windows, pictures.
_ORACLE_ONLY_ROWS = ("gapfill_harmonic_n", "hide_spatial_gaps", "hide_spatial_clouds", "quantisation_sweep", "kmeans_fit", "image_classes", "mrf_train", "nspi_fill", "render_png")


def queries():
    from . import oracles

    named = [globals()[n] for n in [*oracles.SQL, *_ORACLE_ONLY_ROWS]]
    return {f.__name__: f for f in named + [_field(h) for h in field.PREDICT]}


def oracle_sql():
    from . import oracles

    return dict(oracles.SQL)
