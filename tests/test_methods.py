"""Random field, similar pixels, sources, runs and their files."""

import itertools
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave import catalogue
from gapweave.functions.scalar import parse_report_name
from gapweave.operators import evaluate, field, masking, space
from gapweave.plans import run
from gapweave.plans.methods import KMeansStates, RandomField, get_method
from gapweave.sources import cubes
from gapweave.streaming import gaps


def _small(spark, n=8):
    return cubes.subrange(cubes.board(spark), 12, 12 + n, 12, 12 + n, 64, 64)


# -- random field -------------------------------------------------------------------------------------
def test_priors_of_a_cross_by_enumeration(spark):
    """Transition counts of cross3,tp:tp: along time over equal places, within dates from the smaller to the larger place."""
    v = run.Validation(_small(spark), 2, False, 0.2, "random", seed=1)
    m = RandomField("3t,cross3,tp:tp,0.1,map,3")
    m.rounds = 1
    seen = []
    m.hooks = {"progress": lambda step, value: seen.append((step, value))}
    cells = v.masked.where("fold <> 0")
    m.fit(cells)
    assert [s for s, _ in seen] == [0, 1, 2]
    slices = [r.nodes for r in m._slices(cells).collect()]
    k = len(m.table)
    for kind, links in (("time", [(t * 5 + s, (t + 1) * 5 + s) for t in range(3) for s in range(5)]), ("space", [(t * 5 + a, t * 5 + b) for t in range(4) for a, b in ((0, 2), (1, 2), (2, 3), (2, 4))])):
        want = np.ones((k, k))
        for nodes, (a, b) in itertools.product(slices, links):
            if nodes[a] >= 0 and nodes[b] >= 0:
                want[nodes[a], nodes[b]] += 1
        want = np.log(want / want.sum(axis=1, keepdims=True))
        found = m._prior("tp", m._slices(cells), k, field.date_links(4, 3) if kind == "time" else field.leaf_links(4, 3))
        assert np.allclose(found, want), kind
    assert field.leaf_links(4, 3).tolist() == field.edge_list(4, 3)[3:].tolist()


def test_name_can_be_parsed(spark):
    for config, want in (("0.01r,chain,noprior:noprior,0.1,map,8", (0.01, "noprior", "noprior", 0.1, "chain", "map", 2, 8)), ("10t,cross3,tp:es,0.5,sup,32", (10.0, "tp", "es", 0.5, "cross3", "sup", 2, 32))):
        name = RandomField(config).name() + "_spatial_clouds0_2"
        row = spark.createDataFrame([(name,), (name.lower(),), ("LIN_random0_2",)], "name string").select(*parse_report_name(F.col("name"))).collect()
        assert tuple(row[0]) == (*want, "spatial_clouds0_2") == tuple(row[1]) and all(x is None for x in row[2])


def test_draws_follow_the_vertex(spark):
    rng = np.random.default_rng(0)
    links, theta = field.edge_list(4), rng.normal(size=(3, 3, 3))
    rows = [(i, [int(x) for x in rng.integers(-1, 3, 4)]) for i in range(700)]
    cen = np.arange(3.0)[:, None]
    one = spark.createDataFrame(rows, "v long, nodes array<int>").coalesce(1)
    a = {(r.v, r.node): r.state for r in field.infer(one, links, theta, "gibbs", cen, 5).collect()}
    b = {(r.v, r.node): r.state for r in field.infer(one.repartition(7, "v"), links, theta, "GIBBS", cen, 5).collect()}
    c = {(r.v, r.node): r.state for r in field.infer(one, links, theta, "gibbs", cen, 6).collect()}
    assert a == b != c and all(a[v, i] == s for v, n in rows for i, s in enumerate(n) if s >= 0)


def test_pair_sums_without_rows():
    rng = np.random.default_rng(3)
    tree = field.Tree(field.edge_list(3, 3))
    theta, nodes = rng.normal(size=(len(tree.links), 2, 2)), rng.integers(-1, 2, (9, tree.n))
    each, total = tree.marginals(theta, nodes), tree.marginals(theta, nodes, "sum")
    assert np.allclose(each[2].sum(axis=0), total[2]) and tree.marginals(theta, nodes, None)[2] is None and np.allclose(each[1], total[1])


def test_optimiser_says_that_it_has_not_settled():
    links = field.edge_list(3)
    share = np.full((2, 2, 2), 0.25) + np.array([[0.2, -0.2], [-0.2, 0.2]])
    with pytest.warns(UserWarning, match="not settled"):
        field.maximise(links, share, np.zeros((2, 2, 2)), None, np.zeros(2), 1e-300, "r", most=20)
    flat, _ = field.maximise(links, share, np.zeros((2, 2, 2)), None, np.zeros(2), 400, "t", regulariser=lambda th: (50 * (th**2).sum(), 100 * th))
    free, _ = field.maximise(links, share, np.zeros((2, 2, 2)), None, np.zeros(2), 400, "t")
    assert np.abs(flat).max() < 0.1 * np.abs(free).max()


def test_field_is_kept_and_discretiser_exchanged(spark, tmp_path):
    class Halves(KMeansStates):
        def info(self, k):
            return "2Halves"

        def fit(self, rows, column, k):
            return spark.createDataFrame([(0, [0.0] * 3), (1, [255.0] * 3)], "state int, centroid array<double>")

    v = run.Validation(_small(spark), 2, False, 0.2, "random")
    m = RandomField("3t,chain,l2:l2,0.1,map,2")
    m.discretiser, m.rounds = Halves(), 1
    assert m.name().endswith("_em1_2Halves")
    m.fit(v.masked.where("fold <> 0"))
    m.save(spark, str(tmp_path / "m"))
    test = v.masked.where("fold = 0")
    back = RandomField.load(spark, str(tmp_path / "m"))
    key = lambda r: (r.t, r.v)
    assert sorted(m.predict(test).collect(), key=key) == sorted(back.predict(test).collect(), key=key)


# -- similar pixels -----------------------------------------------------------------------------------
def _scene(spark, gaps_at, n=9, dates=4):
    rng = np.random.default_rng(5)
    base = rng.integers(10, 90, (n, n, 2)).astype(float)
    rows = [(t, 3 * t, x, y, x * n + y, [float(b) for b in base[x, y] + 7 * t], (t, x, y) not in gaps_at) for t in range(dates) for x in range(n) for y in range(n)]
    return spark.createDataFrame(rows, "t int, day int, x int, y int, v long, bands array<double>, good boolean"), base


def test_input_image_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(t, int(d), v, bool(rng.random() < 0.4)) for v in range(60) for t, d in enumerate(np.cumsum(rng.integers(1, 4, 7)))]
    df = spark.createDataFrame(rows, "t int, day int, v long, good boolean")
    for order, sign in (("nearest", 1), ("farthest", -1)):
        want = {}
        for t, d, v, good in rows:
            pool = [(sign * abs(d - d2), t2) for t2, d2, v2, g in rows if v2 == v and g]
            if not good and pool:
                want[t, v] = min(pool)[1]
        assert {(r.t, r.v): r.t_in for r in space.input_image(df, order).collect()} == want


def test_image_classes(spark):
    df, _ = _scene(spark, {(1, 0, 0)})
    out = space.image_classes(df, 3).collect()
    by = {}
    for r in out:
        by.setdefault(r.t, []).append((np.array(r.bands) if r.good else np.zeros(2), r["class"]))
    for t, px in by.items():
        centres = {c: np.mean([z for z, k in px if k == c], axis=0) for _, c in px}
        assert len(centres) == 3
        for z, c in px:  # at rest: each pixel is nearest to the mean of its own class
            assert ((z - centres[c]) ** 2).sum() <= min(((z - m) ** 2).sum() for m in centres.values()) + 1e-9
    assert space.image_classes(df.limit(0), 3).count() == 0


def test_similar_fill_cases(spark):
    """A steady shift is met exactly; where no like pixels are, the value lies between its dates; no date, no value."""
    lone = {(t, 8, 8) for t in range(4)}
    gap = {(1, x, y) for x in range(3, 6) for y in range(3, 6)} | lone
    df, base = _scene(spark, gap)
    got = {(r.t, r.v): r.pred for r in space.similar_fill(df, 1, 4).collect()}
    assert set(got) == {(t, x * 9 + y) for t, x, y in gap - lone}
    for t, x, y in gap - lone:
        assert np.allclose(got[t, x * 9 + y], base[x, y] + 7 * t, atol=8)
    whole = {(2, x, y) for x in range(9) for y in range(9)}  # nothing is good in both images: between dates
    df, base = _scene(spark, whole)
    got = {(r.t, r.v): r.pred for r in space.similar_fill(df, 2, 4).collect()}
    assert len(got) == 81 and all(np.allclose(got[2, x * 9 + y], base[x, y] + 14) for _, x, y in whole)


def test_similar_fill_window_counts(spark):
    """The result is that of a walk that looks at the whole image for each gap cell."""
    rng = np.random.default_rng(8)
    gap = {(1, int(x), int(y)) for x, y in rng.integers(0, 12, (30, 2))} | {(0, 2, 2), (0, 7, 7)}
    df, _ = _scene(spark, gap, 12, 2)
    got = {(r.t, r.v): r.pred for r in space.similar_fill(df, 2, 3).collect()}
    rows = space.image_classes(df, 3).collect()
    img, ok, cls = np.zeros((2, 12, 12, 2)), np.zeros((2, 12, 12), bool), np.zeros((2, 12, 12), int)
    for r in rows:
        img[r.t, r.x, r.y], ok[r.t, r.x, r.y], cls[r.t, r.x, r.y] = r.bands, r.good, r["class"]
    for t, x, y in gap:
        u = 1 - t
        if not ok[u, x, y]:
            continue
        same, lo, hi = ok[0] & ok[1] & (cls[u] == cls[u, x, y]), 1, 3
        near = lambda h: [(a, b) for a in range(12) for b in range(12) if abs(a - x) <= h and abs(b - y) <= h and same[a, b]]
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if len(near(mid)) < 6 else (lo, mid)
        px = near(lo)
        if len(px) < 3:
            continue
        alike = np.array([math.sqrt(((img[u][p] - img[u, x, y]) ** 2).mean()) + 1e-4 for p in px])
        keep = np.argsort(alike, kind="stable")[:3] if len(px) >= 6 else np.arange(len(px))
        w = np.array([1 / (alike[i] * max(math.hypot(px[i][0] - x, px[i][1] - y), 1e-9)) for i in keep])
        w /= w.sum()
        then, now = np.array([img[t][px[i]] for i in keep]), np.array([img[u][px[i]] for i in keep])
        t1, t2 = alike[keep].mean(), (np.sqrt(((now - then) ** 2).mean(axis=1)) + 1e-4).mean()
        want = (t2 * (w @ then) + t1 * (img[u, x, y] + w @ (then - now))) / (t1 + t2)
        assert np.allclose(got[t, x * 12 + y], want), (t, x, y)


# -- gaps, reports, sources ---------------------------------------------------------------------------
def test_seed_moves_gaps_and_dates_bound_them(spark):
    cells = masking.assign_folds(cubes.board(spark), 4096, 2)
    for name in masking.HIDE:
        a, b, c = (set(map(tuple, masking.hide(cells, name, 0.05, seed=s).collect())) for s in (0, 0, 1))
        assert a == b and (a != c) == (name != "latest"), name
        one = masking.hide(cells, name, 0.05, dates=[1], seed=0).collect()
        assert {r.t for r in one} == {1}
    board2 = masking.assign_folds(cubes.board(spark, lost_date=1), 4096, 2)
    assert masking.hide(board2, "random", 0.2, dates=[1]).count() == 0


def test_totals_by_group_means(spark):
    rng = np.random.default_rng(2)
    rows = [(0, 0, i, [float(a), 5.0], [float(b), 5.0], True) for i, (a, b) in enumerate(rng.random((50, 2)))]
    df = spark.createDataFrame(rows, "fold int, t int, v long, bands array<double>, pred array<double>, hidden boolean")
    y, p = (np.array([r[i][0] for r in rows]) for i in (3, 4))
    got = {r.band: r.r2 for r in evaluate.band_r2(df, "fold").collect()}
    assert abs(got[0] - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9 and got[1] == 1.0
    assert evaluate.metrics(df, [["fold"]]).first().n_cells == 50


def test_cubes_by_name_and_checks(spark, tmp_path):
    (tmp_path / "mask.csv").write_text("5,9\n" + "\n".join(f"{i % 2},1" for i in range(6)))
    (tmp_path / "data.csv").write_text("h\n" + "\n".join(",".join(str(i * 10 + j) for j in range(4)) for i in range(6)))
    cube = cubes.get_cube(spark, f"csv:{tmp_path}:3,2,2,2", cache=str(tmp_path / "kept"))
    want = sorted(map(tuple, cube.collect()))
    (tmp_path / "data.csv").unlink()
    again = cubes.get_cube(spark, f"csv:{tmp_path}:3,2,2,2", cache=str(tmp_path / "kept"))
    assert sorted(map(tuple, again.collect())) == want and len(want) == 12
    assert cubes.get_cube(spark, "Board2").where("t = 1 AND observed").isEmpty()
    with pytest.raises(NotImplementedError, match="board"):
        cubes.get_cube(spark, "nothing")
    good = cubes.board(spark)
    for bad, say in ((good.drop("day"), "day"), (good.where("v <> 7 OR t <> 2"), "every vertex"), (good.withColumn("day", F.lit(1)), "days"), (good.withColumn("bands", F.when(F.col("v") == 3, F.array(F.lit(1.0))).otherwise(F.col("bands"))), "bands")):
        with pytest.raises(ValueError, match=say):
            cubes.check_cube(bad)


def test_command_line_leaves_reports_pictures_and_state(spark, tmp_path):
    out = str(tmp_path / "o")
    args = ["-d", "board", "-r", "8,24,8,24", "-H", "0.2", "-M", "random", "-o", out]
    first = run.main([*args, "-m", "NN", "--images"], spark)
    assert [c for c in first.columns] == ["version", "t", "day", *[x for x in evaluate.CV_FILE.replace(" long", "").replace(" double", "").split(", ")[2:]]]
    rows = {r.t: r for r in first.collect()}
    assert rows["1"].day == 1 and rows["all"].day is None and rows["all"].hid == rows["1"].hid == 50 and rows["all"].t_pred > 0
    # another seed, range and data are not taken: the first setup stands
    run.main(["-d", "lineitem", "-S", "9", "-H", "0.2", "-M", "random", "-o", out, "-m", "RandomField", "-c", "3t,chain,l2:l2,0.1,map,2", "-I", "1", "-C", "2"], spark)
    both = evaluate.comparison_report(evaluate.read_reports(spark, f"{out}/report")).collect()
    assert {r.version for r in both} == {"NN_random0_2", "MRF_S3_l2_l2_0_1_chain_map_em1_2Means_random0_2"} and len({(r.obs, r.miss, r.hid) for r in both}) == 1
    folds = evaluate.read_reports(spark, f"{out}/folds", evaluate.FOLD_FILE).where("t = 'all'").collect()
    assert {(r.version, r.fold) for r in folds} == {(b.version, f) for b in both for f in (0, 1)} and all(r.t_train > 0 for r in folds if r.version.startswith("MRF"))
    lines = (tmp_path / "o" / "comparison").glob("*.csv")
    assert re.match("version,obs,miss,hid,mae,mae_std,.*t_train,t_pred", next(lines).read_text())
    names = {str(p.relative_to(tmp_path / "o" / "imgs")) for p in (tmp_path / "o" / "imgs").rglob("*.png")}
    assert {"data/img_t000.png", "observed/img_t003.png", "pred_NN_random0_2/img_t001.png", "pred_hidden_NN_random0_2/img_t001.png", "pred_outline_NN_random0_2/img_t001.png", "original_outline/img_t001.png", "pred_error_NN_random0_2/img_t001.png", "cv_0_test/test_t000.png", "cv_1_test/random0_2_t001.png"} <= names
    assert cubes.images(spark, f"{out}/imgs/data").count() == 4
    assert json.loads(spark.read.parquet(f"{out}/config").first().config)["data"] == "board"
    assert run.main(["-d", "C", "-o", out], spark) is None and not (tmp_path / "o").exists()


def test_split_and_outline_pictures(spark):
    cells = masking.assign_folds(_small(spark), 64, 2)
    hidden = masking.hide_random(cells, 0.1)
    rows = space.split_images(cells, hidden).collect()
    assert len(rows) == 2 * 4 * 64 and sum(r.test == 255 for r in rows) == 4 * 64 and sum(r.hidden == 255 for r in rows) == hidden.count()
    pred = masking.masked_view(cells, hidden).withColumn("pred", F.array(*[F.lit(1.0)] * 3))
    grey = space.outline_colour(0, 255, 3, (0, 2))
    assert grey == [127.0, 0.0, 127.0] and space.outline_width(70) == 3 and space.outline_width(100) == 5
    at = {(r.t, r.x, r.y): r for r in space.outlined(pred, 1, grey).collect()}
    gone = {(r.t, r.x, r.y) for r in cells.join(hidden, ["fold", "t", "v"]).collect()}
    for (t, x, y), r in at.items():
        edge = (t, x, y) not in gone and any((t, x + a, y + b) in gone for a in (-1, 0, 1) for b in (-1, 0, 1))
        assert (r.pred_outline == grey == r.original_outline) if edge else (r.pred_outline == [1.0] * 3) == ((t, x, y) in gone)


# -- streams ------------------------------------------------------------------------------------------
def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "value").limit(500)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = gaps.windowed_means(stream).writeStream.format("memory").queryName("means").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    day = F.window(F.col("ts").cast("timestamp"), "1 day")["start"]
    want = spark.read.parquet(str(tmp_path / "in")).groupBy(day.alias("start"), "user_id").agg(F.round(F.avg("value"), 6).alias("v"))
    got = spark.table("means").select("start", "user_id", F.round("v", 6).alias("v"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("start", "user_id", "v").collect()))
    spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 3.0)], "user_id int, dno int, v double").write.parquet(str(tmp_path / "s"))
    seen = []
    series = spark.readStream.schema("user_id int, dno int, v double").parquet(str(tmp_path / "s"))
    q = gaps.fill_batches(series, lambda df, i: seen.extend(df.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.dno, r.filled) for r in seen) == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_queries_have_sql_where_sql_can(spark):
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == set(catalogue._ORACLE_ONLY_ROWS) | {"mrf_map", "mrf_sup", "mrf_gibbs"}
    assert get_method("nspi").name() == "NSPI"
