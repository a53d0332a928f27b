import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gapweave.operators import evaluate, field, masking, space, temporal
from gapweave.plans.methods import get_method
from gapweave.plans.run import Validation
from gapweave.sources import cubes


@pytest.mark.parametrize("text", ["0.1r,chain,noprior:noprior,0.1,map,8", "10t,cross3,es:l2,0.001,sup,4", "0.01r,cross5,tp:tp,0.1,gibbs,2"])
def test_field_config(text):
    field.FieldConfig.parse(text)


@pytest.mark.parametrize("text", [f"{s},chain,l2:l2,0.1,map,8" for s in ("foo", "r", "0.1t", "")] + [f"0.1r,{s},l2:l2,0.1,map,8" for s in ("foo", "cross", "chain3", "")] + [f"0.1r,chain,{p},0.1,map,8" for p in ("foo:l2", "l2", ":")] + [f"0.1r,chain,l2:l2,{x},map,8" for x in ("foo", "0a", "")] + ["0.1r,chain,l2:l2,0.1,mapsups,8", "a", "0.1r,chain,l2:l2,0.1,map,8,9"])
def test_bad_field_config(text):
    with pytest.raises(RuntimeError):
        field.FieldConfig.parse(text)


def _series(spark, *rows):
    return spark.createDataFrame([(u, i, v) for u, vs in enumerate(rows) for i, v in enumerate(vs)], "u int, d int, v double")


def test_linear_and_nearest(spark):
    s = _series(spark, [None, 1.0, None, 3.0, None], [None] * 5, [None, 2.0, None, None, None], [0.0, None, None, None, 8.0])
    lin = {(r.u, r.d): r.filled for r in temporal.fill_linear(s, ["u"], "d", "v").collect()}
    assert [lin[0, i] for i in range(5)] == [1, 1, 2, 3, 3] and [lin[1, i] for i in range(5)] == [0] * 5
    assert [lin[2, i] for i in range(5)] == [2] * 5 and [lin[3, i] for i in range(5)] == [0, 2, 4, 6, 8]
    near = {(r.u, r.d): r.filled for r in temporal.fill_nearest(s, ["u"], "d", "v").collect()}
    assert [near[0, i] for i in range(5)] == [1, 1, 1, 3, 3] and [near[3, i] for i in range(5)] == [0, 0, 0, 8, 8]


def test_harmonics(spark):
    curve = [3 + 2 * math.cos(2 * math.pi * i / 12) - math.sin(2 * math.pi * i / 12) for i in range(12)]
    s = _series(spark, [None if i % 4 == 1 else c for i, c in enumerate(curve)], [None] * 12, [5.0] + [None] * 11)
    for out in (temporal.fill_harmonic(s, ["u"], "d", "v", 12), temporal.fill_harmonics(s, ["u"], "d", "v", 12, 3)):
        got = {(r.u, r.d): r.filled for r in out.collect()}
        assert np.allclose([got[0, i] for i in range(12)], curve) and got[1, 3] == 0 and abs(got[2, 7] - 5) < 1e-9


def test_masks(spark):
    cells = masking.assign_folds(cubes.board(spark), 4096, 3)
    assert sorted(r.n for r in cells.groupBy("fold").agg(F.count_distinct("v").alias("n")).collect()) == [1365, 1365, 1366]
    for name, f in masking.HIDE.items():
        h = f(cells, 0.1).distinct()
        n = {r.fold: r.n for r in h.groupBy("fold").agg(F.count("*").alias("n")).collect()}
        for r in cells.groupBy("fold").agg(F.count("*").alias("n")).collect():
            assert n[r.fold] >= int(r.n * 0.1), name
        assert h.join(cells.where("observed"), ["fold", "t", "v"], "left_anti").isEmpty()
    assert masking.hide_random(cells, 0.1).count() == sum(int(r.n * 0.1) for r in cells.groupBy("fold").agg(F.count("*").alias("n")).collect())
    with pytest.raises(NotImplementedError):
        masking.hide(cells, "foo", 0.1)
    with pytest.raises(Exception, match="no room"):
        masking.hide_spatial_gaps(cells, 0.95, width=9).count()
    with pytest.raises(ValueError):
        masking.assign_folds(cells, 4096, 1)


def test_shapes_against_one_greedy_walk(spark):
    cells = masking.assign_folds(cubes.board(spark).withColumn("observed", (F.col("v") + F.col("t")) % 97 != 0), 4096, 2)
    order = F.pmod(F.xxhash64(F.lit(3), "fold", "t", "v"), F.lit(2147483647))
    rows = sorted(cells.select("fold", order, "t", "v", "x", "y", "observed").collect())
    stamp = [tuple(map(int, p)) for p in np.argwhere(masking.template(5, "cloud"))]
    want = set()
    for fold in (0, 1):
        free = {(r.t, r.x, r.y): r.v for r in rows if r.fold == fold and r.observed}
        target, hidden = int(len(free) * 0.2), 0
        for r in rows:
            spots = [(r.t, r.x + a, r.y + b) for a, b in stamp]
            if r.fold == fold and hidden < target and all(s in free for s in spots):
                want |= {(fold, r.t, free.pop(s)) for s in spots}
                hidden += len(spots)
    got = [tuple(r) for r in masking.hide_spatial_clouds(cells, 0.2, width=5, seed=3).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_ssim_and_report(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random((8, 9)), rng.random((8, 9))
    df = spark.createDataFrame([(0, x, y, [float(a[x, y])], [float(b[x, y])]) for x in range(8) for y in range(9)], "t int, x int, y int, a array<double>, b array<double>")
    assert abs(evaluate.ssim(df, "a", "a").first().ssim - 1) < 1e-12
    vals = []
    for x in range(2):
        for y in range(3):
            p, q = a[x : x + 7, y : y + 7], b[x : x + 7, y : y + 7]
            c = np.cov(p.ravel(), q.ravel())
            c1, c2 = 4e-4, 36e-4
            vals.append((2 * p.mean() * q.mean() + c1) * (2 * c[0, 1] + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (c[0, 0] + c[1, 1] + c2)))
    assert abs(evaluate.ssim(df, "a", "b").first().ssim - np.mean(vals)) < 1e-9


@pytest.mark.parametrize("width", [1, 3])
def test_tree_inference_against_enumeration(width):
    rng = np.random.default_rng(1)
    links, k = field.edge_list(2 if width == 3 else 3, width), 2
    n, theta = len(links) + 1, rng.normal(size=(len(links), k, k))
    tree = field.Tree(links)
    nodes = rng.integers(-1, k, (6, n))
    logz, uni, pairs = tree.marginals(theta, nodes)
    best = tree.best(theta, nodes)
    for i, row in enumerate(nodes):
        total, marg, pair, top = 0.0, np.zeros((n, k)), np.zeros((len(links), k, k)), (-1e18, None)
        for x in itertools.product(range(k), repeat=n):
            if any(o >= 0 and o != s for o, s in zip(row, x)):
                continue
            e = sum(theta[j, x[u], x[w]] for j, (u, w) in enumerate(links))
            top = max(top, (e, x))
            total += math.exp(e)
            for v, s in enumerate(x):
                marg[v, s] += math.exp(e)
            for j, (u, w) in enumerate(links):
                pair[j, x[u], x[w]] += math.exp(e)
        assert abs(logz[i] - math.log(total)) < 1e-9 and np.allclose(uni[i], marg / total) and np.allclose(pairs[i], pair / total)
        assert tuple(best[i]) == top[1]
        drawn = tree.draw(theta, row[None], field.gumbel([i], n, k))[0]
        assert all(o in (-1, s) for o, s in zip(row, drawn))


def test_training_meets_the_moments(spark):
    rng = np.random.default_rng(2)
    states = rng.integers(0, 2, (200, 3))
    states[:, 1] = np.where(rng.random(200) < 0.8, states[:, 0], states[:, 1])
    df = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(states)], "v long, nodes array<int>")
    links = field.edge_list(3)
    theta, paths = field.train(df, links, 2, rounds=1, stop=1e-9)
    want = field.expected_counts(df, links, theta) / 200
    model = field.Tree(links).marginals(theta, np.full((1, 3), -1))[2][0]
    assert np.abs(want - model).max() < 1e-3 and all(b <= a + 1e-9 for a, b in zip(paths[0], paths[0][1:]))


def test_outline_and_gather(spark):
    b = cubes.board(spark).where("t = 0 AND x < 10 AND y < 10")
    o = space.outline(b.withColumn("mark", (F.col("x") == 4) & (F.col("y") == 4)), 2)
    assert o.count() == 24
    g = space.gather(b, space.cross(3), ["bands"])
    assert g.count() == 500 and g.where("NOT observed").count() == 40


@pytest.mark.parametrize("name", ["NN", "LIN", "HANTS", "NSPI", "RandomField"])
def test_methods_end_to_end(spark, name):
    small = cubes.subrange(cubes.board(spark), 0, 16, 0, 16, 64, 64)
    config = "5t,chain,tp:l2,0.1,sup,3" if name == "RandomField" else "default"
    v = Validation(small, 2, False, 0.2, "spatial_gaps", width=3)
    m = get_method(name, config)
    out = v.run(m)
    assert out.count() == 16 * 16 * 4 and out.where("pred IS NULL").isEmpty()


def test_csv_cube(spark, tmp_path):
    (tmp_path / "mask.csv").write_text("5,9\n" + "\n".join(f"{i % 2},1" for i in range(6)))
    (tmp_path / "data.csv").write_text("h\n" + "\n".join(",".join(str(i * 10 + j) for j in range(4)) for i in range(6)))
    c = {(r.t, r.v): r for r in cubes.csv_cube(spark, str(tmp_path), 3, 2, 2, 2).collect()}
    assert len(c) == 12 and c[1, 3].bands == [31.0, 33.0] and c[0, 2].observed is False and c[0, 3].day == 5 and (c[0, 3].x, c[0, 3].y) == (1, 1)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", ["gapfill_linear", "hide_random", "hide_latest", "masked_view", "metrics_total", "outline_dilation", "edges_cross", "board", "edge_statistics"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    a, b = _rows(got.columns, got.collect()), _rows(names, want.fetchall())
    assert sorted(got.columns) == sorted(names) and len(a) == len(b)
    assert [tuple(map(str, r)) for r in a] == [tuple(map(str, r)) for r in b]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("how", ["map", "sup", "gibbs"])
def test_field_queries_predict_every_fold(spark, sf, how, monkeypatch):
    from gapweave import catalogue
    from gapweave.operators import field
    from gapweave.plans.methods import RandomField

    rounds, train = [], field.train
    monkeypatch.setattr(field, "train", lambda s, links, k, n, *a: rounds.append(n) or train(s, links, k, n, *a))
    got = catalogue.queries()[f"mrf_{how}"](spark, sf).select("t", "v").collect()
    want = catalogue._masked(spark, sf).select("t", "v").collect()
    assert sorted(got) == sorted(want) and rounds == [RandomField.rounds] * catalogue.K
