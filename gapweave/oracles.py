"""DuckDB SQL for the queries of the catalogue."""

from __future__ import annotations


def _mean(c: str) -> str:
    return f"CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / (count({c}) * CAST(100 AS DOUBLE))"


SERIES = f"""
obs AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS dno, {_mean('value')} AS v FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2),
series AS (SELECT u.user_id, n.dno, o.v FROM (SELECT DISTINCT user_id FROM obs) u CROSS JOIN (SELECT DISTINCT dno FROM obs) n LEFT JOIN obs o ON o.user_id = u.user_id AND o.dno = n.dno)"""

CUBE = f"""
sold AS (SELECT year(l_shipdate) AS yr, p_size - 1 AS x, CAST(substr(p_brand, 7) AS INTEGER) - 1 AS y, {_mean('l_quantity')} AS b0, {_mean('l_discount')} AS b1, {_mean('l_extendedprice')} AS b2
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
years AS (SELECT yr, CAST(row_number() OVER (ORDER BY yr) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT yr FROM sold)),
cube AS (SELECT t, t + 1 AS dd, CAST(gx.x AS INTEGER) AS x, CAST(gy.y AS INTEGER) AS y, CAST(gx.x * 25 + gy.y AS BIGINT) AS v, coalesce(b0, 0) AS b0, coalesce(b1, 0) AS b1, coalesce(b2, 0) AS b2, b0 IS NOT NULL AS observed
  FROM years CROSS JOIN (SELECT unnest(range(50)) AS x) gx CROSS JOIN (SELECT unnest(range(25)) AS y) gy LEFT JOIN sold s ON s.yr = years.yr AND s.x = gx.x AND s.y = gy.y),
folds AS (SELECT *, CAST(((v + 1) * 2 - 1) // 1250 AS INTEGER) AS fold FROM cube)"""



def _hash(of: str, seed: int = 0) -> str:
    return f"((({of}) % 1000003) * {48271 + 194 * seed} + {(12345 + 1566083941 * seed) % 2147483647}) % 2147483647"


TARGETS = "targets AS (SELECT fold, CAST(floor(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS target FROM folds WHERE observed GROUP BY fold)"
HID = f"""{TARGETS},
hid AS (SELECT fold, t, v FROM (SELECT f.fold, t, v, target, row_number() OVER (PARTITION BY f.fold ORDER BY {_hash('v * 7919 + t * 104729')}, v, t) AS r FROM folds f JOIN targets g ON f.fold = g.fold WHERE observed) WHERE r <= target)"""
MASKED = f"""{CUBE}, {HID},
masked AS (SELECT f.*, h.v IS NOT NULL AS hidden, observed AND h.v IS NULL AS seen FROM folds f LEFT JOIN hid h ON f.fold = h.fold AND f.t = h.t AND f.v = h.v)"""


def _linear(source: str, key: str, time: str, value: str, keep: str) -> str:
    """Piecewise linear filling of ``value``."""
    back = f"OVER (PARTITION BY {key} ORDER BY {time} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"OVER (PARTITION BY {key} ORDER BY {time} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    have = f"CASE WHEN {value} IS NOT NULL THEN {time} END"
    return f"""(SELECT {keep}, {value}, {time}, dp, dn, vp, vn, coalesce({value}, vp + (vn - vp) * ({time} - dp) / nullif(dn - dp, 0), vp, vn, 0) AS filled FROM (
  SELECT *, last_value({have} IGNORE NULLS) {back} AS dp, last_value({value} IGNORE NULLS) {back} AS vp, first_value({have} IGNORE NULLS) {ahead} AS dn, first_value({value} IGNORE NULLS) {ahead} AS vn FROM {source}))"""


LONG = """
long AS (SELECT fold, t, dd, v, x, y, observed, hidden, 0 AS band, b0 AS val, CASE WHEN seen THEN b0 END AS sv FROM masked
  UNION ALL SELECT fold, t, dd, v, x, y, observed, hidden, 1, b1, CASE WHEN seen THEN b1 END FROM masked
  UNION ALL SELECT fold, t, dd, v, x, y, observed, hidden, 2, b2, CASE WHEN seen THEN b2 END FROM masked)"""


def _nearest(source: str, key: str, time: str, value: str, keep: str) -> str:
    """Filling of ``value`` with the nearest one in time, the earlier one on ties."""
    later = f"dp IS NULL OR (dn IS NOT NULL AND {time} - dp > dn - {time})"
    return f"(SELECT {keep}, {value}, coalesce({value}, CASE WHEN {later} THEN vn ELSE vp END, 0) AS filled FROM {_linear(source, key, time, value, keep)})"


def _pred(filled: str) -> str:
    return f"""{MASKED}, {LONG},
pred AS {filled}"""


PRED = _pred(_linear("long", "fold, v, band", "dd", "sv", "fold, t, v, x, y, observed, hidden, band, val"))
_E = "e AS (SELECT fold, t, v, band, val AS y, filled AS p FROM pred WHERE hidden)"
ERR = f"{PRED}, {_E}"
_MAE = "round(avg(abs(p - y)), {0})"
_RMSE = "round(sqrt(avg((p - y) * (p - y))), {0})"


def _wide(value: str, source: str, keep: str, digits: int = 6) -> str:
    return f"SELECT {keep}, " + ", ".join(f"round(max(CASE WHEN band = {b} THEN {value} END), {digits}) AS b{b}" for b in range(3)) + f" FROM {source} GROUP BY {keep}"


def _r2(keys: str) -> str:
    return f"""(SELECT {keys}, band, count(*) AS n, CASE WHEN count(*) < 2 THEN NULL WHEN sum((y - m) * (y - m)) = 0 THEN CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1 ELSE 0 END ELSE 1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) END AS r2
  FROM (SELECT *, avg(y) OVER (PARTITION BY {keys}, band) AS m FROM e) GROUP BY {keys}, band)"""


def _ssim(source: str, keys: str) -> str:
    n = "CAST(49 AS DOUBLE)"
    moments = ["a", "b", "aa", "bb", "ab"]
    y = f"OVER (PARTITION BY {keys}, band, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    x = f"OVER (PARTITION BY {keys}, band, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    c1, c2 = "CAST(0.0004 AS DOUBLE)", "CAST(0.0036 AS DOUBLE)"
    return f"""(SELECT {keys}, avg(((2 * ma * mb + {c1}) * (2 * vab + {c2})) / ((ma * ma + mb * mb + {c1}) * (va + vb + {c2}))) AS ssim FROM (
  SELECT {keys}, a / {n} AS ma, b / {n} AS mb, {n} / 48 * (aa / {n} - a / {n} * (a / {n})) AS va, {n} / 48 * (bb / {n} - b / {n} * (b / {n})) AS vb, {n} / 48 * (ab / {n} - a / {n} * (b / {n})) AS vab FROM (
    SELECT {keys}, band, x, y, ny, count(*) {x} AS nx, {', '.join(f'sum({m}) {x} AS {m}' for m in moments)} FROM (
      SELECT {keys}, band, x, y, count(*) {y} AS ny, {', '.join(f'sum({m}) {y} AS {m}' for m in moments)} FROM (
        SELECT {keys}, band, x, y, a, b, a * a AS aa, b * b AS bb, a * b AS ab FROM {source})))
  WHERE nx = 7 AND ny = 7) GROUP BY {keys})"""


def _report(filled: str) -> str:
    return f"""{_pred(filled)}, {_E}, {_REST}"""


_REST = f"""box AS (SELECT fold, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM folds GROUP BY fold),
dense AS (SELECT b.fold, tt.t, bb.band, gx.x, gy.y, coalesce(p.val, 0) AS a, coalesce(CASE WHEN p.hidden THEN p.filled ELSE p.val END, 0) AS b FROM box b CROSS JOIN (SELECT DISTINCT t FROM cube) tt CROSS JOIN (SELECT unnest(range(3)) AS band) bb
  JOIN (SELECT unnest(range(50)) AS x) gx ON gx.x BETWEEN b.x0 AND b.x1 JOIN (SELECT unnest(range(25)) AS y) gy ON gy.y BETWEEN b.y0 AND b.y1
  LEFT JOIN pred p ON p.fold = b.fold AND p.t = tt.t AND p.band = bb.band AND p.x = gx.x AND p.y = gy.y),
sim AS {_ssim('dense', 'fold, t')},
cnt AS (SELECT fold, t, count(*) FILTER (observed AND NOT hidden) AS obs, count(*) FILTER (NOT observed) AS miss, count(*) FILTER (hidden) AS hid, count(*) AS size FROM masked GROUP BY fold, t),
sc AS (SELECT fold, t, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse FROM e GROUP BY fold, t),
sa AS (SELECT fold, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse FROM e GROUP BY fold),
rt AS (SELECT fold, t, avg(r2) AS r2 FROM {_r2('fold, t')} GROUP BY fold, t),
ra AS (SELECT fold, avg(r2) AS r2 FROM {_r2('fold')} GROUP BY fold),
byt AS (SELECT c.fold, c.t, obs, miss, hid, size, mae, rmse, r2, ssim FROM cnt c LEFT JOIN sc ON sc.fold = c.fold AND sc.t = c.t LEFT JOIN rt ON rt.fold = c.fold AND rt.t = c.t LEFT JOIN sim ON sim.fold = c.fold AND sim.t = c.t),
report AS (
  SELECT fold, CAST(t AS VARCHAR) AS t, obs, miss, hid, CASE WHEN hid > 0 THEN mae ELSE 0 END AS mae, CASE WHEN hid > 0 THEN rmse ELSE 0 END AS rmse, CASE WHEN hid > 0 THEN r2 ELSE 0 END AS r2, CASE WHEN hid > 0 THEN ssim ELSE 0 END AS ssim FROM byt
  UNION ALL
  SELECT x.fold, 'all', size - hid - miss, miss, hid, coalesce(mae, 0), coalesce(rmse, 0), coalesce(r2, 0), coalesce(ssim, 0) FROM (
    SELECT fold, CAST(sum(size) AS BIGINT) AS size, CAST(sum(CASE WHEN hid > 0 THEN miss ELSE 0 END) AS BIGINT) AS miss, CAST(sum(hid) AS BIGINT) AS hid, avg(CASE WHEN hid > 0 THEN ssim END) AS ssim FROM byt GROUP BY fold) x
  LEFT JOIN sa ON sa.fold = x.fold LEFT JOIN ra ON ra.fold = x.fold)"""
REPORT = f"{ERR}, {_REST}"
_VERSIONS = "(VALUES ('LIN_random0_2', 1), ('MRF_S0_01_l2_l2_0_1_chain_map_em2_8Means_random0_2', 2), ('MRF_S0_01_l2_l2_0_5_chain_map_em2_8Means_random0_2', 3)) AS n(version, times)"
_SCORES = ("mae", "rmse", "r2", "ssim")


def _weighted(c: str) -> str:
    return f"coalesce(sum(CAST(hid AS DOUBLE) * {c}) / nullif(sum(CAST(hid AS DOUBLE)), 0), CASE WHEN t = 'all' THEN avg({c}) ELSE 0 END)"


CV = f"""{REPORT},
reports AS (SELECT version, fold, t, obs, miss, hid, round(mae, 4) * times AS mae, round(rmse, 4) * times AS rmse, round(r2, 4) AS r2, round(ssim, 4) AS ssim FROM report CROSS JOIN {_VERSIONS}),
means AS (SELECT version, t, CAST(sum(obs) AS BIGINT) AS obs, CAST(sum(miss) AS BIGINT) AS miss, CAST(sum(hid) AS BIGINT) AS hid, {', '.join(f'{_weighted(c)} AS {c}' for c in _SCORES)} FROM reports GROUP BY version, t),
spread AS (SELECT r.version, r.t, {', '.join(f'sqrt(coalesce(sum(CAST(r.hid AS DOUBLE) * (r.{c} - m.{c}) * (r.{c} - m.{c})) / nullif(sum(CAST(r.hid AS DOUBLE)), 0), 0)) AS {c}_std' for c in _SCORES)} FROM reports r JOIN means m ON r.version = m.version AND r.t = m.t GROUP BY r.version, r.t),
cv AS (SELECT m.version, m.t, obs, miss, hid, {', '.join(f'round({c}, 3) AS {c}, round({c}_std, 3) AS {c}_std' for c in _SCORES)} FROM means m JOIN spread s ON m.version = s.version AND m.t = s.t)"""

VECTORS = """
vec AS (SELECT vec_id, label, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS e FROM embeddings),
comp AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(e) AS z FROM vec),
cen AS (SELECT label AS state, i, round(avg(z), 6) AS c FROM comp WHERE label < 10 GROUP BY label, i)"""
NEAREST = f"""{VECTORS},
dist AS (SELECT vec_id, state, sum((z - c) * (z - c)) AS d2 FROM comp JOIN cen USING (i) GROUP BY vec_id, state),
near AS (SELECT vec_id, state, d2 FROM dist QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, state) = 1)"""
STATES = f"{MASKED}, st AS (SELECT fold, t, x, y, v, CASE WHEN seen THEN CAST(least(floor(b0 / 13), 3) AS INTEGER) END AS state FROM masked)"


def _transitions(pairs: str) -> str:
    return f"""SELECT s0, s1, n, round(ln(n / sum(n) OVER (PARTITION BY s0)), 6) AS logp FROM (
  SELECT a.s AS s0, b.s AS s1, CAST(count(p.s0) + 1 AS BIGINT) AS n FROM (SELECT CAST(unnest(range(4)) AS INTEGER) AS s) a CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS s) b
  LEFT JOIN ({pairs}) p ON p.s0 = a.s AND p.s1 = b.s GROUP BY a.s, b.s)"""


_RUN = "coalesce(sum(n) OVER (PARTITION BY fold ORDER BY {0} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_INPUT = """inp AS (SELECT g.t, g.v, c.t AS t_in FROM cube g JOIN cube c ON c.v = g.v AND c.observed WHERE NOT g.observed QUALIFY row_number() OVER (PARTITION BY g.t, g.v ORDER BY abs(g.dd - c.dd), c.t) = 1)"""
_GREY = "coalesce(CAST(floor((q - lo) / nullif(hi - lo, 0) * 255) AS INTEGER), 0)"
_LEVEL = "CAST(floor(greatest(least({0}, 60), 0) / CAST(60 AS DOUBLE) * 255) AS INTEGER)"
_D7 = "SELECT unnest(range(-3, 4))"

SQL = {
    "gapfill_linear": f"WITH {SERIES} SELECT user_id, dno, round(v, 6) AS v, round(filled, 6) AS filled FROM {_linear('series', 'user_id', 'dno', 'v', 'user_id')}",
    "gapfill_nearest": f"WITH {SERIES} SELECT user_id, dno, round(v, 6) AS v, round(coalesce(v, CASE WHEN dp IS NULL OR (dn IS NOT NULL AND dno - dp > dn - dno) THEN vn ELSE vp END, 0), 6) AS filled FROM {_linear('series', 'user_id', 'dno', 'v', 'user_id')}",
    "gapfill_harmonic": f"""WITH {SERIES}, m AS (SELECT user_id, dno - (SELECT min(dno) FROM series) + 1 AS dno, v FROM series),
a AS (SELECT *, cos(CAST(dno AS DOUBLE) / CAST(31 AS DOUBLE) * 2 * pi()) AS c, sin(CAST(dno AS DOUBLE) / CAST(31 AS DOUBLE) * 2 * pi()) AS s FROM m),
k AS (SELECT user_id, count(v) AS n, avg(v) AS mean, sum(c) FILTER (v IS NOT NULL) AS sc, sum(s) FILTER (v IS NOT NULL) AS ss, sum(c * c) FILTER (v IS NOT NULL) AS cc, sum(s * s) FILTER (v IS NOT NULL) AS dd, sum(c * s) FILTER (v IS NOT NULL) AS cd, sum(v) AS sv, sum(v * c) AS vc, sum(v * s) AS vd FROM a GROUP BY user_id),
f AS (SELECT *, n * (cc * dd - cd * cd) - sc * (sc * dd - cd * ss) + ss * (sc * cd - cc * ss) AS det FROM k),
g AS (SELECT *, (sv * (cc * dd - cd * cd) - sc * (vc * dd - cd * vd) + ss * (vc * cd - cc * vd)) / det AS k0, (n * (vc * dd - cd * vd) - sv * (sc * dd - cd * ss) + ss * (sc * vd - vc * ss)) / det AS k1, (n * (cc * vd - vc * cd) - sc * (sc * vd - vc * ss) + sv * (sc * cd - cc * ss)) / det AS k2 FROM f)
SELECT a.user_id, a.dno, round(a.v, 4) AS v, round(coalesce(a.v, CASE WHEN n < 3 THEN coalesce(mean, 0) ELSE k0 + k1 * c + k2 * s END), 4) AS filled FROM a JOIN g ON a.user_id = g.user_id""",
    "series_grid": f"WITH {SERIES} SELECT user_id, dno, round(v, 6) AS v FROM series",
    "mask_counts": f"WITH {SERIES} SELECT dno, count(v) AS obs, count(*) FILTER (v IS NULL) AS miss FROM series GROUP BY dno",
    "cloud_cover": f"WITH {CUBE} SELECT t, round(1 - avg(CAST(observed AS INTEGER)), 6) AS cover FROM cube GROUP BY t",
    "fold_assignment": f"WITH {CUBE} SELECT t, v, fold FROM folds",
    "fold_sizes": f"WITH {CUBE} SELECT fold, count(DISTINCT v) AS vertices, count(*) AS cells FROM folds GROUP BY fold",
    "train_complement": f"WITH {CUBE} SELECT t, v FROM folds WHERE fold <> 0",
    "order_hash": f"WITH {CUBE} SELECT t, v, {_hash('v * 7919 + t * 104729')} AS h FROM folds",
    "hide_latest": f"WITH {CUBE}, {TARGETS}, n AS (SELECT fold, t, {_RUN.format('t DESC')} AS b FROM (SELECT fold, t, count(*) AS n FROM folds WHERE observed GROUP BY fold, t)) SELECT f.fold, f.t, f.v FROM folds f JOIN n ON n.fold = f.fold AND n.t = f.t JOIN targets g ON g.fold = f.fold WHERE observed AND b < target",
    "hide_random": f"WITH {CUBE}, {HID} SELECT fold, t, v FROM hid",
    "hide_random_spatials": f"WITH {CUBE}, {TARGETS}, n AS (SELECT fold, v, {_RUN.format(_hash('v * 7919') + ', v')} AS b FROM (SELECT fold, v, count(*) AS n FROM folds WHERE observed GROUP BY fold, v)) SELECT f.fold, f.t, f.v FROM folds f JOIN n ON n.fold = f.fold AND n.v = f.v JOIN targets g ON g.fold = f.fold WHERE observed AND b < target",
    "masked_view": f"WITH {MASKED} SELECT fold, t, v, observed, hidden, " + ", ".join(f"CASE WHEN seen THEN round(b{i}, 6) END AS b{i}" for i in range(3)) + " FROM masked",
    "metrics_by_time": f"WITH {ERR} SELECT fold, t, count(DISTINCT v) AS n_cells, {_MAE.format(4)} AS mae, {_RMSE.format(4)} AS rmse FROM e GROUP BY fold, t",
    "metrics_total": f"WITH {ERR} SELECT fold, count(DISTINCT t * 10000 + v) AS n_cells, {_MAE.format(4)} AS mae, {_RMSE.format(4)} AS rmse FROM e GROUP BY fold",
    "metrics_grouping_sets": f"WITH {ERR} SELECT fold, t, count(DISTINCT t1 * 10000 + v) AS n_cells, {_MAE.format(4)} AS mae, {_RMSE.format(4)} AS rmse FROM (SELECT *, t AS t1 FROM e) GROUP BY GROUPING SETS ((fold, t), (fold), ())",
    "r2_by_band": f"WITH {ERR} SELECT fold, CAST(band AS INTEGER) AS band, n, round(r2, 6) AS r2 FROM {_r2('fold')}",
    "ssim_by_time": f"WITH {PRED} SELECT t, round(ssim, 6) AS ssim FROM {_ssim('(SELECT t, band, x, y, val AS a, CASE WHEN hidden THEN filled ELSE val END AS b FROM pred)', 't')}",
    "fold_report": f"WITH {REPORT} SELECT fold, t, obs, miss, hid, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 4) AS r2 FROM report",
    "cv_report": f"WITH {CV} SELECT * FROM cv",
    "comparison_report": f"WITH {CV} SELECT * EXCLUDE (t) FROM cv WHERE t = 'all'",
    "cumulative_error": f"WITH {CV} SELECT version, CAST(t AS INTEGER) AS t, round(sum(mae) OVER (PARTITION BY version ORDER BY CAST(t AS INTEGER)) / sum(mae) OVER (PARTITION BY version) * total, 3) AS error FROM cv JOIN (SELECT version, mae AS total FROM cv WHERE t = 'all') USING (version) WHERE t <> 'all' AND mae <> 0",
    "error_by_lambda": f"WITH {CV} SELECT '0.01,chain,l2,l2,map,2,8,random0_2' AS series, CASE WHEN version LIKE '%l2\\_0\\_1%' ESCAPE '\\' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS lam, mae AS error FROM cv WHERE t = 'all' AND version LIKE 'MRF%' UNION ALL SELECT version, CAST(unnest([0.1, 0.5]) AS DOUBLE), mae FROM cv WHERE t = 'all' AND version LIKE 'LIN%'",
    "coverage_unpivot": f"WITH {CV} SELECT version, t, kind, n FROM (SELECT version, t, obs, miss, hid FROM cv WHERE t <> 'all') UNPIVOT (n FOR kind IN (obs, miss, hid))",
    "subrange": f"WITH {CUBE} SELECT t, x - 10 AS x, y - 5 AS y, CAST((x - 10) * 20 + y - 5 AS BIGINT) AS v, observed, round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM cube WHERE x >= 10 AND x < 30 AND y >= 5 AND y < 25",
    "date_check": "SELECT true AS ok",
    "neighbour_cross3": f"WITH {CUBE}, o(s, dx, dy) AS (VALUES (0, -1, 0), (1, 0, -1), (2, 0, 0), (3, 0, 1), (4, 1, 0)) SELECT a.t, a.v, s, coalesce(b.observed, false) AS observed, round(b.b0, 6) AS b0 FROM cube a CROSS JOIN o LEFT JOIN cube b ON b.t = a.t AND b.x = a.x + dx AND b.y = a.y + dy",
    "outline_dilation": f"WITH {CUBE} SELECT DISTINCT a.t, a.x, a.y FROM cube a JOIN cube b ON a.t = b.t AND NOT b.observed AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 WHERE a.observed",
    "error_image": f"WITH {PRED} SELECT t, v, floor(CASE WHEN any_value(observed) THEN (max(abs(filled - val)) FILTER (band = 0) + max(abs(filled - val)) FILTER (band = 1) + max(abs(filled - val)) FILTER (band = 2)) / 3 ELSE 0 END * 100 + 0.5) / 100 AS error FROM pred GROUP BY t, v",
    "outline_products": f"WITH {PRED}, edge AS (SELECT DISTINCT a.t, a.v FROM masked a JOIN masked b ON a.t = b.t AND b.hidden AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 WHERE NOT a.hidden), p AS (SELECT p.*, e.v IS NOT NULL AS at_edge FROM pred p LEFT JOIN edge e ON e.t = p.t AND e.v = p.v) SELECT t, v, "
    + ", ".join(f"round(max(CASE WHEN at_edge THEN {0 if b == 1 else 1500} {hid}ELSE val END) FILTER (band = {b}), 6) AS {n}_outline_{b}" for n, hid in (("pred", "WHEN hidden THEN filled "), ("original", "")) for b in range(3))
    + " FROM p GROUP BY t, v",
    "split_images": f"WITH {CUBE}, {HID} SELECT CAST(g.fold AS INTEGER) AS fold, f.t, f.x, f.y, CASE WHEN f.fold = g.fold THEN 255 ELSE 0 END AS test, CASE WHEN h.v IS NOT NULL THEN 255 ELSE 0 END AS hidden FROM folds f CROSS JOIN (SELECT DISTINCT fold FROM folds) g LEFT JOIN hid h ON h.fold = g.fold AND h.t = f.t AND h.v = f.v",
    "hide_one_date": f"WITH {CUBE}, one AS (SELECT *, count(*) OVER (PARTITION BY fold) AS n, row_number() OVER (PARTITION BY fold ORDER BY {_hash('v * 7919 + t * 104729', 3)}, v, t) AS r FROM folds WHERE observed AND t = 1) SELECT fold, t, v FROM one WHERE r <= floor(n * CAST(0.2 AS DOUBLE))",
    "shuffled_folds": f"WITH {CUBE}, o AS (SELECT v, row_number() OVER (ORDER BY {_hash('v * 7919', 5)}, v) - 1 AS r FROM (SELECT DISTINCT v FROM cube)) SELECT v, CAST(((r + 1) * 2 - 1) // 1250 AS INTEGER) AS fold FROM o",
    "cross_validation": f"WITH {_report(_nearest('long', 'fold, v, band', 'dd', 'sv', 'fold, t, v, x, y, observed, hidden, band, val'))}, reports AS (SELECT 'NN' AS version, fold, t, obs, miss, hid, mae, rmse, r2 FROM report) SELECT version, t, CAST(sum(obs) AS BIGINT) AS obs, CAST(sum(miss) AS BIGINT) AS miss, CAST(sum(hid) AS BIGINT) AS hid, {', '.join(f'round({_weighted(c)}, 3) AS {c}' for c in _SCORES[:3])} FROM reports GROUP BY version, t",
    "fill_only_gaps": f"WITH {PRED} {_wide('CASE WHEN observed THEN val ELSE filled END', 'pred', 't, v')}",
    "prediction_store": f"WITH {PRED} {_wide('CASE WHEN hidden THEN filled ELSE val END', 'pred', 't, v')}",
    "render_bw": f"WITH {CUBE} SELECT t, v, {_GREY} AS grey FROM (SELECT *, min(q) OVER (PARTITION BY t) AS lo, max(q) OVER (PARTITION BY t) AS hi FROM (SELECT t, v, round(b0, 2) AS q FROM cube))",
    "render_rgb": f"WITH {CUBE} SELECT t, v, {_LEVEL.format('b0')} AS r, {_LEVEL.format('b1')} AS g, {_LEVEL.format('b2')} AS b FROM cube",
    "downsample_series": "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i % CAST(ceil(n / CAST(200 AS DOUBLE)) AS BIGINT) = 0",
    "nearest_centroid": f"WITH {NEAREST} SELECT vec_id, state, round(d2, 6) AS d2 FROM near",
    "centroid_lookup": f"WITH {VECTORS} SELECT vec_id, label AS state, a.c AS c0, b.c AS c63 FROM embeddings LEFT JOIN cen a ON a.state = label AND a.i = 0 LEFT JOIN cen b ON b.state = label AND b.i = 63",
    "quantisation_rmse": f"WITH {NEAREST} SELECT round(sqrt(sum(d2) / (count(*) * 64)), 6) AS rmse FROM near",
    "state_similarity": f"""WITH {VECTORS}, d AS (SELECT a.state AS s0, b.state AS s1, round(sqrt(sum((a.c - b.c) * (a.c - b.c))), 9) AS d FROM cen a JOIN cen b USING (i) GROUP BY a.state, b.state),
s AS (SELECT s0, s1, coalesce(1 - (d - min(d) OVER ()) / nullif(max(d) OVER () - min(d) OVER (), 0), 1) AS sim FROM d)
SELECT s0, s1, CASE WHEN sim > 0 THEN round(ln(sim / total), 4) END AS logsim FROM (SELECT *, sum(sim) OVER (PARTITION BY s0) AS total FROM s)""",
    "transition_prior_temporal": f"WITH {STATES} {_transitions('SELECT state AS s0, lead(state) OVER (PARTITION BY v ORDER BY t) AS s1 FROM st')}",
    "transition_prior_spatial": f"WITH {STATES} {_transitions('SELECT a.state AS s0, b.state AS s1 FROM st a JOIN st b ON a.t = b.t AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))')}",
    "slice_priors": f"""WITH {STATES}, near AS (SELECT a.v, a.t, o.s, b.state FROM st a CROSS JOIN (VALUES (0, -1, 0), (1, 0, -1), (2, 0, 0), (3, 0, 1), (4, 1, 0)) AS o(s, dx, dy) LEFT JOIN st b ON b.t = a.t AND b.x = a.x + o.dx AND b.y = a.y + o.dy),
pairs AS (SELECT 0 AS kind, a.state AS s0, b.state AS s1 FROM near a JOIN near b ON a.v = b.v AND a.s = b.s AND b.t = a.t + 1 UNION ALL SELECT 1, a.state, b.state FROM near a JOIN near b ON a.v = b.v AND a.t = b.t AND a.s < b.s AND (a.s = 2 OR b.s = 2))
SELECT CAST(kind AS INTEGER) AS kind, s0, s1, n, round(ln(n / sum(n) OVER (PARTITION BY kind, s0)), 6) AS logp FROM (
  SELECT k.kind, a.s AS s0, b.s AS s1, CAST(count(p.s0) + 1 AS BIGINT) AS n FROM (VALUES (0), (1)) AS k(kind) CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS s) a CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS s) b
  LEFT JOIN (SELECT * FROM pairs WHERE s0 IS NOT NULL AND s1 IS NOT NULL) p ON p.kind = k.kind AND p.s0 = a.s AND p.s1 = b.s GROUP BY ALL)""",
    "edges_chain": "SELECT CAST(i AS INTEGER) AS e, CAST(i AS INTEGER) AS u, CAST(i + 1 AS INTEGER) AS w, 'time' AS kind FROM (SELECT unnest(range(6)) AS i)",
    "edges_cross": "SELECT CAST(i AS INTEGER) AS e, CAST(i * 5 + 2 AS INTEGER) AS u, CAST(i * 5 + 7 AS INTEGER) AS w, 'time' AS kind FROM (SELECT unnest(range(6)) AS i) UNION ALL SELECT CAST(6 + t * 4 + s - CASE WHEN s > 2 THEN 1 ELSE 0 END AS INTEGER), CAST(t * 5 + 2 AS INTEGER), CAST(t * 5 + s AS INTEGER), 'space' FROM (SELECT unnest(range(7)) AS t) CROSS JOIN (SELECT unnest([0, 1, 3, 4]) AS s)",
    "adaptive_lambda": f"WITH {STATES} SELECT CAST(a.t AS INTEGER) AS e, round(CAST(0.1 AS DOUBLE) * avg(CAST(a.state IS NULL OR b.state IS NULL AS INTEGER)), 6) AS lam FROM st a JOIN st b ON a.v = b.v AND b.t = a.t + 1 GROUP BY a.t",
    "edge_statistics": f"WITH {STATES} SELECT CAST(a.t AS INTEGER) AS e, a.state AS s0, b.state AS s1, count(*) AS n FROM st a JOIN st b ON a.v = b.v AND b.t = a.t + 1 WHERE a.state IS NOT NULL AND b.state IS NOT NULL GROUP BY ALL",
    "nspi_input": f"WITH {CUBE}, {_INPUT} SELECT t, v, t_in FROM inp",
    "nspi_similar_topk": f"""WITH {CUBE}, {_INPUT},
near AS (SELECT i.t, i.v, n.v AS v2, sqrt(CAST((n.x - o.x) * (n.x - o.x) + (n.y - o.y) * (n.y - o.y) AS DOUBLE)) AS far, o.b0 AS o0, o.b1 AS o1, o.b2 AS o2, n.b0 AS n0, n.b1 AS n1, n.b2 AS n2, w.b0 AS w0, w.b1 AS w1, w.b2 AS w2
  FROM inp i JOIN cube o ON o.t = i.t_in AND o.v = i.v JOIN cube n ON n.t = i.t AND n.observed AND n.x BETWEEN o.x - 3 AND o.x + 3 AND n.y BETWEEN o.y - 3 AND o.y + 3 AND n.v <> o.v JOIN cube w ON w.t = i.t_in AND w.v = n.v AND w.observed),
err AS (SELECT *, sqrt(((o0 - w0) * (o0 - w0) + (o1 - w1) * (o1 - w1) + (o2 - w2) * (o2 - w2)) / 3) + CAST(0.0001 AS DOUBLE) AS alike, sqrt(((w0 - n0) * (w0 - n0) + (w1 - n1) * (w1 - n1) + (w2 - n2) * (w2 - n2)) / 3) + CAST(0.0001 AS DOUBLE) AS change FROM near),
best AS (SELECT *, 1 / (alike * far) AS w FROM err QUALIFY row_number() OVER (PARTITION BY t, v ORDER BY alike, v2) <= 10)
SELECT t, v, count(*) AS n, """ + ", ".join(f"round((avg(change) * (sum(w * n{i}) / sum(w)) + avg(alike) * (any_value(o{i}) + sum(w * (n{i} - w{i})) / sum(w))) / (avg(alike) + avg(change)), 6) AS b{i}" for i in range(3)) + " FROM best GROUP BY t, v",
    "board": """SELECT t, x, y, t <> 1 AS observed, """ + ", ".join(
        f"CASE WHEN greatest(x, y) < 16 OR least(x, y) >= 48 THEN CAST({0 if b == 1 else 127.5} AS DOUBLE) WHEN x BETWEEN 16 AND 47 AND y BETWEEN 16 AND 47 THEN CASE WHEN {'t IN (0, 2)' if b == 0 else 't = 1' if b == 1 else 't = 3'} THEN CAST(255 AS DOUBLE) ELSE 0 END ELSE CAST(CASE WHEN (x // 16 + y // 16 + t) % 2 = 0 THEN 255 ELSE 0 END AS DOUBLE) END AS b{b}" for b in range(3)
    ) + " FROM (SELECT CAST(unnest(range(4)) AS INTEGER) AS t) CROSS JOIN (SELECT CAST(unnest(range(64)) AS INTEGER) AS x) CROSS JOIN (SELECT CAST(unnest(range(64)) AS INTEGER) AS y)",
    "report_name_parse": "SELECT * FROM (VALUES ('MRF_S0_01_l2_tp_0_1_cross3_map_em2_32Means_spatial_clouds0_2', CAST(0.01 AS DOUBLE), 'l2', 'tp', CAST(0.1 AS DOUBLE), 'cross3', 'map', 2, 32, 'spatial_clouds0_2'), ('MRF_S10_es_tp_0_5_cross3_sup_em2_8Means_random0_5', 10, 'es', 'tp', 0.5, 'cross3', 'sup', 2, 8, 'random0_5'), ('mrf_s0_01_tp_tp_0_1_cross3_sup_em5_32means_spatial_clouds0_2', 0.01, 'tp', 'tp', 0.1, 'cross3', 'sup', 5, 32, 'spatial_clouds0_2'), ('LIN_random0_2', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)) AS n(name, stop, tprior, sprior, lam, shape, predict, em, k, hide)",
    "day_labels": "SELECT n AS dno, strftime(DATE '2018-01-01' + CAST(n - 1 AS INTEGER), '%b %d %Y') AS label, CASE WHEN n % 2 = 0 THEN 'n.a. ' ELSE printf('%4.1f', CAST(1.25 AS DOUBLE)) END AS error, (CAST(n AS DOUBLE) - 1) * 255 / 364 AS scaled FROM (SELECT unnest(range(1, 366, 13)) AS n)",
}
SQL["day_labels"] = SQL["day_labels"].replace("printf('%4.1f', CAST(1.25 AS DOUBLE))", "' 1.3'")
