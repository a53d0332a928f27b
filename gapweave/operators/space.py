"""Neighbourhoods: stencils, outlines, similar pixels, and the pictures made of them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import mean_abs_error


def cross(width: int) -> list[tuple[int, int, int]]:
    """(s, dx, dy) of a cross of odd width, row by row; the centre is s = width - 1."""
    half = width // 2
    cells = [(dx, dy) for dx in range(-half, half + 1) for dy in range(-half, half + 1) if dx == 0 or dy == 0]
    return [(s, dx, dy) for s, (dx, dy) in enumerate(cells)]


def gather(cells: DataFrame, stencil: list[tuple[int, int, int]], values: list[str]) -> DataFrame:
    """(v, t, x, y, s, values, observed) for each cell and offset; outside the image nothing is observed.

    The offsets are exploded and met by equality, so the join hashes instead of comparing ranges.
    """
    offs = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for s, dx, dy in stencil]))
    wanted = cells.select("v", "t", "x", "y", offs.alias("o")).select("v", "t", "x", "y", "o.s", (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"))
    found = cells.select("t", F.col("x").alias("nx"), F.col("y").alias("ny"), *values, "observed")
    return wanted.join(found, ["t", "nx", "ny"], "left").withColumn("observed", F.coalesce("observed", F.lit(False))).drop("nx", "ny")


def outline(marked: DataFrame, width: int) -> DataFrame:
    """(t, x, y): cells within Chebyshev distance ``width`` of a marked cell that are not marked.

    ``marked``: t, x, y and a boolean ``mark`` on a dense grid.  Two running maxima, along y and along x.
    """
    m = marked.select("t", "x", "y", F.col("mark").cast("int").alias("m"))
    along_y = Window.partitionBy("t", "x").orderBy("y").rangeBetween(-width, width)
    along_x = Window.partitionBy("t", "y").orderBy("x").rangeBetween(-width, width)
    near = m.withColumn("n", F.max("m").over(along_y)).withColumn("n", F.max("n").over(along_x))
    return near.where("n = 1 AND m = 0").select("t", "x", "y")


def products(pred: DataFrame) -> DataFrame:
    """pred_hidden (prediction on hidden cells, data elsewhere), pred_gaps (prediction in true gaps only), error (0 where unobserved)."""
    return pred.select(
        "t", "x", "y", "v", F.when(F.col("hidden"), F.col("pred")).otherwise(F.col("bands")).alias("pred_hidden"),
        F.when(F.col("observed"), F.col("bands")).otherwise(F.col("pred")).alias("pred_gaps"),
        F.when(F.col("observed"), mean_abs_error("pred", "bands")).otherwise(0.0).alias("error"),
    )


def outlined(pred: DataFrame, width: int, colour: list[float]) -> DataFrame:
    """pred_outline and original_outline: prediction and data with the outlines of the hidden cells in one colour.

    The outline are the cells of a date within ``width`` of a hidden cell that are not hidden.
    """
    edge = outline(pred.withColumn("mark", F.col("hidden")), width).withColumn("edge", F.lit(True))
    flat = F.array(*[F.lit(float(c)) for c in colour])
    marked = pred.join(edge, ["t", "x", "y"], "left")
    on = F.coalesce("edge", F.lit(False))
    return marked.select("t", "x", "y", "v", F.when(on, flat).when(F.col("hidden"), F.col("pred")).otherwise(F.col("bands")).alias("pred_outline"), F.when(on, flat).otherwise(F.col("bands")).alias("original_outline"))


def outline_width(gap_width: int) -> int:
    return max(gap_width // 20, 3)


def outline_colour(low: float, high: float, bands: int, shown: tuple[int, ...]) -> list[float]:
    """Grey in the bands that are shown, 0 in others."""
    return [(high - low) // 2 if b in shown else 0.0 for b in range(bands)]


def split_images(cells: DataFrame, hidden: DataFrame) -> DataFrame:
    """(fold, t, x, y, test, hidden): for each fold, over all cells, 0/255 pictures of its test area and of its hidden cells."""
    folds = F.broadcast(cells.select("fold").distinct())
    every = folds.crossJoin(cells.select("t", "v", "x", "y", F.col("fold").alias("own")))
    gone = hidden.select("fold", "t", "v", F.lit(255).alias("gone"))
    return every.join(gone, ["fold", "t", "v"], "left").select("fold", "t", "x", "y", F.when(F.col("own") == F.col("fold"), 255).otherwise(0).alias("test"), F.coalesce("gone", F.lit(0)).alias("hidden"))


def save_pictures(pictures: DataFrame, folder: str, name: str) -> list[str]:
    """Writes (t, png) as {name}_t000.png and so on in any folder that Spark can write; a picture for each date at a time."""
    spark = pictures.sparkSession
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for r in pictures.orderBy("t").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}_t{r.t:03d}.png")
        stream = path.getFileSystem(conf).create(path, True)
        stream.write(bytes(r.png))
        stream.close()
        out.append(path.toString())
    return out


def render_bw(images: DataFrame, value: str) -> DataFrame:
    """Grey levels 0..255 by date between its least and largest value; constant images are black."""
    ends = F.broadcast(images.groupBy("t").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))  # a row for each date
    lo, hi = F.col("_lo"), F.col("_hi")
    return images.join(ends, "t").withColumn("grey", F.coalesce(F.floor(F.try_divide(F.col(value) - lo, hi - lo) * 255), F.lit(0)).cast("int")).drop("_lo", "_hi")


def render_rgb(images: DataFrame, bands: tuple[int, int, int], low: float, high: float) -> DataFrame:
    """Three bands clipped to [low, high] and scaled to 0..255."""
    chosen = F.array(*[F.col("bands")[b] for b in bands])
    level = lambda b: F.floor((F.greatest(F.least(b, F.lit(float(high))), F.lit(float(low))) - low) / (high - low) * 255).cast("int")
    return images.withColumn("rgb", F.transform(chosen, level))


def _png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def encode_png(images: DataFrame, level: str) -> DataFrame:
    """(t, png): one picture for each date from grey levels or triples of levels."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[level].iloc[0]
        deep = (3,) if np.ndim(first) else ()
        px = np.zeros((pdf["x"].max() + 1, pdf["y"].max() + 1, *deep), np.uint8)
        px[pdf["x"], pdf["y"]] = np.array(pdf[level].tolist())
        return pd.DataFrame({"t": [pdf["t"].iloc[0]], "png": [_png(px)]})

    return images.select("t", "x", "y", level).groupBy("t").applyInPandas(draw, "t int, png binary")


def input_image(cells: DataFrame, order: str = "nearest") -> DataFrame:
    """(t, v, t_in): the date that each gap cell is predicted from: nearest in time (or farthest) with the cell good.

    One window by vertex: the nearest date is the last good one before or the first one after, the farthest the first or
    last of all; ties go to the smaller t.
    """
    own = Window.partitionBy("v").orderBy("day", "t")
    back, ahead, whole = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing), own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = F.when(F.col("good"), F.struct("day", "t"))
    # of several good dates on one day the smallest t counts
    ends = (F.last(seen, True).over(back), F.first(seen, True).over(ahead)) if order == "nearest" else (F.first(seen, True).over(whole), F.last(seen, True).over(whole))
    both = cells.select("t", "day", "v", "good", ends[0].alias("p"), ends[1].alias("n")).where(~F.col("good"))
    far = lambda c: F.abs(F.col("day") - F.col(f"{c}.day")) * (1 if order == "nearest" else -1)
    pick = F.array_min(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.struct(far(c).alias("far"), F.col(f"{c}.t").alias("t"))) for c in "pn"]), lambda x: x.isNotNull()))
    return both.select("t", "v", pick["t"].alias("t_in")).where("t_in IS NOT NULL")


def image_classes(cells: DataFrame, classes: int, rounds: int = 20) -> DataFrame:
    """Adds class: k-means of the pixels of each date, with gap cells as zero vectors and negative values as zero.

    All dates go through the same rounds together: assign each pixel to the nearest centre (the smaller number on ties),
    then average by date and class.  Centres begin at spread-out quantiles of the mean over bands; they are dates x
    classes rows, which the driver holds between rounds.  A centre without pixels stays where it is.
    """
    spark = cells.sparkSession
    px = cells.withColumn("_z", F.when(F.col("good"), F.transform("bands", lambda b: F.greatest(b, F.lit(0.0)))).otherwise(F.transform("bands", lambda b: F.lit(0.0))))
    depth = cells.select(F.size("bands").alias("d")).first()
    if depth is None:
        return cells.withColumn("class", F.lit(None).cast("int"))
    level = F.aggregate("_z", F.lit(0.0), lambda s, b: s + b)
    marks = [(2 * i + 1) / (2 * classes) for i in range(classes)]
    at = px.select("t", "_z", level.alias("_l")).groupBy("t").agg(*[F.percentile_approx("_l", F.lit(m)).alias(f"_q{i}") for i, m in enumerate(marks)], F.avg("_l").alias("_a"), *[F.avg(F.get("_z", F.lit(d))).alias(f"_b{d}") for d in range(depth.d)])
    centres = {}
    for r in at.collect():  # a row for each date
        base = [r[f"_b{d}"] or 0.0 for d in range(depth.d)]
        centres[r.t] = [[b * (r[f"_q{i}"] / r["_a"]) if r["_a"] else 0.0 for b in base] for i in range(classes)]

    def labelled(now):
        table = spark.createDataFrame(list(now.items()), "t int, _c array<array<double>>")
        near = F.array_min(F.transform("_c", lambda c, i: F.struct(F.aggregate(F.zip_with("_z", c, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d).alias("d"), i.alias("i"))))
        return px.join(F.broadcast(table), "t").withColumn("class", near["i"].cast("int")).drop("_c")

    for _ in range(rounds):
        means = labelled(centres).groupBy("t", "class").agg(*[F.avg(F.get("_z", F.lit(d))).alias(f"_b{d}") for d in range(depth.d)]).collect()
        new = {t: [list(c) for c in cs] for t, cs in centres.items()}
        for r in means:
            new[r.t][r["class"]] = [r[f"_b{d}"] for d in range(depth.d)]
        still = all(abs(x - y) <= 1e-9 * max(1.0, abs(x)) for t in new for c, e in zip(new[t], centres[t]) for x, y in zip(c, e))
        centres = new
        if still:
            break
    return labelled(centres).drop("_z")


def similar_pixels(cells: DataFrame, targets: DataFrame, reach: int, m: int) -> DataFrame:
    """Weighted prediction of gap cells from the ``m`` most alike pixels of a fixed window: (t, v, n, pred).

    ``cells``: t, x, y, v, bands, good; ``targets``: t, v, t_in.  Candidates lie within ``reach``, are good in both
    images, and weigh 1 / (spectral error x distance).  The result mixes the weighted mean of their values in
    the target image with the input value shifted by their weighted mean change.
    """
    img = cells.select("t", "x", "y", "v", "bands", "good")
    at = targets.join(img.select(F.col("t").alias("t_in"), "v", "x", "y", F.col("bands").alias("own")), ["t_in", "v"])
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if dx or dy])
    near = at.withColumn("o", F.explode(offs)).select("t", "t_in", "v", "own", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.sqrt((F.col("o.dx") * F.col("o.dx") + F.col("o.dy") * F.col("o.dy")).cast("double")).alias("far"))
    both = img.where("good").select("t", "x", "y", F.col("v").alias("v2"), F.col("bands").alias("then"))
    both = near.join(both, ["t", "x", "y"]).join(img.where("good").select(F.col("t").alias("t_in"), F.col("x"), F.col("y"), F.col("bands").alias("now")), ["t_in", "x", "y"])

    def rmse(a, b):
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d) / F.size(a))

    both = both.withColumn("alike", rmse("own", "now") + 1e-4).withColumn("change", rmse("now", "then") + 1e-4)
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("t", "v").orderBy("alike", "v2"))).where(F.col("r") <= m)
    w = 1 / (F.col("alike") * F.col("far"))
    wide = best.select("t", "v", "own", w.alias("w"), "alike", "change", F.posexplode(F.arrays_zip("then", "now")).alias("band", "z"))
    by = wide.groupBy("t", "v", "band").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("z.then")) / F.sum("w")).alias("p1"), (F.sum(F.col("w") * (F.col("z.then") - F.col("z.now"))) / F.sum("w")).alias("shift"), F.avg("alike").alias("t1"), F.avg("change").alias("t2"), F.first("own").alias("own"))
    p2 = F.element_at("own", F.col("band") + 1) + F.col("shift")
    mixed = (F.col("t2") * F.col("p1") + F.col("t1") * p2) / (F.col("t1") + F.col("t2"))
    return by.select("t", "v", "band", "n", mixed.alias("value")).groupBy("t", "v").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("band", "value"))), lambda s: s["value"]).alias("pred"))


def similar_fill(cells: DataFrame, classes: int = 4, min_similar: int = 30, low: float = 0.0, high: float = 10000.0, order: str = "nearest") -> DataFrame:
    """Neighbourhood-similarity filling with an adaptive window: (t, v, pred) for every gap cell that some date can serve.

    ``cells``: t, day, x, y, v, bands, good.  The half window grows by binary search until it has 2 to 3 times
    ``min_similar`` cells of the same class good in both; fewer than 3 in the largest window fall back to interpolation
    in time.  Classes are those of ``image_classes`` in the input image, one more than ``classes``.  Windows are counted
    by integral images, one for each class, so a gap cell costs a few look-ups and the cells of its own window.

    Each group holds two images, the one to fill and its input: the largest window is a quarter of the image to each
    side, so smaller tiles would hold most of it too.  An image of a million cells takes some 100 MB in its task.
    """
    cells = cells.select("t", "day", "x", "y", "v", "bands", "good")
    serve = input_image(cells, order)
    cells = image_classes(cells, classes + 1)
    pairs = serve.select("t", "t_in").distinct()
    target = pairs.join(cells.select("t", "day", "x", "y", "v", "bands", "good", "class"), "t").withColumn("side", F.lit(0))
    source = pairs.join(cells.select(F.col("t").alias("t_in"), "day", "x", "y", "v", "bands", "good", "class"), "t_in").withColumn("side", F.lit(1)).select(*target.columns)
    picks = pairs.join(serve, ["t", "t_in"]).join(cells.select("t", "v", "day", "x", "y", "bands", "class"), ["t", "v"]).withColumn("good", F.lit(False)).withColumn("side", F.lit(2)).select(*target.columns)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, c = (pdf[pdf["side"] == s] for s in (0, 1, 2))
        w, h, d = int(pdf["x"].max()) + 1, int(pdf["y"].max()) + 1, len(pdf["bands"].iloc[0])
        img, ok = np.zeros((2, w, h, d)), np.zeros((2, w, h), bool)
        for k, part in ((0, a), (1, b)):
            img[k, part["x"], part["y"]] = np.array(part["bands"].tolist())
            ok[k, part["x"], part["y"]] = part["good"].to_numpy()
        both = ok[0] & ok[1]
        cls = np.zeros((w, h), np.int64)
        cls[b["x"], b["y"]] = b["class"].to_numpy()
        top = max(1, round(0.25 * max(w, h)))
        same = [both & (cls == k) for k in range(classes + 1)]
        total = [np.pad(m.cumsum(0, dtype=np.int64).cumsum(1), ((1, 0), (1, 0))) for m in same]
        out = []
        for x, y, v in zip(c["x"], c["y"], c["v"]):
            k = cls[x, y]
            lo, hi = 1, top
            while lo < hi:
                mid = (lo + hi) // 2
                x0, x1, y0, y1 = max(0, x - mid), min(w, x + mid + 1), max(0, y - mid), min(h, y + mid + 1)
                n = total[k][x1, y1] - total[k][x0, y1] - total[k][x1, y0] + total[k][x0, y0]
                lo, hi = (mid + 1, hi) if n < 2 * min_similar else (lo, mid)
            x0, y0 = max(0, x - lo), max(0, y - lo)
            gx, gy = np.nonzero(same[k][x0 : x + lo + 1, y0 : y + lo + 1])
            gx, gy = gx + x0, gy + y0
            if len(gx) < 3:
                continue
            alike = np.sqrt(((img[1, gx, gy] - img[1, x, y]) ** 2).mean(axis=1)) + 1e-4
            best = np.argsort(alike, kind="stable")[:min_similar] if len(gx) >= 2 * min_similar else np.arange(len(gx))
            gx, gy, alike = gx[best], gy[best], alike[best]
            weight = 1 / (alike * np.maximum(np.hypot(gx - x, gy - y), 1e-9))
            weight /= weight.sum()
            change = np.sqrt(((img[1, gx, gy] - img[0, gx, gy]) ** 2).mean(axis=1)) + 1e-4
            p1 = weight @ img[0, gx, gy]
            p2 = img[1, x, y] + weight @ (img[0, gx, gy] - img[1, gx, gy])
            mixed = (change.mean() * p1 + alike.mean() * p2) / (alike.mean() + change.mean())
            out.append((int(c["t"].iloc[0]), int(v), np.where((p2 > low) & (p2 < high), mixed, p1)))
        return pd.DataFrame(out, columns=["t", "v", "pred"])

    filled = target.unionByName(source).unionByName(picks).groupBy("t", "t_in").applyInPandas(fill, "t int, v long, pred array<double>")
    # cells without enough like pixels: between the last good date and the next one, or the input's value
    back = Window.partitionBy("v").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("v").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    seen = F.when(F.col("good"), F.struct("day", "bands"))
    ends = cells.select("t", "v", "day", "good", F.last(seen, True).over(back).alias("p"), F.first(seen, True).over(ahead).alias("n")).where(~F.col("good"))
    share = (F.col("day") - F.col("p.day")) / (F.col("n.day") - F.col("p.day"))
    between = F.zip_with("p.bands", "n.bands", lambda a, b: a + (b - a) * share)
    rest = ends.select("t", "v", F.coalesce(between, "p.bands", "n.bands").alias("between")).where("between IS NOT NULL")
    return rest.join(filled, ["t", "v"], "left").select("t", "v", F.coalesce("pred", "between").alias("pred"))
