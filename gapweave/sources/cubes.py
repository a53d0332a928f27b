"""Sources: cubes of cells (t, day, x, y, v, bands, observed) and daily series."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import exact_mean, vertex

CUBE = "t int, day int, x int, y int, v bigint, bands array<double>, observed boolean"


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, dno, v: mean value by user and day on the full user x day grid, null in the gaps."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id IS NOT NULL")
    dno = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).cast("long")
    obs = e.select("user_id", dno.alias("dno"), "value").groupBy("user_id", "dno").agg(exact_mean("value").alias("v"))
    days = obs.select("dno").distinct()
    # the axes are distinct keys; the days of a series number in the hundreds or thousands
    grid = obs.select("user_id").distinct().crossJoin(days)
    return grid.join(obs, ["user_id", "dno"], "left")


def lineitem_cube(spark: SparkSession, sf_dir: str, width: int = 50, height: int = 25) -> DataFrame:
    """Cube from sales: t = ship year, x = part size, y = brand, bands = mean quantity, discount, price."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") - 1).cast("int").alias("x"), (F.substring("p_brand", 7, 10).cast("int") - 1).alias("y"))
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", F.year("l_shipdate").alias("yr"), "l_quantity", "l_discount", "l_extendedprice")
    cells = item.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("yr", "x", "y").agg(exact_mean("l_quantity").alias("b0"), exact_mean("l_discount").alias("b1"), exact_mean("l_extendedprice").alias("b2"))
    years = cells.select("yr").distinct().withColumn("t", (F.row_number().over(Window.orderBy("yr")) - 1).cast("int"))
    grid = F.broadcast(years).crossJoin(spark.range(width * height).select((F.col("id") / height).cast("int").alias("x"), (F.col("id") % height).cast("int").alias("y")))
    dense = grid.join(cells, ["yr", "x", "y"], "left")
    return dense.select(
        "t", (F.col("t") + 1).alias("day"), "x", "y", vertex(F.col("x"), F.col("y"), height).cast("long").alias("v"),
        F.array(*[F.coalesce(F.col(b), F.lit(0.0)) for b in ("b0", "b1", "b2")]).alias("bands"), F.col("b0").isNotNull().alias("observed"),
    )


def board(spark: SparkSession, lost_date: int | None = None) -> DataFrame:
    """Synthetic 64 x 64 board over four dates and three bands; ``lost_date`` leaves one date unobserved."""
    t, x, y = F.floor(F.col("id") / 4096).cast("int"), F.floor(F.col("id") % 4096 / 64).cast("int"), (F.col("id") % 64).cast("int")
    cell = spark.range(4 * 4096).select(t.alias("t"), x.alias("x"), y.alias("y"))
    light = (1 - (F.floor(F.col("x") / 16) + F.floor(F.col("y") / 16)) % 2).cast("double")
    light = F.when(F.col("t") % 2 == 1, 1.0 - light).otherwise(light)
    centre = F.col("x").between(16, 47) & F.col("y").between(16, 47)
    corner = (F.greatest("x", "y") < 16) | (F.least("x", "y") >= 48)
    colour = {0: 0, 1: 1, 2: 0, 3: 2}  # red, green, red, blue
    lit = [sum(F.when((F.col("t") == k) & (F.lit(c) == b), 1.0).otherwise(0.0) for k, c in colour.items()) for b in range(3)]
    bands = [F.when(corner, F.lit(0.0 if b == 1 else 0.5)).when(centre, lit[b]).otherwise(light) * 255.0 for b in range(3)]
    seen = F.lit(True) if lost_date is None else F.col("t") != lost_date
    return cell.select("t", F.col("t").alias("day"), "x", "y", vertex(F.col("x"), F.col("y"), 64).cast("long").alias("v"), F.array(*bands).alias("bands"), seen.alias("observed"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their number in the file, whatever splits they are read in."""
    part = lines.withColumn("_p", F.col("_metadata.file_block_start")).withColumn("_i", F.monotonically_increasing_id())
    part = part.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy("_i")))
    sizes = part.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return part.join(F.broadcast(before), "_p").select("value", (F.col("_before") + F.col("_n") - 1).alias("line"))


def csv_cube(spark: SparkSession, folder: str, width: int, height: int, dates: int, bands: int) -> DataFrame:
    """mask.csv (a row of dates, then flags by pixel) and data.csv (a header, then band-major values by pixel)."""

    def rows(name):
        return _numbered(spark.read.text(f"{folder}/{name}")).withColumn("c", F.split("value", ","))

    mask, data = rows("mask.csv"), rows("data.csv")
    days = mask.where("line = 0").select(F.posexplode(F.transform("c", lambda s: s.cast("int"))).alias("t", "day"))
    flags = mask.where("line > 0").select((F.col("line") - 1).alias("v"), F.posexplode("c").alias("t", "flag"))
    values = data.where("line > 0").select((F.col("line") - 1).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(dates - 1))).alias("t"), "c")
    values = values.select("v", "t", F.array(*[F.get("c", F.col("t") + b * dates).cast("double") for b in range(bands)]).alias("bands"))
    cube = values.join(flags, ["v", "t"]).join(F.broadcast(days), "t")
    x, y = F.floor(F.col("v") / height).cast("int"), (F.col("v") % height).cast("int")
    return cube.where(F.col("v") < width * height).select("t", "day", x.alias("x"), y.alias("y"), "v", "bands", (F.col("flag").cast("double") != 0).alias("observed"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, t, content of the picture files of a run, in name order."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    return found.select("path", F.regexp_extract("path", r"_t(\d+)\.png$", 1).cast("int").alias("t"), "content")


class Source(NamedTuple):
    """A registered cube: how it is made from a path, and what belongs to it."""

    make: Callable[[SparkSession, str | None], DataFrame]
    low: float = 0.0
    high: float = 255.0
    gap_width: int = 32
    shown: tuple[int, ...] = (0, 1, 2)
    #: Dates that may get artificial gaps; all if none are named.
    hide_dates: list[int] | None = None


def _csv(spark: SparkSession, path: str | None) -> DataFrame:
    """folder, or folder:width,height,dates,bands."""
    if not path:
        raise ValueError("a CSV cube needs the path of its folder")
    folder, _, shape = path.rpartition(":") if re.search(r":\d+(,\d+){3}$", path) else (path, "", "1000,1000,21,3")
    return csv_cube(spark, folder, *map(int, shape.split(",")))


#: By name, in the order in which they are looked for.
REGISTRY = {
    "board2": Source(lambda spark, _: board(spark, lost_date=1), hide_dates=[1]),
    "board": Source(lambda spark, _: board(spark), hide_dates=[1]),
    "csv": Source(_csv, 0.0, 3000.0, 70),
    "lineitem": Source(lineitem_cube),
}


def get_source(name: str) -> Source:
    """The first registered source whose name stands in ``name``."""
    for key, source in REGISTRY.items():
        if key in name.lower():
            return source
    raise NotImplementedError(f"no source for {name!r}; there are {sorted(REGISTRY)}")


def get_cube(spark: SparkSession, name: str, path: str | None = None, cache: str | None = None) -> DataFrame:
    """The cube of the first registered source whose name stands in ``name``, checked.

    ``name`` may be "source:path" in place of a path of its own.  With ``cache`` the parsed cube is kept there as
    Parquet, and read from there the next time.
    """
    if path is None and ":" in name:
        name, path = name.split(":", 1)
    source = get_source(name)
    if cache:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/_SUCCESS")
        if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            source.make(spark, path).write.mode("overwrite").parquet(cache)
        return check_cube(spark.read.parquet(cache))
    return check_cube(source.make(spark, path))


def check_cube(cube: DataFrame) -> DataFrame:
    """The cube, if its columns are right, each (t, v) stands once, and all band arrays are equally long and full."""
    kinds = dict(cube.dtypes)
    want = dict(x.split(" ", 1) for x in CUBE.split(", "))
    if wrong := sorted(c for c, k in want.items() if kinds.get(c) != k):
        raise ValueError(f"a cube has the columns {CUBE}; not so: {wrong}")
    r = cube.agg(F.count("*").alias("n"), F.count_distinct("t").alias("t"), F.count_distinct("v").alias("v"), F.min(F.size("bands")).alias("a"), F.max(F.size("bands")).alias("b"), F.count_if(F.exists("bands", lambda x: x.isNull()) | F.col("bands").isNull() | F.col("observed").isNull()).alias("holes")).first()
    if r.n != r.t * r.v or r.a != r.b or r.holes:
        raise ValueError(f"a cube holds every vertex once on every date, with full bands: {r.n} cells, {r.t} dates, {r.v} vertices, bands of {r.a} to {r.b}, {r.holes} cells with nulls")
    if not check_dates(cube).first().ok:
        raise ValueError("days must be unique and rise with t")
    return cube


def check_dates(cube: DataFrame) -> DataFrame:
    """One row: whether days are unique and rise with t."""
    days = cube.groupBy("t").agg(F.min("day").alias("day"), F.max("day").alias("last"))
    ordered = days.select("t", "day", "last", F.lag("last").over(Window.orderBy("t")).alias("before"))
    return ordered.agg(F.coalesce(F.bool_and((F.col("day") == F.col("last")) & F.coalesce(F.col("before") < F.col("day"), F.lit(True))), F.lit(True)).alias("ok"))


def subrange(cube: DataFrame, x0: int, x1: int, y0: int, y1: int, width: int, height: int, strict: bool = False) -> DataFrame:
    """Cells with x0 <= x < x1 and y0 <= y < y1, numbered anew; ``strict`` keeps the last row and column out of reach."""
    if not (0 <= x0 < x1 <= width - strict and 0 <= y0 < y1 <= height - strict):
        raise ValueError("subrange must be x0,x1,y0,y1 within the image")
    cut = cube.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    x, y = F.col("x") - x0, F.col("y") - y0
    return cut.select("t", "day", x.alias("x"), y.alias("y"), vertex(x, y, y1 - y0).cast("long").alias("v"), "bands", "observed")
