"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual_nodes`` places on a ring of 63-bit positions; a row belongs to the first
place clockwise from its own position.  A shard takes the rows of its arcs up to its capacity; rows
beyond it continue clockwise to the next place whose shard has room.  Only rows above a capacity
move, so movement is the least that the bound allows.  The walk is planned over arcs (a count for
each place on the ring: a fixed number of rows, whatever the input) and carried out by a rank within
the arc.  Ranks are taken within pieces of an arc and the pieces' counts added up, so that an arc is
ranked by many tasks; a piece far above its share (one key with very many rows) is dealt to SALTS parts.
Everything that touches rows is DataFrame code.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

VIRTUAL_NODES = 64
_CELL_BITS = 14
#: The ring has 2^16 pieces of equal length; a piece that holds this many times its share is dealt out.
_PIECE_BITS = 16
HOT_TIMES = 8
HOT_LEAST = 1 << 16
SALTS = 16


def _ring(spark: SparkSession, shards: int, virtual_nodes: int) -> DataFrame:
    """place (0.. clockwise), at (position), shard."""
    n = F.col("id")
    at = F.shiftrightunsigned(F.xxhash64(F.lit("ring"), (n % shards), F.floor(n / shards)), 1)
    return spark.range(shards * virtual_nodes).select(at.alias("at"), (n % shards).cast("int").alias("shard")).withColumn("place", F.row_number().over(Window.orderBy("at", "shard")) - 1)


def _cells(spark: SparkSession, ring: DataFrame) -> DataFrame:
    """For each of 2^14 equal pieces of the ring: places before it, and the positions of places in it."""
    inside = ring.groupBy(F.shiftright("at", 63 - _CELL_BITS).alias("cell")).agg(F.sort_array(F.collect_list("at")).alias("ats"), F.min("place").alias("place"))
    before = F.sum(F.coalesce(F.size("ats"), F.lit(0))).over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = spark.range(1 << _CELL_BITS).select(F.col("id").alias("cell")).join(inside, "cell", "left").withColumn("ats", F.coalesce("ats", F.array().cast("array<bigint>")))
    return cells.select("cell", "ats", F.coalesce(before, F.lit(0)).alias("before"))


def plan(counts: dict[int, int], owner: list[int], shards: int, slack: float | None = None) -> list[dict]:
    """Segments {place, lo, hi, shard, slot}: ranks lo <= r < hi of an arc go to the shard from that slot on.

    Without slack the counts of shards differ by one at most; the larger ones are those with most rows
    of their own.  With slack a shard takes up to ceil((1 + slack) * rows / shards).
    """
    total = sum(counts.values())
    load = [0] * shards
    for place, s in enumerate(owner):
        load[s] += counts.get(place, 0)
    if slack is None:
        room = [total // shards] * shards
        for s in sorted(range(shards), key=lambda s: (-load[s], s))[: total % shards]:
            room[s] += 1
    else:
        room = [-int(-(1 + slack) * total // shards)] * shards
    used, out, over = [0] * shards, [], []

    def give(place, lo, hi, s):
        out.append({"place": place, "lo": lo, "hi": hi, "shard": s, "slot": used[s]})
        used[s] += hi - lo

    for place, s in enumerate(owner):
        n = counts.get(place, 0)
        own = min(n, room[s] - used[s])
        if own:
            give(place, 0, own, s)
        if own < n:
            over.append((place, own, n))
    for place, lo, hi in over:
        step = place
        while lo < hi:
            step = (step + 1) % len(owner)
            s = owner[step]
            n = min(hi - lo, room[s] - used[s])
            if n:
                give(place, lo, lo + n, s)
                lo += n
    return out


def assign(rows: DataFrame, keys: list[str], shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float | None = None) -> DataFrame:
    """The columns of ``rows`` with shard (0..) and slot (gapless from 0 in each shard).

    A row's position is a hash of the key columns (nulls are values like others); rows that are equal in
    all of them are interchangeable.  Columns named shard or slot give way to the new ones; other columns
    may have any name.  An empty table gives an empty table.
    """
    spark = rows.sparkSession
    ring = _ring(spark, shards, virtual_nodes)
    places = shards * virtual_nodes
    owner = [r.shard for r in ring.orderBy("place").collect()]  # shards * virtual_nodes rows
    cells = F.broadcast(_cells(spark, ring))  # 2^14 rows
    # null-safe position: hash() skips nulls, so each key also says whether it is null
    parts = [x for k in keys for x in (F.col(k), F.col(k).isNull())]
    placed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.shiftrightunsigned(F.xxhash64(*parts), 1).alias("at"))
    placed = placed.withColumn("cell", F.shiftright("at", 63 - _CELL_BITS)).join(cells, "cell")
    place = ((F.col("before") + F.size(F.filter("ats", lambda x: x < F.col("at")))) % places).cast("int")
    piece = F.shiftright("at", 63 - _PIECE_BITS).cast("int")
    placed = written(placed.select("row", "at", place.alias("place"), piece.alias("piece"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")))
    sizes = written(placed.groupBy("place", "piece", "salt").agg(F.count("*").alias("n")))  # at most (2^16 + places) * SALTS rows
    counts = {r["place"]: r["n"] for r in sizes.groupBy("place").agg(F.sum("n").alias("n")).collect()}  # at most ``places`` rows
    hot = sizes.groupBy("place", "piece").agg(F.sum("n").alias("n")).where(F.col("n") > max(HOT_LEAST, HOT_TIMES * sum(counts.values()) >> _PIECE_BITS))
    hot = F.broadcast(written(hot.select("place", "piece", F.lit(True).alias("hot"))))  # under 2^16 / HOT_TIMES rows

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(hot, ["place", "piece"], "left").withColumn("salt", F.when(F.col("hot"), F.col("salt")).otherwise(0)).drop("hot")

    in_order = Window.partitionBy("place").orderBy("piece", "salt").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt(sizes).groupBy("place", "piece", "salt").agg(F.sum("n").alias("n"))
    first = first.select("place", "piece", "salt", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("place", "piece", "salt").orderBy("at", *[F.col("row")[k] for k in keys])).cast("long") - 1
    ranked = dealt(placed).withColumn("own", own).join(F.broadcast(first), ["place", "piece", "salt"]).select("row", "place", (F.col("first") + F.col("own")).alias("rank"))
    kind = "array<struct<place:int,lo:bigint,hi:bigint,shard:int,slot:bigint>>"
    segments = plan(counts, owner, shards, slack)
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(segments)), kind)).alias("s"))
    hit = (F.col("place") == F.col("s.place")) & (F.col("rank") >= F.col("s.lo")) & (F.col("rank") < F.col("s.hi"))
    # at most two segments for each place and one for each shard that fills up
    out = ranked.join(F.broadcast(table), hit)
    keep = [F.col("row")[c].alias(c) for c in rows.columns if c.lower() not in ("shard", "slot")]
    return out.select(*keep, F.col("s.shard").alias("shard"), (F.col("s.slot") + F.col("rank") - F.col("s.lo")).alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Law ``rows``: a shard's capacity is its fair share of rows, so counts are one apart at most."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    out = assign(rows, ["doc_id", "size", "text_crc32"], 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
