"""Exact removal of repeated byte strings: longest-previous-factor test over sharded suffixes.

A byte goes when a ``width``-byte string covering it also starts earlier (smaller doc_id, or the
same document, earlier start).  Suffixes are dealt to shards so that equal strings meet:

1.  Every window of ``width`` bytes has one *anchor*: the least hash among its GRAM-byte grams, the
    leftmost on ties.  Equal windows have equal anchors at equal offsets.  Consecutive windows with
    the same anchor form an *entry* (anchor hash, hash of all its bytes, document, start, count).
2.  Entries meet by anchor hash.  Of entries with equal bytes all but the first are later copies.
    Each map task does this for its own rows before the shuffle, so a passage in a third of all rows
    reaches a shard once per task, not once per row.  First entries whose anchor has other contexts
    too are undecided.
3.  Bytes of undecided entries meet by anchor hash.  Their windows are put in suffix order, and with
    the previous and the next smaller position in that order the longest previous factor is known to
    reach ``width`` or not.  Of an anchor with over GROUP undecided entries the windows are dealt one by
    one, by the hash of the whole window, after each map task has settled its own repeats, so no group
    of a shard grows with the corpus.

Anchors in very many contexts (a short line in a third of all rows) are found by a counting pass
that keeps at most HOT_SHARE hashes; their windows are dealt one by one, by the hash of the whole
window.  Text crosses the network once (the exchange is shared by step 3 and the result).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, tidy, written

GRAM = 32
#: Entries that a map task holds before it deals them out.
BUFFER = 400_000
#: Bytes of text hashed at a time (hashing takes about 80 times as much memory); a longer text is cut into overlapping slabs.
SLAB = 1 << 18
#: An anchor is hot from this share of all entries on, so there are at most this many.
HOT_SHARE = 20_000
HOT_LEAST = 20_000
#: Undecided entries of one anchor that meet as a group, at most.
GROUP = 1024
#: A table of crowded anchors is sent to all tasks up to this many rows; a larger one is met by hash.
CROWDS = 1 << 17
#: Windows of larger groups that a map task holds before it deals them out.
SPARE = 25_000
#: Bytes of context that a task puts in suffix order at a time, beyond one group; each takes some 400 bytes meanwhile.
CHUNK = 1 << 18

_IDX = 24
_MASK = np.uint64((1 << _IDX) - 1)
_KEY = np.uint64(0x9E3779B97F4A7C15)
_NULL_ID = -(2**63)


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of each GRAM-byte gram of buf."""
    n = len(buf) - GRAM + 1
    words = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,)).copy()
    h = np.full(n, _KEY, np.uint64)
    for k in range(0, GRAM, 8):
        h = (h ^ words[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return mix64(h)


def _window_hash(g: np.ndarray, first, last, width: int) -> np.ndarray:
    """Hash of the bytes from window start ``first`` to the end of the window at ``last`` (last - first < width - GRAM + 1)."""
    h = mix64((last - first).astype(np.uint64) + _KEY)
    for at in [first + k for k in range(0, width - GRAM, GRAM)] + [last + k for k in range(width - GRAM, 0, -GRAM)]:
        h = mix64((h ^ g[at]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x632BE59BD9B4E019))
    return h


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (w - have)], a[w - have :]) if have < w else a


def entries(texts: list[bytes], width: int):
    """Yield (index of text, anchor hash, hash of bytes, first window, windows, gram hashes, base) arrays by slab."""
    todo: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        buf = np.frombuffer(b"".join(t for _, _, t in todo) + b"\0" * 8, np.uint8)
        lens = np.array([len(t) for _, _, t in todo])
        ends = np.cumsum(lens)
        starts = ends - lens
        g = _gram_hashes(buf)
        w = width - GRAM + 1
        # the hash orders, the index in the low bits breaks ties to the left and names the anchor
        m = _sliding_min((g & ~_MASK) | np.arange(len(g), dtype=np.uint64), w)
        at = (m & _MASK).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        inner = starts[starts < len(new)]
        new[inner] = True
        first = np.flatnonzero(new)
        owner = np.searchsorted(starts, first, "right") - 1
        last = np.minimum(np.append(first[1:], len(at)) - 1, ends[owner] - width)
        ok = last >= first
        first, last, owner = first[ok], last[ok], owner[ok]
        which = np.array([i for i, _, _ in todo])[owner]
        base = np.array([o for _, o, _ in todo])[owner] - starts[owner]
        todo.clear()
        return which, g[at[first]], _window_hash(g, first, last, width), first, last - first + 1, base, g

    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - width + 1), SLAB):
            part = t[o : o + SLAB + width - 1]
            if len(part) < width:
                continue
            if size + len(part) > SLAB and todo:
                yield flush()
                size = 0
            todo.append((i, o, part))
            size += len(part)
    if todo:
        yield flush()


def later_in_suffix_order(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which windows have a longest previous factor as long as the window.

    ``rows``: (n, width) bytes; ``order``: distinct text positions.  Suffixes are sorted; a run of
    neighbours whose common prefix reaches the width holds equal windows.  The longest previous factor
    of a suffix is reached at its previous or next smaller position in suffix order, so it has the full
    width exactly if one of the two lies in the run.
    """
    n, width = rows.shape
    if n < 2:
        return np.zeros(n, bool)
    sa = np.argsort(np.ascontiguousarray(rows).view(f"V{width}").ravel(), kind="stable")
    full = np.zeros(n, bool)  # lcp with the predecessor >= width
    full[1:] = (rows[sa[1:]] == rows[sa[:-1]]).all(axis=1)
    run = np.cumsum(~full) - 1
    rank = np.empty(n, np.int64)
    rank[np.argsort(order, kind="stable")] = np.arange(n)
    pos = rank[sa]
    # running minima that start anew with each run: a previous (next) smaller position within the run
    down = pos - run * n
    prev = np.zeros(n, bool)
    prev[1:] = np.minimum.accumulate(down)[:-1] < down[1:]
    up = (pos - (run[-1] - run) * n)[::-1]
    nxt = np.zeros(n, bool)
    nxt[1:] = np.minimum.accumulate(up)[:-1] < up[1:]
    out = np.zeros(n, bool)
    out[sa] = prev | nxt[::-1]
    return out


_ENTRY = np.dtype([("hash", "u8"), ("ctx", "u8"), ("doc", "i8"), ("key", "i8"), ("at", "u4"), ("n", "u1")])
_FLAG = "dk long, tk long, kind int, at int, n int, hash long"
_DEALT = "bucket int, dk long, tk long, kind int, at int, n int, hash long, blob binary"
LATER, OPEN = 0, 1


def _flags(e: np.ndarray, kind: int) -> list[pa.Array]:
    """Entries as flag columns; ranges that touch in one document are joined if they need no hash."""
    if kind == LATER and len(e):
        e = e[np.lexsort((e["at"], e["key"], e["doc"]))]
        at, end = e["at"].astype(np.int64), e["at"].astype(np.int64) + e["n"]
        new = np.ones(len(e), bool)
        new[1:] = (e["doc"][1:] != e["doc"][:-1]) | (e["key"][1:] != e["key"][:-1]) | (at[1:] > end[:-1])
        i = np.flatnonzero(new)
        stop = np.maximum.reduceat(end, i)
        e, at, n = e[i], at[i], stop - at[i]
    else:
        at, n = e["at"], e["n"]
    return [pa.array(e["doc"]), pa.array(e["key"]), pa.array(np.full(len(e), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(e["hash"].view(np.int64) if kind == OPEN else np.zeros(len(e), np.int64))]


def _sorted(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by hash, bytes, position; and which of them repeat the bytes of an earlier one."""
    e = e[np.lexsort((e["at"], e["key"], e["doc"], e["ctx"], e["hash"]))]
    same = np.zeros(len(e), bool)
    same[1:] = (e["hash"][1:] == e["hash"][:-1]) & (e["ctx"][1:] == e["ctx"][:-1])
    # the very same place (repeated rows of one document) is one entry
    once = np.ones(len(e), bool)
    once[1:] = ~(same[1:] & (e["doc"][1:] == e["doc"][:-1]) & (e["key"][1:] == e["key"][:-1]) & (e["at"][1:] == e["at"][:-1]))
    return e[once], same[once]


def _keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """dk: doc_id (null first); tk tells apart rows of one doc_id with other texts."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(F.lit(0).alias("none"), *carry).alias("carry"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID).cast("long")).alias("dk"), F.xxhash64(body).alias("tk"), body.cast("binary").alias("body"))


def _hot_anchors(keyed: DataFrame, width: int) -> np.ndarray:
    """Anchor hashes with at least one HOT_SHARE-th of all entries (and HOT_LEAST of them): few by construction."""

    def run(batches):
        held, rows = [], 0

        def out():
            h = np.sort(np.concatenate(held))
            i = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n = np.diff(np.append(i, len(h)))
            k = n >= 16
            return pa.RecordBatch.from_arrays([pa.array(np.append(h[i[k]].view(np.int64), 0)), pa.array(np.append(n[k], 0).astype(np.int64)), pa.array(np.append(np.zeros(k.sum(), np.int64), len(h)))], names=["hash", "n", "rows"])

        for b in batches:
            for _, h, _, _, _, _, _ in entries(b.column(0).to_pylist(), width):
                held.append(h)
                rows += len(h)
                if rows >= 4 * BUFFER:
                    yield out()
                    held, rows = [], 0
        if rows:
            yield out()

    # rows under 16 in a task's buffer are left out of the counts: at hot sizes that is a small part
    seen = written(keyed.select("body").mapInArrow(tidy(run), "hash long, n long, rows long").groupBy("hash").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).where(f"n >= {HOT_LEAST // 2} OR rows > 0"))
    total = seen.agg(F.sum("rows")).first()[0] or 0
    # a HOT_SHARE-th of all entries each: no more than HOT_SHARE hashes can be that frequent
    hot = seen.where(F.col("n") >= max(HOT_LEAST // 2, total // HOT_SHARE)).select("hash").toArrow()
    return np.sort(np.array(hot["hash"].to_pylist(), np.int64).view(np.uint64))


def _dealer(width: int, buckets: int, hot):
    """Map side of step 2."""

    def run(batches):
        known = hot.value
        held, rows = [], 0

        def deal():
            e, same = _sorted(np.concatenate(held))
            flags = _flags(e[same], LATER)
            k = len(flags[0])
            if k:
                spread = np.arange(k, dtype=np.int32) * 7919 % buckets
                yield pa.RecordBatch.from_arrays([pa.array(spread.astype(np.int32)), *flags, pa.nulls(k, pa.binary())], names=_names(_DEALT))
            e = e[~same]
            b = (e["hash"] % np.uint64(buckets)).astype(np.int32)
            o = np.argsort(b, kind="stable")
            e, b = e[o], b[o]
            i = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, int)
            blobs = [e[x:y].tobytes() for x, y in zip(i, np.append(i[1:], len(b)))]
            z = np.zeros(len(i), np.int64)
            zi = z.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(b[i]), pa.array(z), pa.array(z), pa.array(zi - 1), pa.array(zi), pa.array(zi), pa.array(z), pa.array(blobs, pa.binary())], names=_names(_DEALT))

        for batch in batches:
            dk, tk = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for which, h, ctx, first, n, base, g in entries(batch.column(2).to_pylist(), width):
                if len(known):
                    is_hot = np.isin(h, known)
                    if is_hot.any():
                        k = np.flatnonzero(is_hot)
                        each = np.repeat(k, n[k])
                        s = first[each] + (np.arange(len(each)) - np.repeat(np.cumsum(n[k]) - n[k], n[k]))
                        wh = _window_hash(g, s, s, width)
                        x = np.empty(len(each), _ENTRY)
                        x["hash"], x["ctx"], x["doc"], x["key"], x["at"], x["n"] = wh, mix64(wh ^ g[s + width - GRAM]), dk[which[each]], tk[which[each]], base[each] + s, 1
                        held.append(x)
                        rows += len(x)
                        keep = ~is_hot
                        which, h, ctx, first, n, base = (y[keep] for y in (which, h, ctx, first, n, base))
                x = np.empty(len(h), _ENTRY)
                x["hash"], x["ctx"], x["doc"], x["key"], x["at"], x["n"] = h, ctx, dk[which], tk[which], base + first, n
                held.append(x)
                rows += len(x)
                if rows >= BUFFER:
                    yield from deal()
                    held, rows = [], 0
        if rows:
            yield from deal()

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _meet(batches):
    """Reduce side of step 2: blobs of one bucket after another."""

    def settle(blobs):
        e, same = _sorted(np.concatenate([np.frombuffer(x, _ENTRY) for x in blobs]))
        later = e[same]
        e = e[~same]
        twin = np.zeros(len(e), bool)
        if len(e) > 1:
            eq = e["hash"][1:] == e["hash"][:-1]
            twin[1:] |= eq
            twin[:-1] |= eq
        for part, kind in ((later, LATER), (e[twin], OPEN)):
            if len(part):
                yield pa.RecordBatch.from_arrays(_flags(part, kind), names=_names(_FLAG))

    bucket, blobs = None, []
    for b in batches:
        t = pa.Table.from_batches([b])
        plain = t.filter(pc.greater_equal(t["kind"], 0)).select(_names(_FLAG))
        yield from plain.to_batches()
        t = t.filter(pc.less(t["kind"], 0))
        for k, x in zip(t["bucket"].to_pylist(), t["blob"].to_pylist()):
            if k != bucket and blobs:
                yield from settle(blobs)
                blobs = []
            bucket = k
            blobs.append(x)
    if blobs:
        yield from settle(blobs)


_PART = "hash long, dk long, tk long, at int, n int, part binary"


def _contexts(width: int):
    """Undecided entries with their bytes; windows of crowded anchors singly.  Rows without bytes are settled: later copies."""

    def deal(held):
        e, w = (np.concatenate(x) for x in zip(*held))
        o = np.lexsort((e["at"], e["key"], e["doc"], e["hash"]))
        e, w = e[o], w[o]
        same = np.zeros(len(e), bool)
        same[1:] = (e["hash"][1:] == e["hash"][:-1]) & (w[1:] == w[:-1]).all(axis=1)
        once = np.ones(len(e), bool)  # the very same place (repeated rows of one document) is one window
        once[1:] = (e["hash"][1:] != e["hash"][:-1]) | (e["doc"][1:] != e["doc"][:-1]) | (e["key"][1:] != e["key"][:-1]) | (e["at"][1:] != e["at"][:-1])
        dk, tk, _, at, n, _ = _flags(e[same & once], LATER)
        spread = pa.array(mix64(np.arange(len(at), dtype=np.uint64)).view(np.int64))
        yield pa.RecordBatch.from_arrays([spread, dk, tk, at, n, pa.nulls(len(at), pa.binary())], names=_names(_PART))
        e, w = e[~same], w[~same]
        yield pa.RecordBatch.from_arrays([pa.array(e["hash"].view(np.int64)), pa.array(e["doc"]), pa.array(e["key"]), pa.array(e["at"].astype(np.int32)), pa.array(np.ones(len(e), np.int32)), pa.array([x.tobytes() for x in w], pa.binary())], names=_names(_PART))

    def run(batches):
        held, rows = [], 0
        for b in batches:
            out = [[] for _ in range(6)]
            for d, t, x, ss in zip(*(b.column(i).to_pylist() for i in range(4))):
                for s in ss:
                    part = x[s["at"] : s["at"] + s["n"] - 1 + width]
                    if not s["crowded"]:
                        for c, y in zip(out, (s["hash"], d, t, s["at"], s["n"], part)):
                            c.append(y)
                        continue
                    buf, at = np.frombuffer(part, np.uint8), np.arange(s["n"])
                    e = np.empty(len(at), _ENTRY)
                    e["hash"], e["ctx"], e["doc"], e["key"], e["at"], e["n"] = _window_hash(_gram_hashes(buf), at, at, width), 0, d, t, s["at"] + at, 1
                    held.append((e, np.lib.stride_tricks.sliding_window_view(buf, width)))
                    rows += len(at)
                    if rows >= SPARE:
                        yield from deal(held)
                        held, rows = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=_names(_PART))
        if held:
            yield from deal(held)

    return run


def _suffix_shards(width: int):
    """Step 3: whole groups of one anchor, CHUNK bytes or more at a time."""

    def settle(rows):
        rows = list({r[:4]: r for r in rows}.values())  # repeated rows of one document are one
        parts = [r[5] for r in rows]
        lens = np.array([len(p) for p in parts])
        buf = np.frombuffer(b"".join(parts), np.uint8)
        n = lens - width + 1
        base = np.cumsum(lens) - lens
        which = np.repeat(np.arange(len(rows)), n)
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        dk, tk, at = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        at = at[which] + off
        order = np.empty(len(at), np.int64)
        order[np.lexsort((at, tk[which], dk[which]))] = np.arange(len(at))
        windows = np.lib.stride_tricks.sliding_window_view(buf, width)
        later = later_in_suffix_order(windows[base[which] + off], order)
        e = np.empty(int(later.sum()), _ENTRY)
        e["hash"], e["ctx"], e["n"] = 0, 0, 1
        e["doc"], e["key"], e["at"] = dk[which][later], tk[which][later], at[later]
        return pa.RecordBatch.from_arrays(_flags(e, LATER), names=_names(_FLAG))

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            done = b.filter(pc.is_null(b.column(5)))
            if done.num_rows:
                z = pa.array(np.zeros(done.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([done.column(1), done.column(2), z.cast(pa.int32()), done.column(3), done.column(4), z], names=_names(_FLAG))
            for r in zip(*(b.column(i).to_pylist() for i in range(6))):
                if r[5] is None:
                    continue
                if size >= CHUNK and r[0] != last:
                    yield settle(rows)
                    rows, size = [], 0
                last = r[0]
                rows.append(r)
                size += len(r[5])
        if rows:
            yield settle(rows)

    return run


def _cutter(width: int):
    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                dk, body, spots = (b.column(i).to_pylist() for i in range(3))
                size, spans, kept = [], [], []
                for x, ss in zip(body, spots):
                    merged: list[list[int]] = []
                    for s, e in sorted((s["at"], s["at"] + s["n"] - 1 + width) for s in ss or ()):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    at, left = 0, []
                    for s, e in merged:
                        left.append(x[at:s])
                        at = e
                    left.append(x[at:])
                    size.append(len(x))
                    spans.append([{"start": s, "stop": e} for s, e in merged])
                    kept.append(b"".join(left))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if d == _NULL_ID else d for d in dk], pa.int64()), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept]), b.column(3)],
                    names=["doc_id", "n_bytes", "spans", "kept", "kept_text", "carry"],
                )

    return run


def suffix_dedup(docs: DataFrame, width: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, start <= byte < stop), kept (remaining bytes), kept_text
    (the same as text; the part of a character that a cut leaves goes too), carry (struct of the named columns).

    A null text is empty; texts shorter than the width lose nothing.  A null doc_id sorts before all
    others.  Rows that repeat both doc_id and text count as one document and all get its result; rows
    of one doc_id with different texts are ordered by a hash of the text.  An empty table gives an
    empty table.  Columns other than doc_id and text are not read.
    """
    if width < 2 * GRAM:
        raise ValueError(f"width must be at least {2 * GRAM}")
    spark = docs.sparkSession
    keyed = _keyed(docs, carry)
    parts = partitions(spark)
    buckets = 8 * parts
    hot = spark.sparkContext.broadcast(_hot_anchors(keyed, width))
    dealt = keyed.select("dk", "tk", "body").mapInArrow(tidy(_dealer(width, buckets, hot)), _DEALT)
    flags = written(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_meet), _FLAG))
    hot.destroy()
    undecided = flags.where(f"kind = {OPEN}")
    crowds = undecided.groupBy("hash").agg(F.count("*").alias("m")).where(F.col("m") > GROUP).select("hash", F.lit(True).alias("crowded"))
    crowds = written(crowds)
    crowds = F.broadcast(crowds) if crowds.count() <= CROWDS else crowds
    spot = F.struct("at", "n", "hash", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    undecided = undecided.join(crowds, "hash", "left").groupBy("dk", "tk").agg(F.collect_list(spot).alias("spots"))
    once = keyed.join(undecided, ["dk", "tk"]).select("dk", "tk", "body", "spots", "carry")
    contexts = once.mapInArrow(tidy(_contexts(width)), _PART)
    found = contexts.repartition(parts, "hash").sortWithinPartitions("hash").mapInArrow(tidy(_suffix_shards(width)), _FLAG)
    later = flags.where(f"kind = {LATER}").unionByName(found).groupBy("dk", "tk").agg(F.collect_list(F.struct("at", "n")).alias("spots"))
    kind = keyed.schema["carry"].dataType.simpleString()
    return keyed.join(later, ["dk", "tk"], "left").select("dk", "body", "spots", "carry").mapInArrow(tidy(_cutter(width)), f"doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary, kept_text string, carry {kind}")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier are cut out of the texts; every row stays, if need be with an empty text.

    A null text is empty; a null doc_id comes before all others.  Rows that repeat doc_id and text are one document
    and all keep what it keeps.  Characters that a cut leaves in part go.  n_chars is that of the text that is left.  An
    empty table gives an empty table; columns other than those of ``documents`` are not read.
    """
    out = suffix_dedup(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "carry.lang", "carry.source", F.char_length("kept_text").cast("long").alias("n_chars"))
