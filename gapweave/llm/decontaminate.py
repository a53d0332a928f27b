"""Benchmark decontamination by greedy string tiling.

Seeds of ``seed`` words that a text shares with a benchmark item are joined through a hash table;
the stretches that seeds cover hold every common run of that length.  Over them, running
Karp-Rabin tiling marks the longest runs first, never overlapping: windows of a length are hashed,
equal windows are extended as far as they go, and the length is lowered step by step to the seed
length.  A text is contaminated by an item when its tiles cover the given share of the item's
words, in whatever order they stand.

The benchmark is read in blocks of at most BLOCK_BYTES of text; each block is broadcast (a size
known by construction) and met with all texts.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, tidy, written
from .words import shingles, slabs, word_hashes

#: Bytes of benchmark text in one block; its index takes about four times as much in each Python worker.
BLOCK_BYTES = 16 << 20
_BITS = 22


def tile(text: list[int], item: list[int], least: int, gap: int = 0) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in text, place in item, length) of the tiles, longest first.

    ``text`` and ``item`` are word hashes; the value ``gap`` in text matches nothing.  Ties go to the
    earlier place in the item, then in the text.
    """
    in_text, in_item = [w == gap for w in text], [False] * len(item)
    tiles: list[tuple[int, int, int]] = []
    base, mod = 1_000_003, (1 << 61) - 1

    def windows(words, used, s):
        """(start, Karp-Rabin hash) of the windows of s words that no tile touches."""
        top = pow(base, s - 1, mod)
        h = n = 0
        for i, w in enumerate(words):
            if used[i]:
                h = n = 0
                continue
            if n == s:
                h = (h - words[i - s] % mod * top) % mod
                n -= 1
            h = (h * base + w % mod) % mod
            n += 1
            if n == s:
                yield i - s + 1, h

    size = max(least, min(len(item), len(text)))
    while size >= least:
        table: dict[int, list[int]] = {}
        for i, h in windows(item, in_item, size):
            table.setdefault(h, []).append(i)
        found = []
        for t, h in windows(text, in_text, size):
            for i in table.get(h, ()):
                n = 0
                while t + n < len(text) and i + n < len(item) and not in_text[t + n] and not in_item[i + n] and text[t + n] == item[i + n]:
                    n += 1
                if n >= size:
                    found.append((-n, i, t))
        if found and -min(found)[0] > size:  # begin anew at the longest
            longest = -min(found)[0]
            if longest > 2 * size:
                size = longest
                continue
        for n, i, t in sorted(found):
            n = -n
            if not any(in_item[i : i + n]) and not any(in_text[t : t + n]):
                in_item[i : i + n] = [True] * n
                in_text[t : t + n] = [True] * n
                tiles.append((t, i, n))
            else:  # what an earlier tile has left of it, if still long enough
                while n >= size and (in_item[i] or in_text[t]):
                    n, i, t = n - 1, i + 1, t + 1
                m = 0
                while m < n and not in_item[i + m] and not in_text[t + m]:
                    m += 1
                if m >= size:
                    in_item[i : i + m] = [True] * m
                    in_text[t : t + m] = [True] * m
                    tiles.append((t, i, m))
        if all(in_item):
            break
        size = size // 2 if size > 2 * least else size - 1
    return tiles


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], seed: int) -> None:
        self.seed = seed
        self.ids = [i for i, _ in items]
        h, off = word_hashes([t for _, t in items])
        self.words = [h[a:b] for a, b in zip(off[:-1], off[1:])]
        s = shingles(h, seed)
        owner = np.repeat(np.arange(len(items)), np.diff(off))[: len(s)]
        at = np.arange(len(s)) - off[owner]
        ok = at + seed <= np.diff(off)[owner]
        s, owner, at = s[ok], owner[ok], at[ok]
        o = np.argsort(s, kind="stable")
        self.hash, self.owner, self.at = s[o], owner[o].astype(np.int32), at[o].astype(np.int32)
        self.flag = np.zeros(1 << _BITS, bool)
        self.flag[self.hash >> np.uint64(64 - _BITS)] = True
        # items shorter than a seed: by their number of words, the hash of the whole item
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(self.words):
            if 0 < len(w) < seed:
                self.short.setdefault(len(w), {}).setdefault(int(shingles(w, len(w))[0]), []).append(i)

    def matches(self, texts: list[str | None], share: float):
        """Yield (text number, item number, tiles, item words, text words) of contaminated texts."""
        k = self.seed
        for a, b in slabs(texts):
            h, off = word_hashes(texts[a:b])
            for n, items in self.short.items():
                s = shingles(h, n)
                p = np.flatnonzero(np.isin(s, np.fromiter(items, np.uint64, len(items))))
                text = np.searchsorted(off, p, "right") - 1
                met = set()
                for x, y in zip(p[p + n <= off[text + 1]].tolist(), text[p + n <= off[text + 1]].tolist()):
                    for i in items[int(s[x])]:
                        if (y, i) not in met:
                            met.add((y, i))
                            yield a + y, i, [(x - int(off[y]), 0, n)], n
            s = shingles(h, k)
            p = np.flatnonzero(self.flag[s >> np.uint64(64 - _BITS)])
            lo, hi = np.searchsorted(self.hash, s[p], "left"), np.searchsorted(self.hash, s[p], "right")
            n = hi - lo
            place = np.repeat(p, n)
            seed = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text = np.searchsorted(off, place, "right") - 1
            ok = place + k <= off[text + 1]
            place, seed, text = place[ok], seed[ok], text[ok]
            item = self.owner[seed]
            o = np.lexsort((place, item, text))
            place, seed, text, item = place[o], seed[o], text[o], item[o]
            new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))) if len(text) else []
            for x, y in zip(new, np.append(new[1:], len(text))):
                words = self.words[item[x]]
                hit = np.zeros(len(words) + 1, np.int64)  # no more than these words can be tiled
                np.add.at(hit, self.at[seed[x:y]], 1)
                np.subtract.at(hit, self.at[seed[x:y]] + k, 1)
                if np.count_nonzero(np.cumsum(hit)[:-1]) < share * len(words):
                    continue
                # stretches of the text that seeds cover, kept apart by a gap
                places = np.unique(place[x:y])
                stretch, spot, last = [], [], -1
                for q in places.tolist():
                    if last >= 0 and q > last:
                        stretch.append(0)
                        spot.append(-1)
                    for w in range(max(q, last), q + k):
                        stretch.append(int(h[w]))
                        spot.append(w - int(off[text[x]]))
                    last = q + k
                tiles = tile(stretch, words.tolist(), k)
                if sum(t[2] for t in tiles) >= share * len(words):
                    yield a + int(text[x]), int(item[x]), sorted((spot[t], i, n) for t, i, n in tiles), len(words)


_SCHEMA = "doc_id long, item_id long, n_tiles long, n_matched long, n_words long, coverage double, tiles array<struct<text_word:long,item_word:long,words:long>>"


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """Lists of (item_id, text) of at most ``limit`` bytes each (one longer item is a block of its own).

    Items are dealt to blocks by a running sum over ranges of item_id, and each block is read when
    its turn comes, so the driver never holds more than one.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where("item_id IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // limit) + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        block, size = [], 0
        for r in (items if n == 1 else items.where(part == k)).toLocalIterator():
            if block and size + len(r.text) > 2 * limit:
                yield block
                block, size = [], 0
            block.append((r.item_id, r.text))
            size += len(r.text)
        if block:
            yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, seed: int = 5) -> DataFrame:
    """One row per document and benchmark item whose words the document's tiles cover to ``share`` or more.

    Words are lower-cased runs of letters and digits.  An item with fewer words than a seed is matched
    whole, as one run.  Null and empty texts and items match nothing, nor do items with a null item_id.
    Repeated documents and repeated items give
    repeated rows.  Empty tables give an empty table.  Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in blocks(benchmark):
        index = spark.sparkContext.broadcast(items)

        def run(batches, index=index):
            ready = Index(index.value, seed)
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                rows = []
                for t, i, tiles, n in ready.matches(texts, share):
                    m = sum(x[2] for x in tiles)
                    rows.append({"doc_id": ids[t], "item_id": ready.ids[i], "n_tiles": len(tiles), "n_matched": m, "n_words": n, "coverage": m / n, "tiles": [{"text_word": a, "item_word": c, "words": d} for a, c, d in tiles]})
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

        part = base.mapInArrow(tidy(run), _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _SCHEMA) if out is None else out


_L = pa.int64()
_ARROW = pa.schema([("doc_id", _L), ("item_id", _L), ("n_tiles", _L), ("n_matched", _L), ("n_words", _L), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("text_word", _L), ("item_word", _L), ("words", _L)])))])


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, seed: int = 5, limit: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that no benchmark item contaminates.

    Each row is judged by its own text, and rows that share a doc_id (or have none) do not decide for each other.
    Null and empty texts stay.  A benchmark of one block of ``limit`` bytes is met with the rows where they lie: nothing
    is exchanged.  With more blocks the rows are written once, each block names the rows that it contaminates, and
    these are left out; so a task never holds more than one block.
    """
    spark, col = docs.sparkSession, docs.columns.index("text")

    def judge(items, mark):
        index = spark.sparkContext.broadcast(items)

        def run(batches):
            ready = Index(index.value, seed)
            for b in batches:
                stays = np.ones(b.num_rows, bool)
                stays[[m[0] for m in ready.matches(b.column(0 if mark else col).to_pylist(), share)]] = False
                yield pa.RecordBatch.from_arrays([b.column(1)], names=["_row"]).filter(pa.array(~stays)) if mark else b.filter(pa.array(stays))

        return tidy(run)

    all_blocks = blocks(benchmark, limit or BLOCK_BYTES)
    first, second = next(all_blocks, None), next(all_blocks, None)
    if first is None:
        return docs
    if second is None:
        return docs.mapInArrow(judge(first, False), docs.schema)
    rows = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.monotonically_increasing_id().alias("_row")))
    texts = rows.select(F.col("_all.text").alias("text"), "_row")
    found = written(texts.mapInArrow(judge(first, True), "_row long"))
    for items in chain([second], all_blocks):
        found = written(found.unionByName(texts.mapInArrow(judge(items, True), "_row long")).distinct())
    return rows.join(small(found), "_row", "left_anti").select("_all.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item contaminates go; the others keep their rows as they are.

    Each row is judged by its own text: null and empty texts stay, repeated rows share a fate, and rows that share a
    doc_id, or have none, do not decide for each other.  Empty tables give an empty table, or all rows; columns other
    than those of ``documents`` are not read.
    """
    return clean(docs.select("doc_id", "text", "lang", "source", "n_chars"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
