"""Approximate nearest neighbours: a forest of random-projection trees and exact reranking.

Largest inner product is turned into nearness by one more component, sqrt(M^2 - |x|^2), where M is
the largest norm.  A tree splits by one random direction a level (orthogonal to those above it), at the
median of the node's sample rows; levels deeper than the sample reaches split at the level's median.
Trees are as deep as LEAF vectors a leaf ask for, so leaves do not grow with the table.  A query walks
all trees through one shared priority queue.  A node's priority is the likelihood that a neighbour of the
query lies in it: each split on the way adds -log of the chance to fall on that side, which depends on the
query's margin and on how alike neighbours are in the sample.  Members of the leaves met are scored
exactly, in double precision, on the original vectors.

Equal vectors form one class that stands for its smallest ids, so copies never crowd a leaf.  Leaves
meet queries in cells (a subtree's leaves).  A cell's points are held by one task and its queries streamed;
only cells with more points or queries than a block are dealt to several tasks.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import partitions, tidy, written

#: Vectors that the trees are fitted on, at most; pairs of them tell how alike neighbours are.
SAMPLE = 16_384
PAIRS = 256
TREES = 8
#: Least vectors of a leaf on average, and least sample rows of a node that is split at its own median.
LEAF = 16
OWN = 8
#: A query meets leaves of about MET * n ** GROWTH vectors in all.  Recall and the share of the table scored: README.
MET = 8.8
GROWTH = 0.72
#: Vectors of a cell, about; most points and most queries that one task meets in a cell.
CELL = 1 << 15
BLOCK = 1 << 16
#: A table of crowded cells is sent to all tasks up to this many rows; a larger one is met by hash.
CROWDS = 1 << 17


class Forest:
    """Random-projection trees over augmented vectors; nodes are numbered as in a heap, from 1."""

    def __init__(self, sample: np.ndarray, top: float, n: int, k: int, trees: int = TREES, seed: int = 11) -> None:
        self.top, self.trees = top, trees
        self.depth = max(0, int(math.log2(max(1, n) / LEAF))) if n > LEAF else 0
        self.own = min(self.depth, max(0, int(math.log2(max(1, len(sample)) / OWN))))
        self.bits = min(self.depth, max(0, math.ceil(math.log2(max(1, n) / CELL))))  # levels above a cell
        x = self.augment(sample)
        rng = np.random.default_rng(seed)
        dim = x.shape[1]
        self.dirs = np.concatenate([np.linalg.qr(rng.standard_normal((trees, dim, dim)))[0].transpose(0, 2, 1) for _ in range(self.depth // dim + 1)], axis=1)[:, : self.depth]
        side = np.einsum("nd,tld->tln", x, self.dirs)
        self.level = np.median(side, axis=2)
        spread = side.std(axis=2)
        self.dirs /= np.where(spread > 0, spread, 1.0)[:, :, None]
        self.level /= np.where(spread > 0, spread, 1.0)
        side /= np.where(spread > 0, spread, 1.0)[:, :, None]
        self.cuts = np.zeros((trees, 1 << self.own))
        for t in range(trees):
            node = np.ones(len(x), np.int64)
            for lev in range(self.own):
                order = np.argsort(node, kind="stable")
                ends = np.searchsorted(node[order], np.arange(1 << lev, (2 << lev) + 1))
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                    self.cuts[t, (1 << lev) + i] = np.median(side[t, lev, order[a:b]]) if b > a else self.level[t, lev]
                node = 2 * node + (side[t, lev] >= self.cuts[t, node])
        self.steep = 1.702 * self._alike(x, k)

    def _alike(self, x: np.ndarray, k: int) -> float:
        """c / sqrt(1 - c^2) for the mean cosine c, about the mean, of sample rows and their k nearest by inner product."""
        q = x[:PAIRS].copy()
        q[:, -1] = 0.0
        if len(x) < 3:
            return 1.0
        s = q @ x.T
        s[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argpartition(-s, min(k, len(x) - 2), axis=1)[:, :k]
        z = x - x.mean(axis=0)
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
        c = float(np.clip(np.einsum("id,ikd->ik", z[: len(q)], z[near]).mean(), 0.05, 0.95))
        return c / math.sqrt(1 - c * c)

    def augment(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0.0))
        return np.column_stack((x, rest))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows) leaf numbers."""
        a = self.augment(x)
        out = np.empty((self.trees, len(a)), np.int64)
        for t in range(self.trees):
            node = np.ones(len(a), np.int64)
            for lev in range(self.depth):
                cut = self.cuts[t, node] if lev < self.own else self.level[t, lev]
                node = 2 * node + (a @ self.dirs[t, lev] >= cut)
            out[t] = node - (1 << self.depth)
        return out

    def search(self, q: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The first ``probes`` (tree, leaf) that one queue over all trees yields for a query."""
        length = math.sqrt(float(q @ q))
        side = self.dirs[:, :, :-1] @ (q * (self.top / length if length else 0.0))  # a query's length does not matter
        levels = np.frexp(np.arange(1, 1 << self.own))[1] - 1 if self.own else np.zeros(0, np.int64)
        margin = np.zeros_like(self.cuts)
        margin[:, 1:] = side[:, levels] - self.cuts[:, 1:]
        left, right = (np.logaddexp(0, s * self.steep * margin).tolist() for s in (1, -1))
        deep = side - self.level
        deep_left, deep_right = (np.logaddexp(0, s * self.steep * deep).tolist() for s in (1, -1))
        own, first = 1 << self.own, 1 << self.depth
        heap = [(0.0, t, 1) for t in range(self.trees)]
        out: list[tuple[int, int]] = []
        push, swap = heapq.heappush, heapq.heappushpop
        while heap and len(out) < probes:
            cost, t, node = heapq.heappop(heap)
            while node < first:
                if node < own:
                    a, b = left[t][node], right[t][node]
                else:
                    lev = node.bit_length() - 1
                    a, b = deep_left[t][lev], deep_right[t][lev]
                if a <= b:
                    push(heap, (cost + b, t, 2 * node + 1))
                    cost, t, node = swap(heap, (cost + a, t, 2 * node))
                else:
                    push(heap, (cost + a, t, 2 * node))
                    cost, t, node = swap(heap, (cost + b, t, 2 * node + 1))
            out.append((t, node - first))
        return out


def probes_for(n: int, depth: int, trees: int = TREES) -> int:
    """Leaves that a query meets among n distinct vectors in trees of that depth."""
    return max(trees, math.ceil(MET * n ** (GROWTH - 1) * (1 << depth)))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).astype(np.float64).reshape(-1, dim)


_ROW = "cell long, kind int, id long, leaves binary, raw binary"
_KEYS = ["cell", "pb", "qb"]


def _batch(cell, kind, ids, leaves, raw) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array([kind] * len(cell), pa.int32()), pa.array(ids, pa.int64()), pa.array(leaves, pa.binary()), pa.array(raw, pa.binary())], names=["cell", "kind", "id", "leaves", "raw"])


def _index(sent, dim: int, store: str):
    """A row for each point and tree: its cell, its leaf in the cell."""

    def run(batches):
        f = sent.value
        low = f.depth - f.bits
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                b = whole.slice(k, 4096)
                x = _matrix(b.column(1), dim)
                raw = [r.tobytes() for r in x.astype(store)]
                for t, leaf in enumerate(f.leaves(x)):
                    yield _batch((t << f.bits) + (leaf >> low), 0, b.column(0), [v.tobytes() for v in (leaf & ((1 << low) - 1)).astype("<i4")], raw)

    return run


def _points_of_cells(sent, dim: int):
    """(cell, points), summed up by batch."""

    def run(batches):
        f = sent.value
        for b in batches:
            cell, n = np.unique((f.leaves(_matrix(b.column(1), dim)) >> (f.depth - f.bits)) + (np.arange(f.trees) << f.bits)[:, None], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    return run


def _probe(sent, dim: int, store: str, probes: int):
    """A row for each query and cell that it meets: the leaves in the cell."""

    def run(batches):
        f = sent.value
        low = f.depth - f.bits
        for b in batches:
            out: list[list] = [[], [], [], []]
            for i, q in zip(b.column(0).to_pylist(), _matrix(b.column(1), dim)):
                by: dict[int, list[int]] = {}
                for t, leaf in f.search(q, probes):
                    by.setdefault((t << f.bits) + (leaf >> low), []).append(leaf & ((1 << low) - 1))
                raw = q.astype(store).tobytes()
                for cell, leaves in by.items():
                    for c, v in zip(out, (cell, i, np.array(leaves, "<i4").tobytes(), raw)):
                        c.append(v)
                if len(out[0]) >= 8192:
                    yield _batch(out[0], 1, *out[1:])
                    out = [[], [], [], []]
            yield _batch(out[0], 1, *out[1:])

    return run


class _Cell:
    """Points of a cell by leaf, and the best of each query among the leaves it asks for."""

    def __init__(self, ids: list[int], leaves: list[bytes], raw: list[bytes], dim: int, store: str, most: int) -> None:
        leaf = np.frombuffer(b"".join(leaves), "<i4").astype(np.int64)
        order = np.lexsort((np.array(ids, np.int64), leaf))
        self.ids, self.x, self.dim, self.store, self.most = np.array(ids, np.int64)[order], np.frombuffer(b"".join(raw), store).astype(np.float64).reshape(-1, dim)[order], dim, store, most
        self.ends = np.searchsorted(leaf[order], np.arange((leaf.max() if len(leaf) else 0) + 2))
        self.eps = 1e-9 * max(1e-300, float(np.abs(self.x).max(initial=0.0)) ** 2 * dim)

    def ask(self, ids: list[int], leaves: list[bytes], raw: list[bytes]):
        """(query, point, score) rows: the ``most`` best of each query here, ties to the smaller id."""
        q = np.frombuffer(b"".join(raw), self.store).astype(np.float64).reshape(-1, self.dim)
        wanted = [np.frombuffer(x, "<i4") for x in leaves]
        who = np.repeat(np.arange(len(ids)), [len(w) for w in wanted])
        leaf = np.concatenate(wanted).astype(np.int64)
        order = np.argsort(leaf, kind="stable")
        who, leaf = who[order], leaf[order]
        starts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
        least = np.full(len(q), -np.inf)
        held: list[tuple] = []
        size = 0

        def best(r, c, s):
            o = np.lexsort((-s, r))
            r, c, s = r[o], c[o], s[o]
            begin = np.searchsorted(r, np.arange(len(q) + 1))
            full = np.flatnonzero(np.diff(begin) >= self.most)
            least[full] = s[begin[full] + self.most - 1] - self.eps
            keep = s >= least[r]  # the sums of a product may differ in their last bits: near ties are kept until they are exact
            r, c = r[keep], c[keep]
            s = np.empty(len(r))
            for k in range(0, len(r), 8192):  # the same sum wherever the pair is met
                s[k : k + 8192] = np.einsum("ij,ij->i", q[r[k : k + 8192]], self.x[c[k : k + 8192]])
            o = np.lexsort((self.ids[c], -s, r))
            r, c, s = r[o], c[o], s[o]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < self.most
            return r[keep], c[keep], s[keep]

        for a, b in zip(starts, np.append(starts[1:], len(leaf))):
            lo, hi = (self.ends[leaf[a]], self.ends[leaf[a] + 1]) if leaf[a] + 1 < len(self.ends) else (0, 0)
            if lo == hi:
                continue
            for k in range(a, b, 256):
                own = who[k : min(k + 256, b)]
                for m in range(lo, hi, 4096):
                    s = q[own] @ self.x[m : min(m + 4096, hi)].T
                    r, c = np.nonzero(s >= least[own][:, None])
                    held.append((own[r], c + m, s[r, c]))
                    size += len(r)
                    if size >= 1 << 17:
                        held = [best(*(np.concatenate(z) for z in zip(*held)))]
                        size = 0
        if held:
            r, c, s = best(*(np.concatenate(z) for z in zip(*held)))
            yield np.array(ids, np.int64)[r], self.ids[c], s


def _rerank(dim: int, store: str, most: int):
    """Rows of one cell after another, its points first."""

    def run(batches):
        last, points, cell = None, [], None
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                b = whole.slice(k, 2048)
                keys = np.array([np.asarray(b.column(i)) for i in range(3)]).T
                kind = np.asarray(b.column(3))
                edge = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1) | (kind[1:] != kind[:-1])))
                for x, y in zip(edge, np.append(edge[1:], len(kind))):
                    if tuple(keys[x]) != last:
                        last, points, cell = tuple(keys[x]), [], None
                    rows = [b.column(i).slice(x, y - x).to_pylist() for i in (4, 5, 6)]
                    if kind[x] == 0:
                        points.append(rows)
                    elif points:
                        if cell is None:
                            cell = _Cell(*(sum(z, []) for z in zip(*points)), dim, store, most)
                        for q, p, s in cell.ask(*rows):
                            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(p), pa.array(s)], names=["qid", "cid", "score"])

    return run


def _found(classes: DataFrame, lookups: DataFrame, forest, dim: int, store: str, probes: int, most: int) -> DataFrame:
    """(qid, cid, score, r): the ``most`` best classes that each lookup finds, r from 1."""
    spark = classes.sparkSession
    asks = written(lookups.repartition(partitions(spark), "qid").mapInArrow(tidy(_probe(forest, dim, store, probes)), _ROW))
    points = classes.select("cid", "e")
    sizes = points.mapInArrow(tidy(_points_of_cells(forest, dim)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("p"))
    sizes = sizes.join(asks.groupBy("cell").agg(F.count("*").alias("q")), "cell")
    parts = lambda c: F.ceil(F.col(c) / F.lit(float(BLOCK))).cast("int")
    crowds = written(sizes.where((F.col("p") > BLOCK) | (F.col("q") > BLOCK)).select("cell", parts("p").alias("ps"), parts("q").alias("qs")))
    crowds = F.broadcast(crowds) if crowds.count() <= CROWDS else crowds

    def dealt(rows: DataFrame, own: str, parts_own: str, other: str, parts_other: str) -> DataFrame:
        """Own block by a hash of the id; every block of the other side."""
        rows = rows.join(crowds, "cell", "left").withColumn(own, F.pmod(F.xxhash64("id"), F.coalesce(parts_own, F.lit(1))).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(parts_other, F.lit(1)) - 1))).select(*_KEYS, "kind", "id", "leaves", "raw")

    both = dealt(points.mapInArrow(tidy(_index(forest, dim, store)), _ROW), "pb", "ps", "qb", "qs").unionByName(dealt(asks, "qb", "qs", "pb", "ps"))
    met = both.repartition(partitions(spark), *_KEYS).sortWithinPartitions(*_KEYS, "kind").mapInArrow(tidy(_rerank(dim, store, most)), "qid long, cid long, score double")
    met = met.groupBy("qid", "cid").agg(F.max("score").alias("score"))
    return met.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))).where(F.col("r") <= most)


def nearest(vectors: DataFrame, queries: str, k: int = 20, trees: int = TREES, probes: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found by inner product.

    ``vectors``: vec_id, embedding; ``queries``: an SQL condition on vec_id.  A query's own id is no
    candidate; with fewer than k candidates all are returned, and with k or more always k (a query whose leaves
    hold fewer is searched again with more leaves).  Ties go to the smaller vec_id.  Vectors
    that are null, zero, hold null or non-finite components, have no id, or have another length than
    the most common one take no part; repeated rows count once.  Empty input gives an empty table.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    store = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id IS NOT NULL AND e IS NOT NULL").where(~bad & F.exists("e", lambda x: x != 0))
    common = base.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common.d
    base = base.where(F.size("e") == dim)
    # a class of equal vectors is known by its k + 1 smallest ids: no query needs more of them
    ranked = base.withColumn("r", F.dense_rank().over(Window.partitionBy("e").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    members = F.array_sort(F.collect_set("vec_id"))
    classes = written(ranked.groupBy("e").agg(members.alias("ids")).select(F.col("ids")[0].alias("cid"), "e", "ids"))
    n, top = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)))).first()
    picked = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("e").toArrow()
    fitted = Forest(_matrix(pa.chunked_array(picked["e"]).combine_chunks(), dim), top, n, k, trees)
    forest, all_leaves = spark.sparkContext.broadcast(fitted), trees << fitted.depth
    probes = min(all_leaves, probes or probes_for(n, fitted.depth, trees))
    # queries of equal vectors are searched once
    asked = base.where(queries).select("e", "vec_id").distinct()
    lookups = written(asked.groupBy("e").agg(F.min("vec_id").alias("qid")).select("qid", "e"))
    best = written(_found(classes, lookups, forest, dim, store, probes, k + 1))
    enough = min(k + 1, n)
    while probes < all_leaves:
        few = written(lookups.join(best.groupBy("qid").agg(F.count("*").alias("m")).where(F.col("m") >= enough), "qid", "left_anti"))
        if few.isEmpty():
            break
        probes = min(all_leaves, 8 * probes)
        best = written(best.join(few, "qid", "left_anti").unionByName(_found(classes, few, forest, dim, store, probes, k + 1)))
    near = best.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    full = asked.join(lookups.withColumnRenamed("e", "f"), F.col("e") == F.col("f")).select("qid", F.col("vec_id").alias("query_id")).join(lists, "qid")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return full.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")
