"""SimHash near-duplicate groups: 64-bit fingerprints linked through BK-trees.

Fingerprints of documents are made in Arrow batches.  Distinct fingerprints (each stands for all
its copies, so copies never meet in one group) are dealt to shards by the pigeonhole rule: when
two fingerprints differ in at most ``radius`` bits and the 64 bits are cut into ``blocks`` > radius
pieces, at least ``blocks - radius`` pieces agree, so they share the shard named by some choice of
that many pieces.  Each shard builds a BK-tree (children keyed by their integer Hamming distance to
the parent) and a lookup follows only edges within the radius.  A shard keeps links that join two
of its classes (a spanning forest), not all pairs; nothing is lost for components.

The shard trees live where their rows are instead of being broadcast: trees over all fingerprints
grow with the corpus and have no proven bound.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, discard, partitions, small, tidy, written

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Largest number of fingerprints that one BK-tree holds; larger shards are dealt as pairs of parts.
TREE_ROWS = 4096
#: The pipeline's stage: words of a shingle, Jaccard similarity from which documents are linked, and bands of
#: MinHash values.  A pair at exactly that similarity shares a band with probability 1 - (1 - 0.8^5)^30 = 0.999993.
WORDS, LEAST, BANDS, ROWS = 5, 0.8, 30, 5
#: Members of a band that are compared pair by pair; members of a refined cell, outside its largest component, that are
#: compared with all others.
PAIRS, FEW = 8, 256
#: Times that a crowded band is refined before its members are compared pair by pair.
DEPTH = 3
#: Bits in which fingerprints differ at most that are compared first.
RADIUS = 4
_ODD = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every word shingle: lower-cased A-Z, words split on ASCII white space; fewer words are one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    h64 = xxhash.xxh64_intdigest
    n = len(parts) - words + 1
    line = b" ".join(parts)
    if n < 1:
        return np.array([h64(line, 42)] if parts else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return np.fromiter([h64(line[s:e], 42) for s, e in zip(starts, stops)], np.uint64, n)


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit SimHash over all shingles of a whole text, repeats included; zero without words."""
    return _majority(_hashes(text, words))


def _majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    n = len(h)
    # bit counts by slabs: a very long text never unpacks all its bits at once
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        part = h[k : k + 65536]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long.  A null text counts as empty: zero."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tidy(run), "doc_id long, fp long")


class BKTree:
    """Burkhard-Keller tree over integers under Hamming distance."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int, item: int) -> None:
        if self.root is None:
            self.root = [value, item, {}]
            return
        node = self.root
        while True:
            d = (value ^ node[0]).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = [value, item, {}]
                return
            node = child

    def within(self, value: int, radius: int):
        """(distance, item) of all values within the radius; only edges d - radius .. d + radius are followed."""
        todo = [self.root] if self.root is not None else []
        while todo:
            v, item, kids = todo.pop()
            d = (value ^ v).bit_count()
            if d <= radius:
                yield d, item
            for k, child in kids.items():
                if d - radius <= k <= d + radius:
                    todo.append(child)


def _links(values: list[int], reps: list[int], sides: list[int], radius: int):
    """A spanning forest of the links of one cell; sides 2 and 3 mark the parts of a split shard."""
    up = list(range(len(values)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    tree = BKTree()
    for i, v in enumerate(values):
        for _, j in tree.within(v, radius):
            if sides[i] == sides[j] and sides[i] != 0:
                continue  # that pair is met in the part's own cell
            a, b = top(i), top(j)
            if a != b:
                up[a] = b
                yield reps[i], reps[j]
        tree.add(v, i)


def near_links(classes: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(a, b) edges between class representatives whose fingerprints differ in 1..radius bits.

    ``classes``: (fp long, rep long), one row per distinct fingerprint.  Blocks are chosen by the
    number of classes so that shards stay small; any choice finds every link.
    """
    spark = classes.sparkSession
    if blocks is None:
        n, blocks = classes.count(), radius + 1
        while blocks < radius + 4 and n > 64 << (64 * (blocks - radius) // blocks):
            blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = classes.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("tbl"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])).alias("s")).select("s.tbl", "s.key", "fp", "rep")
    size = shards.groupBy("tbl", "key").agg(F.count("*").alias("n")).where("n > 1")
    part = F.ceil(F.col("n") / F.lit(TREE_ROWS)).cast("int")
    own = F.pmod(F.xxhash64("fp"), part).cast("int")
    # cell (p, q), p <= q, of a shard in parts; a shard of one part has the one cell (0, 0)
    cells = (
        shards.join(size, ["tbl", "key"]).withColumn("parts", part).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("tbl", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 2).otherwise(3).alias("side"), "fp", "rep")
    )
    keys = ["tbl", "key", "p", "q"]

    def run(batches):
        last, values, reps, sides = None, [], [], []
        for b in batches:
            c = [b.column(i).to_pylist() for i in range(7)]
            out_a, out_b = [], []
            for *k, side, fp, rep in zip(*c):
                if k != last:
                    if len(values) > 1:
                        for x, y in _links(values, reps, sides, radius):
                            out_a.append(x)
                            out_b.append(y)
                    last, values, reps, sides = k, [], [], []
                values.append(fp & 0xFFFFFFFFFFFFFFFF)
                reps.append(rep)
                sides.append(side)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
        if len(values) > 1:
            found = list(_links(values, reps, sides, radius))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    dealt = cells.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "fp").select(*keys, "side", "fp", "rep")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included).

    Null and empty texts have fingerprint zero and are linked like any other.  A null doc_id keeps
    its row, takes no part in links, and has a null component unless an equal or near text has one.
    Repeated rows each keep their row.  An empty table gives an empty table.  Other columns of
    ``docs`` are not read.
    """
    fps = cut(fingerprints(docs, words))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"))
    comps = connected_components(near_links(classes, radius))
    named = classes.join(comps, classes.rep == comps.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, sorted; a shorter text is one shingle, an empty one has none."""
    return np.unique(_hashes(text, words))


def _sketch(text: str | None, words: int = WORDS) -> tuple[np.ndarray, int]:
    """The set of shingles and the fingerprint of a text."""
    h = _hashes(text, words)
    return np.unique(h), _majority(h)


def band_keys(shingles: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of MinHash values; a set without shingles has none."""
    if not len(shingles):
        return []
    least = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[k : k + 4096, None] * _ODD[None]).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(least.reshape(BANDS, ROWS))]


def _only(sets: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The sets that written pairs name."""
    named = written(pairs.select(F.col(a).alias("node")).distinct().unionByName(pairs.select(F.col(b).alias("node")).distinct()))
    return sets.join(small(named), "node", "left_semi")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``least`` or more.  ``sets``: node, s (distinct)."""
    pairs = written(pairs)
    sets = _only(sets, pairs, "a", "b")
    # b first: a is often the same pivot, and rows that carry a set show the join how uneven they are
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    both = one.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                a, b, x, y = whole.slice(k, 512).columns
                ok = np.zeros(len(a), bool)
                for i in range(len(a)):
                    u, v = x[i].values.to_numpy(zero_copy_only=False), y[i].values.to_numpy(zero_copy_only=False)
                    common = len(np.intersect1d(u, v, assume_unique=True))
                    ok[i] = common >= least * (len(u) + len(v) - common)
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok))

    links = written(both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long"))
    discard(pairs)
    return links


def _refined(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Cells (key, node, n, most) in which any two similar members of a pivot's group meet, though not by the pivot's shingles.

    ``members``: pivot, node.  ``most`` bounds the sizes, together, of two similar sets that meet there first.  Shingles are ordered: those that the pivot lacks first, by their hash.  If two
    sets are similar, they share least / (1 + least) of both sizes together, and the first shingle they share is
    among the first n - least * n + 1 of both.  Either the pivot lacks it, and they meet in the cell of that shingle,
    where no more than what follows it in each is shared; or they share only shingles of the pivot, no more than each
    has of them, which bounds the other's size: they meet in a cell of equal sizes (to 2 %).
    """
    sets = _only(sets, members, "pivot", "node")
    one = members.join(sets.select("node", F.col("s").alias("x")), "node")
    both = one.join(sets.select(F.col("node").alias("pivot"), F.col("s").alias("y")), "pivot")

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                out: list[list] = [[], [], [], [], [], []]
                for pivot, node, x, y in zip(*(c if i > 1 else c.to_pylist() for i, c in enumerate(b.columns))):
                    u, v = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                    own = u[~np.isin(u, v, assume_unique=True)]
                    n, a = len(u), len(u) - len(own)
                    first = n - math.ceil(least * n - 1e-9) + 1
                    where = [(0, h, (n - i) * (1 + least) / least + 1e-9) for i, h in enumerate(own[:first].tolist())]
                    if len(own) < first:
                        both_most = a * (1 + least) / least + 1e-9
                        sizes = {_bucket(n)}
                        if a < least * (n + len(v) - a) and both_most - n >= least * n:  # not linked to the pivot
                            sizes.update(range(_bucket(least * n), _bucket(both_most - n) + 1))
                        where += [(1, q, both_most) for q in sorted(sizes)]
                    for kind, value, top in where:
                        for c, z in zip(out, (pivot, kind, value, node, n, top)):
                            c.append(z)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.float64())], names=["pivot", "kind", "value", "node", "n", "most"])

    rows = both.select("pivot", "node", "x", "y").mapInArrow(tidy(run), "pivot long, kind long, value long, node long, n long, most double")
    return rows.select(F.xxhash64("pivot", "kind", "value").alias("key"), "node", "n", "most")


def _bucket(size: float) -> int:
    """Sizes that differ by about 2 %."""
    return int(math.log(max(size, 1.0)) * 50)


def similar_links(classes: DataFrame, texts: DataFrame, hints: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join all classes whose sets have a Jaccard similarity of ``least`` or more, directly or through
    others, and the components (of, component) that a part of them makes: those and the rest, in terms of components.

    ``classes``: node, n (shingles), keys (of the bands); ``texts``: node, text; ``hints``: pairs (a, b) that may well be
    similar.  Classes that share a band meet in a cell.  Each cell has a pivot, the class that meets most others, and
    all members are compared with it exactly.  If a cell of up to PAIRS members is then not one component, those outside
    its largest component are compared with all; larger cells are refined (see ``_refined``).  A refined cell with
    FEW members or less outside its largest component is settled by comparing these with all whose sizes allow it; others
    have a new pivot and are refined again, up to DEPTH times.  So no link between different components is lost, and no
    large cell is compared pair by pair unless DEPTH + 1 pivots leave it whole.
    """
    cells = classes.select("node", "n", F.explode("keys").alias("key"))
    cells = written(cells.join(cells.groupBy("key").agg(F.count("*").alias("all")).where("all > 1"), "key").select("key", "node", "n", "all"))
    hints = written(hints.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    wanted = written(cells.select("node").unionByName(hints.select(F.col("a").alias("node"))).unionByName(hints.select(F.col("b").alias("node"))).distinct())

    def sized(a: str, b: str):
        return (F.col(a) >= F.col(b) * least) & (F.col(b) >= F.col(a) * least)

    def sets(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["node", "s"])

    found = written(texts.join(small(wanted), "node", "left_semi").select("node", "text").mapInArrow(tidy(sets), "node long, s array<long>"))
    now = _pivoted(cells).select("key", "node", "n", F.lit(math.inf).alias("most"), "pivot", "pn")
    stars = lambda c: c.where((F.col("node") != F.col("pivot")) & sized("n", "pn")).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    first = _similar(stars(now).unionByName(hints).distinct(), found, least)
    links, done = [first], [cells, hints, wanted, found]

    def opened(cells: DataFrame, comps: DataFrame) -> DataFrame:
        done.append(_open(cells, comps))
        return done[-1]

    def joined() -> DataFrame:
        return written(connected_components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "of"))

    def settle(cells: DataFrame) -> None:
        """Members outside the largest component with all others; of two in different components, one at least is outside."""
        out = cells.where("comp <> main").select("key", F.col("node").alias("p"), F.col("n").alias("p_n"), F.col("most").alias("p_most"), F.col("comp").alias("p_comp"))
        fits = (F.col("comp") != F.col("p_comp")) & sized("n", "p_n") & (F.col("n") + F.col("p_n") <= F.least("most", "p_most")) & (F.col("node") != F.col("pivot")) & (F.col("p") != F.col("pivot"))
        pairs = out.join(cells, "key").where(fits).select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"))
        links.append(_similar(pairs.distinct(), found, least))

    comps = joined()
    many = opened(now, comps)
    settle(many.where(F.col("all") <= PAIRS))
    many, depth = many.where(F.col("all") > PAIRS), 0
    while not many.isEmpty() and depth < DEPTH:
        depth += 1
        members = written(many.select("pivot", "node").distinct().where("node <> pivot"))
        refined = written(_refined(members, found, least))
        done += [members, refined]
        # who is too large for the smallest of a cell can be left out
        smallest = refined.groupBy("key").agg(F.min("n").alias("n0"), F.count("*").alias("m")).where("m > 1")
        cells = opened(refined.join(smallest, "key").where("n + n0 <= most").select("key", "node", "n", "most", F.lit(-1).cast("long").alias("pivot")), comps)
        settle(cells.where(F.col("out") <= FEW))
        many = cells.where(F.col("out") > FEW)
        if not many.isEmpty():
            many = written(_pivoted(many.drop("pivot")).select("key", "node", "n", "most", "pivot", "pn"))
            done.append(many)
            links.append(_similar(stars(many).distinct(), found, least))
            comps = joined()
            many = opened(many, comps)
            settle(many.where(F.col("out") <= FEW))
            many = many.where(F.col("out") > FEW)
    if depth == DEPTH and not many.isEmpty():
        settle(many)
    more = reduce(DataFrame.unionByName, links)
    # what joins components, in terms of components
    named = comps.select("of", "component")
    more = more.join(named.select(F.col("of").alias("a"), F.col("component").alias("ca")), "a", "left").join(named.select(F.col("of").alias("b"), F.col("component").alias("cb")), "b", "left")
    more = written(more.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct())
    discard(*done, *links)
    return more, comps


def _pivoted(cells: DataFrame) -> DataFrame:
    """Adds pivot and its size pn: the member that meets most others over all cells, the smaller id on ties."""
    meets = written(cells.groupBy("node").agg(F.sum("all").alias("meets")))
    pivots = cells.join(small(meets), "node").groupBy("key").agg(F.max(F.struct("meets", (-F.col("node")).alias("node"), "n")).alias("c"))
    return cells.join(pivots.select("key", (-F.col("c.node")).alias("pivot"), F.col("c.n").alias("pn")), "key")


def _open(cells: DataFrame, comps: DataFrame) -> DataFrame:
    """Cells of more than one component, with comp, main (the largest), all members and out (those outside it)."""
    known = cells.join(small(comps), cells.node == comps.of, "left").select(*cells.columns, F.coalesce("component", "node").alias("comp"))
    top = known.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all")).where("all > top.m")
    return written(known.join(top, "key").select(*cells.columns, "comp", F.col("top.comp").alias("main"), "all", (F.col("all") - F.col("top.m")).alias("out")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest doc_id, a null one last.

    Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked, and groups
    are what links reach.  SimHash fingerprints of the same shingles within RADIUS bits (through the operator's
    shards of BK-trees) are compared first.  Their distance does not bound that similarity (README), so the pairs
    they miss share a band of MinHash values; every link is checked exactly.

    Rows stand for themselves: repeated rows, and rows that share a doc_id or have none, are members of groups like
    others and do not decide for each other.  Equal sets are one class whatever their number; null texts, empty texts
    and texts of white space are all one class; texts of fewer than five words are one shingle.  Of rows with equal
    doc_id the one with the least hash of its text stays.  An empty table gives an empty table; columns other than
    those of ``documents`` are not read.
    """
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    base = docs.select(*names)

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                sets, prints = zip(*[_sketch(t) for t in b.column(1).to_pylist()])
                extra = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*names, "class", "n", "fp", "keys"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema)
    rows = written(base.mapInArrow(tidy(run), f"{kinds}, class binary, n long, fp long, keys array<long>").withColumn("node", F.monotonically_increasing_id()))
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"), "node")
    # rows of a class may differ in how often they repeat a shingle: the fingerprint is that of its best row
    classes = written(rows.groupBy("class").agg(F.min(F.struct(best.alias("best"), "n", "fp", "keys")).alias("c")).select("c.best", F.col("c.best.node").alias("node"), "c.n", "c.fp", "c.keys"))
    prints = written(classes.where("n > 0").groupBy("fp").agg(F.min("node").alias("rep")))
    same = classes.join(prints, "fp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    more, comps = similar_links(classes, rows.select("node", "text"), near_links(prints, RADIUS).unionByName(same))
    named = classes.join(comps, classes.node == comps.of, "left").select("best", F.coalesce("component", "node").alias("near"))
    if not more.isEmpty():
        over = connected_components(more).withColumnRenamed("node", "near")
        named = named.join(over, "near", "left").select("best", F.coalesce("component", "near").alias("near"))
    keep = named.groupBy("near").agg(F.min("best").alias("best")).select("best.node")
    gone = written(rows.select("node").join(keep, "node", "left_anti"))
    discard(classes, prints, more, comps)
    return rows.join(small(gone), "node", "left_anti").select(*names)
