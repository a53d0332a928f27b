"""Tree-structured random field over quantised states: priors, training and exact inference."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of priors, ways to predict, and shapes in a configuration.
PRIORS, PREDICT = ("noprior", "l2", "es", "tp"), ("map", "sup", "gibbs")
SHAPES = {"chain": 1, "cross": 3}
#: Slices in one pass over arrays.
BLOCK = 256


def find(name: str, known: tuple[str, ...], what: str) -> str:
    """The registered name, whatever its case; an error that lists all of them otherwise."""
    for k in known:
        if k == name.lower():
            return k
    raise RuntimeError(f"bad {what} {name!r}: one of {known}")


@dataclass(frozen=True)
class FieldConfig:
    """stop,shape,tprior:sprior,lambda,predict,k — e.g. 0.01r,chain,noprior:noprior,0.1,map,8."""

    stop: float = 0.01
    stop_kind: str = "r"
    width: int = 1
    tprior: str = "noprior"
    sprior: str = "noprior"
    lam: float = 0.1
    predict: str = "map"
    k: int = 8

    @classmethod
    def parse(cls, text: str) -> FieldConfig:
        parts = text.split(",")
        if len(parts) != 6:
            raise RuntimeError("a field needs stop,shape,tprior:sprior,lambda,predict,k")
        stop, shape, prior, lam, predict, k = parts
        m = re.fullmatch(r"(\d+(?:\.\d+)?)(r|t)", stop)
        if not m or (m[2] == "t" and "." in m[1]):
            raise RuntimeError(f"bad stop rule {stop!r}: iterations like 10t or a change like 0.01r")
        s = re.fullmatch(r"([a-z]+)(\d*)", shape.lower())
        least = SHAPES[find(s[1] if s else shape, tuple(SHAPES), "shape")]
        if (least == 1) != (s[2] == "") or (s[2] and (int(s[2]) < least or int(s[2]) % 2 == 0)):
            raise RuntimeError(f"bad shape {shape!r}: chain, or cross with an odd width")
        p = prior.split(":")
        if len(p) != 2:
            raise RuntimeError(f"bad priors {prior!r}: two of {PRIORS} with a colon between")
        p = [find(x, PRIORS, "prior") for x in p]
        if not re.fullmatch(r"\d+(\.\d+)?", lam) or not k.isdigit() or int(k) < 2:
            raise RuntimeError("lambda must be a number and k an integer of at least 2")
        return cls(float(m[1]), m[2], int(s[2] or 1), p[0], p[1], float(lam), find(predict, PREDICT, "prediction"), int(k))


def edges(spark: SparkSession, dates: int, width: int = 1) -> DataFrame:
    """e, u, w, kind: centre to centre over dates, then centre to leaves; node = t * S + s with S = 2 width - 1.

    Always a tree of dates * S - 1 edges.
    """
    size, centre = 2 * width - 1, width - 1
    time = spark.range(dates - 1).select(F.col("id").alias("e"), (F.col("id") * size + centre).alias("u"), ((F.col("id") + 1) * size + centre).alias("w"), F.lit("time").alias("kind"))
    leaf = spark.range(dates * size).select(F.floor(F.col("id") / size).alias("t"), (F.col("id") % size).alias("s")).where(F.col("s") != centre)
    rank = F.col("s") - F.when(F.col("s") > centre, 1).otherwise(0)
    space = leaf.select((F.lit(dates - 1) + F.col("t") * (size - 1) + rank).alias("e"), (F.col("t") * size + centre).alias("u"), (F.col("t") * size + F.col("s")).alias("w"), F.lit("space").alias("kind"))
    return time.unionByName(space).select(F.col("e").cast("int"), F.col("u").cast("int"), F.col("w").cast("int"), "kind")


def edge_list(dates: int, width: int = 1) -> np.ndarray:
    """The same edges as an array of (u, w)."""
    size, centre = 2 * width - 1, width - 1
    time = [(t * size + centre, (t + 1) * size + centre) for t in range(dates - 1)]
    return np.array(time + [(t * size + centre, t * size + s) for t in range(dates) for s in range(size) if s != centre], np.int64).reshape(-1, 2)


def transitions(states: DataFrame, edge_kind_pairs: DataFrame, k: int) -> DataFrame:
    """(s0, s1, n, logp): counts from 1 of neighbouring states where both are known, rows normalised, log."""
    grid = states.sparkSession.range(k * k).select(F.floor(F.col("id") / k).cast("int").alias("s0"), (F.col("id") % k).cast("int").alias("s1"))
    counts = edge_kind_pairs.where("s0 IS NOT NULL AND s1 IS NOT NULL").groupBy("s0", "s1").agg(F.count("*").alias("c"))
    full = grid.join(F.broadcast(counts), ["s0", "s1"], "left").withColumn("n", F.coalesce("c", F.lit(0)) + 1)
    return full.select("s0", "s1", "n", F.log(F.col("n") / F.sum("n").over(Window.partitionBy("s0"))).alias("logp"))


def temporal_pairs(states: DataFrame) -> DataFrame:
    """(s0, s1) of a vertex on following dates.  ``states``: v, t, state (null where unknown)."""
    return states.select(F.col("state").alias("s0"), F.lead("state").over(Window.partitionBy("v").orderBy("t")).alias("s1"))


def spatial_pairs(states: DataFrame) -> DataFrame:
    """(s0, s1) of right and lower neighbours on one date.  ``states``: t, x, y, state."""
    step = F.explode(F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy"))))
    a = states.select("t", F.col("state").alias("s0"), "x", "y", step.alias("o")).select("t", "s0", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    return a.join(states.select("t", "x", "y", F.col("state").alias("s1")), ["t", "x", "y"]).select("s0", "s1")


def slice_pairs(slices: DataFrame, links: np.ndarray) -> DataFrame:
    """(s0, s1) of the ends of each link, the node with the smaller number first.  ``slices``: nodes (-1 where unknown)."""
    ends = F.array(*[F.struct(F.lit(int(min(u, w))).alias("a"), F.lit(int(max(u, w))).alias("b")) for u, w in links])
    state = lambda at: F.nullif(F.get("nodes", F.col(at)), F.lit(-1))
    return slices.select("nodes", F.explode(ends).alias("l")).select(state("l.a").alias("s0"), state("l.b").alias("s1"))


def date_links(dates: int, width: int = 1) -> np.ndarray:
    """Each node of a date with the same place on the next date."""
    size = 2 * width - 1
    return np.array([(t * size + s, (t + 1) * size + s) for t in range(dates - 1) for s in range(size)], np.int64).reshape(-1, 2)


def leaf_links(dates: int, width: int = 1) -> np.ndarray:
    """The edges within dates."""
    return edge_list(dates, width)[max(0, dates - 1) :]


def node_states(states: DataFrame) -> DataFrame:
    """(v, nodes array<int>): states of a slice by node number, -1 where unknown.  ``states``: v, node, state."""
    return states.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", F.coalesce("state", F.lit(-1)).alias("state")))), lambda s: s["state"]).alias("nodes"))


def edge_statistics(states: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(e, s0, s1, n): how often both ends of an edge show these states."""
    known = states.where("state IS NOT NULL")
    e = F.broadcast(edge_table.select("e", "u", "w"))
    a = known.select("v", F.col("node").alias("u"), F.col("state").alias("s0")).join(e, "u")
    return a.join(known.select("v", F.col("node").alias("w"), F.col("state").alias("s1")), ["v", "w"]).groupBy("e", "s0", "s1").agg(F.count("*").alias("n"))


def adaptive_lambda(states: DataFrame, edge_table: DataFrame, lam: float) -> DataFrame:
    """(e, lam): lambda times the share of slices in which an end of the edge is unknown."""
    e = F.broadcast(edge_table.select("e", "u", "w"))
    a = states.select("v", F.col("node").alias("u"), F.col("state").alias("s0")).join(e, "u")
    both = a.join(states.select("v", F.col("node").alias("w"), F.col("state").alias("s1")), ["v", "w"])
    return both.groupBy("e").agg((F.lit(lam) * F.avg((F.col("s0").isNull() | F.col("s1").isNull()).cast("int"))).alias("lam"))


# -- tree inference, vectorised over slices ---------------------------------------------------------
def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tree:
    """Order of messages over the edges, towards node of the first edge's start."""

    def __init__(self, links: np.ndarray) -> None:
        self.links, self.n = links, len(links) + 1
        near: dict[int, list[tuple[int, int, bool]]] = {i: [] for i in range(self.n)}
        for e, (u, w) in enumerate(links):
            near[u].append((e, w, False))
            near[w].append((e, u, True))
        self.root = int(links[0][0]) if len(links) else 0
        self.down: list[tuple[int, int, int, bool]] = []  # (edge, parent, child, reversed)
        seen, todo = {self.root}, [self.root]
        while todo:
            p = todo.pop()
            for e, c, back in near[p]:
                if c not in seen:
                    seen.add(c)
                    self.down.append((e, p, c, back))
                    todo.append(c)

    def _clamped(self, nodes: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros((len(nodes), self.n, k))
        r, c = np.nonzero(nodes >= 0)
        out[r, c] = -1e9
        out[r, c, nodes[r, c]] = 0.0
        return out

    def _upward(self, theta, own, fold):
        """Beliefs with everything below folded in, and the message of each child."""
        msgs = {}
        for e, p, c, back in reversed(self.down):
            th = theta[e].T if back else theta[e]  # parent state x child state
            msgs[c] = fold(th[None] + own[:, c][:, None, :], 2)
            own[:, p] += msgs[c]
        return msgs

    def marginals(self, theta: np.ndarray, nodes: np.ndarray, pairs: str | None = "each"):
        """(log-partition, node marginals, pair marginals by edge) given the known states.

        Pair marginals are those of "each" row, their "sum" over rows (edges x k x k numbers whatever the rows), or none.
        """
        k = theta.shape[1]
        own = self._clamped(nodes, k)
        msgs = self._upward(theta, own, _lse)
        logz = _lse(own[:, self.root], 1)
        full = {self.root: own[:, self.root]}
        out = None if pairs is None else np.empty(((len(nodes),) if pairs == "each" else ()) + (len(self.links), k, k))
        for e, p, c, back in self.down:
            th = theta[e].T if back else theta[e]
            joint = (full[p] - msgs[c])[:, :, None] + th[None] + own[:, c][:, None, :]
            full[c] = _lse(joint, 1)
            if out is None:
                continue
            prob = np.exp(joint - logz[:, None, None])
            prob = prob.transpose(0, 2, 1) if back else prob
            if pairs == "each":
                out[:, e] = prob
            else:
                out[e] = prob.sum(axis=0)
        uni = np.stack([np.exp(full[i] - logz[:, None]) for i in range(self.n)], axis=1)
        return logz, uni, out

    def best(self, theta: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Most likely states given the known ones."""
        own = self._clamped(nodes, theta.shape[1])
        self._upward(theta, own, lambda a, axis: a.max(axis=axis))
        return self._walk(theta, own, lambda scores: scores.argmax(axis=1))

    def draw(self, theta: np.ndarray, nodes: np.ndarray, noise: np.ndarray) -> np.ndarray:
        """An exact sample given the known states: filter upward, sample downward.  ``noise``: Gumbel, rows x nodes x k."""
        own = self._clamped(nodes, theta.shape[1])
        self._upward(theta, own, _lse)
        return self._walk(theta, own, lambda s: (s[0] + noise[:, s[1]]).argmax(axis=1), True)

    def _walk(self, theta, own, choose, numbered: bool = False) -> np.ndarray:
        out = np.empty((len(own), self.n), np.int64)
        out[:, self.root] = choose((own[:, self.root], self.root) if numbered else own[:, self.root])
        for e, p, c, back in self.down:
            th = theta[e].T if back else theta[e]
            score = th[out[:, p]] + own[:, c]
            out[:, c] = choose((score, c) if numbered else score)
        return out


def gumbel(vertices, nodes: int, k: int, seed: int = 0) -> np.ndarray:
    """Noise that depends on the seed and the vertex alone, however rows are batched."""
    return np.stack([np.random.default_rng([seed, int(v) & 0xFFFFFFFFFFFFFFFF]).gumbel(size=(nodes, k)) for v in vertices])


def expected_counts(slices: DataFrame, links: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Sum over slices of the pair marginals given what is known: one aggregate, edges x k x k numbers in all."""
    n_edges, k = theta.shape[:2]
    sent = slices.sparkSession.sparkContext.broadcast((links, theta))

    def run(frames):
        li, th = sent.value
        tree, total = Tree(li), np.zeros((n_edges, k, k))
        for pdf in frames:
            for a in range(0, len(pdf), BLOCK):
                total += tree.marginals(th, np.array(pdf["nodes"].iloc[a : a + BLOCK].tolist(), np.int64), "sum")[2]
        yield pd.DataFrame({"i": np.arange(total.size), "w": total.ravel()})

    rows = slices.select("nodes").mapInPandas(run, "i long, w double").groupBy("i").agg(F.sum("w").alias("w")).toPandas()
    out = np.zeros(n_edges * k * k)
    out[rows["i"]] = rows["w"]
    return out.reshape(n_edges, k, k)


def maximise(links: np.ndarray, share: np.ndarray, theta: np.ndarray, prior: np.ndarray | None, lam: np.ndarray, stop: float, kind: str, progress: Callable | None = None, regulariser: Callable | None = None, most: int = 20_000) -> tuple[np.ndarray, list[float]]:
    """Minimise A(theta) - <share, theta> + sum lam |theta - prior|^2.

    Kind "t": ``stop`` steps.  Kind "r": until 100 steps in a row have changed the objective by ``stop`` or less, with a
    warning if that is not so after ``most`` steps.  Hooks: progress(step, objective) after each step, and
    regulariser(theta) -> (penalty, its gradient) in place of the quadratic one.
    """
    tree = Tree(links)
    blank = np.full((1, len(links) + 1), -1)
    lam3 = lam[:, None, None] if prior is not None else np.zeros((len(links), 1, 1))
    goal = prior if prior is not None else np.zeros_like(theta)

    def value(th):
        logz, _, pairs = tree.marginals(th, blank)
        more, slope = regulariser(th) if regulariser else ((lam3 * (th - goal) ** 2).sum(), 2 * lam3 * (th - goal))
        return float(logz[0] - (share * th).sum() + more), pairs[0] - share + slope

    path, still, size = [], 0, 1.0
    now, grad = value(theta)
    for step in range(int(stop) if kind == "t" else most):
        while True:
            new = theta - size * grad
            got, new_grad = value(new)
            if got <= now - 0.25 * size * (grad**2).sum() or size < 1e-6:
                break
            size /= 2
        still = still + 1 if abs(now - got) <= (stop if kind == "r" else -1) else 0
        theta, now, grad, size = new, got, new_grad, min(size * 1.5, 16.0)
        path.append(now)
        if progress:
            progress(step, now)
        if still >= 100:
            break
    if kind == "r" and still < 100:
        warnings.warn(f"the field has not settled after {most} steps", stacklevel=2)
    return theta, path


def train(slices: DataFrame, links: np.ndarray, k: int, rounds: int = 2, stop: float = 0.01, kind: str = "r", prior: np.ndarray | None = None, lam: np.ndarray | None = None, **hooks) -> tuple[np.ndarray, list[list[float]]]:
    """EM: expected pair counts in Spark, maximisation on their fixed-size sum.  Returns weights and objectives."""
    n = slices.count()
    theta, paths = np.zeros((len(links), k, k)), []
    lam = np.zeros(len(links)) if lam is None else lam
    for _ in range(rounds):
        share = expected_counts(slices, links, theta) / max(n, 1)
        theta, path = maximise(links, share, theta, prior, lam, stop, kind, **hooks)
        paths.append(path)
    return theta, paths


def infer(slices: DataFrame, links: np.ndarray, theta: np.ndarray, how: str, centroids: np.ndarray, seed: int = 0) -> DataFrame:
    """(v, node, state, pred): states and band vectors of all nodes; ``sup`` mixes centroids by their probability."""
    sent = slices.sparkSession.sparkContext.broadcast((links, theta, centroids))

    def run(frames):
        li, th, cen = sent.value
        tree = Tree(li)
        for whole in frames:
            for a in range(0, len(whole), BLOCK):
                pdf = whole.iloc[a : a + BLOCK]
                nodes = np.array(pdf["nodes"].tolist(), np.int64)
                if how == "sup":
                    uni = tree.marginals(th, nodes, None)[1]
                    states, pred = uni.argmax(axis=2), uni @ cen
                else:
                    states = tree.best(th, nodes) if how == "map" else tree.draw(th, nodes, gumbel(pdf["v"], tree.n, th.shape[1], seed))
                    pred = cen[states]
                v, m = len(nodes), tree.n
                yield pd.DataFrame({"v": np.repeat(pdf["v"].to_numpy(), m), "node": np.tile(np.arange(m), v), "state": states.ravel(), "pred": list(pred.reshape(v * m, -1))})

    how = find(how, PREDICT, "prediction")
    return slices.select("v", "nodes").mapInPandas(run, "v long, node int, state int, pred array<double>")
