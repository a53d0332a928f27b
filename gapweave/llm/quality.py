"""Quality classifier: naive-Bayes support vectors over n-gram indicators.

Indicators of byte n-grams (hashed to DIMENSIONS), and of word n-grams of RUNS words that are one word
over and over (whatever the word, so that unseen words count), are scaled by the log-count ratio of the two
classes; counts come from all labelled training rows, by a combinable aggregate.  A linear hinge-loss
model is fitted by dual coordinate descent on a sample of at most ``sample`` labelled rows (the rows
with the least hash of doc_id), and a logistic curve fitted to held-back margins turns margins into
scores from 0 to 1.  Scoring reads each text once, where it lies.
"""

from __future__ import annotations

import warnings
import zlib
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, tidy, written

BITS = 17
DIMENSIONS = 1 << BITS
GRAMS = (1, 2, 3, 4)
#: Lengths of repeated-word n-grams; they take the last indices.
RUNS = (2, 3, 4, 6, 8)
#: Largest number of labelled rows that the linear model is fitted on.
SAMPLE = 4000
THRESHOLD = 0.3


def indicators(text: str | None, mark: np.ndarray) -> np.ndarray:
    """Sorted indices of the n-grams in a whole text; ``mark`` is scratch, all false before and after."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw), 1 << 20):  # slabs overlap by the longest gram
        part = raw[at : at + (1 << 20) + GRAMS[-1] - 1].astype(np.uint32)
        code = part
        for n in GRAMS:
            if n > 1:
                code = (code[:-1] << np.uint32(8)) | part[n - 1 :]
            if not len(code):
                break
            mark[(((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.intp)] = True
    mark[-len(RUNS) :] = False
    words = data.split()
    same = np.fromiter(map(eq, words, islice(words, 1, None)), bool, max(0, len(words) - 1))
    if same.any():
        edge = np.flatnonzero(np.diff(same, prepend=False, append=False))
        longest = int((edge[1::2] - edge[::2]).max()) + 1
        for k, n in enumerate(RUNS):
            mark[DIMENSIONS - len(RUNS) + k] = longest >= n
    found = np.flatnonzero(mark)
    mark[found] = False
    return found


class Model:
    """Weights by n-gram, bias and the logistic curve."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.ratio, self.weight, self.bias, self.slope, self.shift = ratio, weight, bias, slope, shift

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        norm = float(np.sqrt((r * r).sum()))
        return (float((self.weight[found] * r).sum()) / norm if norm else 0.0) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def _descend(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: float, slack: float = 0.05, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss over unit-length rows with a bias of one.

    Minimises (|w|^2 + bias^2) / 2 + sum of cost_i * max(0, 1 - sign_i * margin_i), where both classes weigh the same
    in all.  Rows whose dual value rests at a bound are set aside until the others have settled.  It ends when no
    projected gradient of any row differs from another by more than ``slack``, and warns if that takes over ``rounds``.
    """
    values = []
    for r in rows:
        v = ratio[r]
        n = np.sqrt((v * v).sum())
        values.append(v / n if n else v)
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    square = np.array([(v * v).sum() + 1 for v in values])
    most = cost * np.where(signs > 0, len(signs) / (2 * max(1, (signs > 0).sum())), len(signs) / (2 * max(1, (signs < 0).sum())))
    rng = np.random.default_rng(7)
    active, high, low = np.arange(len(rows)), np.inf, -np.inf
    for _ in range(rounds):
        top, bottom, stay = -np.inf, np.inf, []
        for i in rng.permutation(active):
            grad = signs[i] * (w[rows[i]] @ values[i] + bias) - 1
            if alpha[i] == 0 and grad > high or alpha[i] == most[i] and grad < low:
                continue  # at rest for now
            stay.append(i)
            push = min(grad, 0.0) if alpha[i] == 0 else max(grad, 0.0) if alpha[i] == most[i] else grad
            top, bottom = max(top, push), min(bottom, push)
            if push:
                new = min(max(alpha[i] - grad / square[i], 0.0), most[i])
                d = (new - alpha[i]) * signs[i]
                alpha[i] = new
                w[rows[i]] += d * values[i]
                bias += d
        if top - bottom <= slack:
            if len(active) == len(rows):
                return w, bias
            active, high, low = np.arange(len(rows)), np.inf, -np.inf
            continue
        active = np.array(stay)
        high, low = top if top > 0 else np.inf, bottom if bottom < 0 else -np.inf
    warnings.warn("dual coordinate descent has not settled", stacklevel=2)
    return w, bias


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve, by Newton steps on smoothed targets."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - goal) * margins).sum(), (p - goal).sum()]) + np.array([1e-3 * a, 0])
        q = p * (1 - p) + 1e-9
        hess = np.array([[(q * margins * margins).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, cost: float = 4.0) -> Model:
    """Model from sample rows and the class counts of all training rows."""
    # Laplace-smoothed share of each class's documents that hold the n-gram
    ratio = np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))
    ratio[(pos + neg) == 0] = 0.0
    if not n_pos or not n_neg or len(np.unique(labels)) < 2:
        p = (n_pos + 1) / (n_pos + n_neg + 2)
        return Model(np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 1.0, float(np.log(p / (1 - p))))
    signs = np.where(labels == 1, 1.0, -1.0)
    held = np.arange(len(rows)) % 3
    margins = np.zeros(len(rows))
    for k in range(3):
        own = [r for r, h in zip(rows, held) if h != k]
        if len(set(signs[held != k])) < 2:
            continue
        part = Model(ratio, *_descend(own, signs[held != k], ratio, cost), 1.0, 0.0)
        for i in np.flatnonzero(held == k):
            margins[i] = part.margin(rows[i])
    slope, shift = _logistic(margins, labels)
    return Model(ratio, *_descend(rows, signs, ratio, cost), slope, shift)


_GATHER = "feature int, pos long, neg long, h long, label int, bits binary"


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    Rows without a doc_id or a label of 0 or 1 are left out; of several labels of one doc_id the
    largest holds.  Every labelled row counts in the class counts, repeated rows too; equal rows are one row of
    the sample.  The sample is all labelled rows if they are few, else those with the least hash of doc_id and
    text.  Without rows of both classes the score is the smoothed share of label 1.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1) AND doc_id IS NOT NULL")
    marks = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    # the same join at every size: the labels grow with the corpus, so a broadcast of them would not last
    found = rows.select("doc_id").distinct().join(marks.hint("merge"), "doc_id", "left_semi").count()  # reads ids alone
    limit = 2.0**64 * min(1.0, 1.2 * sample / max(1, found)) - 2.0**63 if found > sample else 2.0**63
    rows = rows.join(marks.hint("merge"), "doc_id").select("text", "quality", F.xxhash64("doc_id", "text").alias("h"))

    def run(batches):
        mark, counts, n, kept, most = np.zeros(DIMENSIONS, bool), np.zeros((2, DIMENSIONS + 1), np.int64), 0, {}, limit
        for b in batches:
            for text, label, h in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = indicators(text, mark)
                counts[label, found] += 1
                counts[label, DIMENSIONS] += 1  # rows of the class
                n += 1
                if h <= most and h not in kept:
                    mark[found] = True
                    kept[h] = label, zlib.compress(np.packbits(mark).tobytes(), 1)
                    mark[found] = False
                    if len(kept) > 2 * sample:  # the least of all are among the least of each task
                        kept = dict(sorted(kept.items())[:sample])
                        most = max(kept)
        z = np.zeros(len(kept), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(z - 1).cast(pa.int32()), pa.array(z), pa.array(z), pa.array(list(kept), pa.int64()), pa.array([k[0] for k in kept.values()], pa.int32()), pa.array([k[1] for k in kept.values()], pa.binary())], names=[x.split()[0] for x in _GATHER.split(", ")])
        if n:
            f = np.flatnonzero(counts.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(counts[1][f]), pa.array(counts[0][f]), pa.array(np.zeros(len(f), np.int64)), pa.array(np.zeros(len(f), np.int32)), pa.nulls(len(f), pa.binary())], names=[x.split()[0] for x in _GATHER.split(", ")])

    gathered = written(rows.mapInArrow(tidy(run), _GATHER))
    # at most DIMENSIONS + 1 rows and at most ``sample`` rows reach the driver
    t = gathered.where("feature >= 0").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    pos, neg = np.zeros(DIMENSIONS + 1, np.int64), np.zeros(DIMENSIONS + 1, np.int64)
    f = t["feature"].to_numpy()
    pos[f], neg[f] = t["pos"].to_numpy(), t["neg"].to_numpy()
    s = gathered.where("feature < 0").select("h", "label", "bits").distinct().orderBy("h", "bits").limit(sample).toArrow()
    discard(gathered)
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(x.as_py()), np.uint8))).astype(np.int32) for x in s["bits"]]
    model = fit_rows(rows, np.array(s["label"].to_pylist(), np.int64), pos[:-1], neg[:-1], int(pos[-1]), int(neg[-1]))
    del s, t, rows
    give_back()
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted and the columns to carry, a row for each row; null texts score as empty ones.

    Equal texts have equal scores whatever their other columns; a score equal to the threshold is predicted 1.
    Repeated rows and rows without a doc_id each keep their row.  An empty table gives an empty table.  The
    columns to carry are in a struct ``carry``, so their names may be any; other columns are not read.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(F.lit(0).alias("none"), *carry).alias("carry"))

    def run(batches):
        mark, m = np.zeros(DIMENSIONS, bool), sent.value
        for b in batches:
            s = np.array([m.score(indicators(t, mark)) for t in b.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), b.column(1), b.column(2)], names=["doc_id", "score", "predicted", "text", "carry"])

    def lean(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(3)], names=["doc_id", "score", "predicted"])

    if not carry:
        return base.mapInArrow(tidy(lean), "doc_id long, score double, predicted int")
    kind = base.schema["carry"].dataType.simpleString()
    return base.mapInArrow(tidy(run), f"doc_id long, score double, predicted int, text string, carry {kind}")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under THRESHOLD) go; the others keep their rows as they are.

    Each row is judged by its own text, null as empty; rows that share a doc_id, or have none, do not decide for
    each other.  With no labels of both classes all rows share one score.  An empty table gives an empty table;
    columns other than those of ``documents`` are not read.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = score(docs, model, carry=("lang", "source", "n_chars")).where("predicted = 1")
    return kept.select("doc_id", "text", "carry.lang", "carry.source", "carry.n_chars")
