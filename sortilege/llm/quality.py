"""Quality classifier: Bradley-Terry ranking learnt from preference pairs.

A labelled good text is preferred to a labelled bad one. Logistic loss on the
difference of their features gives weights; every labelled text takes part. The
threshold is a quantile of all training scores, and scores are shifted so that it comes to lie at THRESHOLD.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textblocks import blocks, texts_of

#: Labelled rows of a block of the fit, and rows of the rarer label in each; steps of the fit at most; buckets of a count of scores.
BLOCK_ROWS, PARTNERS, STEPS, BUCKETS = 512, 32, 40, 4096
THRESHOLD = 0.3


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_features(text: str) -> list[float]:
    """Shape, symbol and repetition figures of the whole text."""
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = text.split("\n")
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    symbols = counts[33] + counts[35:39].sum() + counts[42] + counts[64] + counts[94:96].sum() + counts[60:63:2].sum()
    packed = len(zlib.compress(raw, 1)) / max(1, len(raw))
    distinct = len(set(words)) / m
    return [
        np.log1p(m), n / m / 10, upper / max(1, upper + lower), symbols / m, counts[124] / m, counts[48:58].sum() / n, counts[46] / m, counts[44] / m, counts[33] / m,
        packed, min(packed, 0.25), distinct, distinct * np.log1p(m), len(set(lines)) / len(lines), np.log1p(len(lines)) / np.log1p(m), float(not words), float(m < 10), counts[128:].sum() / n,
    ]


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and an array of features per row; null text is empty."""
    def run(batches):
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[float(x) for x in text_features(t)] for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "features"])

    return texts_of(docs).mapInArrow(run, "doc_id long, features array<double>")


#: Weight of the squared weights in the loss.
SHRINK = 1e-4


def pair_loss(w: np.ndarray, d: np.ndarray) -> float:
    """Mean logistic loss of feature differences d (better less worse), with the squared weights."""
    return float(np.logaddexp(0, -(d @ w)).mean() + SHRINK / 2 * w @ w)


def pair_gradient(w: np.ndarray, d: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
    return -(d * p[:, None]).mean(0) + SHRINK * w


class BradleyTerry:
    """Weights of standardised features, and the cut of their sums that scores THRESHOLD; an infinite cut lets all or none pass."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, cut: float) -> None:
        self.mean, self.scale, self.w, self.cut = mean, scale, w, cut

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not np.isfinite(self.cut):
            return np.full(len(x), 1.0 if self.cut < 0 else 0.0)
        s = ((x - self.mean) / self.scale) @ self.w - self.cut
        return 1 / (1 + np.exp(-np.clip(s + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def _blocks(rows: DataFrame, n: int, fewer: int, rare: int) -> DataFrame:
    """rows (features, y, w) dealt into blocks, one a row: y, w, own, x (the features one behind the other).

    Where the rarer label has less than PARTNERS rows a block, copies of its rows (own is false) go to several blocks, to all if need be.
    """
    count = max(1, -(-n // BLOCK_ROWS))
    copies = min(count, -(-PARTNERS * count // max(1, fewer)))
    base = F.pmod(F.xxhash64("features", "y"), F.lit(count))
    k = F.explode(F.sequence(F.lit(0), F.when(F.col("y") == rare, copies - 1).otherwise(0)))
    dealt = rows.select("features", "y", "w", base.alias("base"), k.alias("k"))
    block = F.pmod(F.col("base") + F.floor(F.col("k") * F.lit(count) / copies), F.lit(count))
    members = F.sort_array(F.collect_list(F.struct("y", (F.col("k") == 0).alias("own"), "w", "features")))
    held = dealt.groupBy(block.alias("block")).agg(members.alias("m"))
    return held.select(F.col("m.y").alias("y"), F.col("m.w").alias("w"), F.col("m.own").alias("own"), F.flatten("m.features").alias("x"))


def _each(table: DataFrame, find) -> np.ndarray:
    """The rows of figures that find(y, w, own, x) gives for the blocks of a task, summed by task."""
    def run(batches):
        total = 0.0
        for b in batches:
            for i in range(b.num_rows):
                y, w, own, x = (c[i].values.to_numpy(zero_copy_only=False) for c in b.columns)
                total = total + find(y, w, own, x.reshape(len(y), -1))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    return np.array([r.v for r in table.mapInArrow(run, "v array<double>").collect()]).sum(0)


def _loss(table: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean loss of all pairs of the blocks, its gradient and its second derivatives, with the squared weights."""
    size = len(w)

    def find(y, weight, own, x):
        z, (good, bad) = (x - mean) / scale, (np.flatnonzero(y == k) for k in (1, 0))
        s, out, b, ub = z @ w, np.zeros(2 + size + size * size), z[bad], weight[bad]
        for a in range(0, len(good), BLOCK_ROWS):  # bounded also where a block is larger than most
            i = good[a : a + BLOCK_ROWS]
            g, u = z[i], weight[i][:, None] * ub
            m = s[i][:, None] - s[bad]
            p = u / (1 + np.exp(np.clip(m, -500, 500)))
            q = p * (1 - p / u)
            cross = g.T @ q @ b
            hess = (g * q.sum(1)[:, None]).T @ g + (b * q.sum(0)[:, None]).T @ b - cross - cross.T
            out += np.concatenate([[u.sum(), (u * np.logaddexp(0, -m)).sum()], p.sum(0) @ b - p.sum(1) @ g, hess.ravel()])
        return out

    got = _each(table, find)
    mean_of = got[1:] / got[0]
    return mean_of[0] + SHRINK / 2 * w @ w, mean_of[1 : 1 + size] + SHRINK * w, mean_of[1 + size :].reshape(size, size) + SHRINK * np.eye(size)


def _quantile(table: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, n: int, share: float) -> float:
    """The quantile of all rows' scores, between two of them in proportion: counted in ever narrower buckets until few are left."""
    at = (n - 1) * share
    rank = int(np.floor(at))

    def of(x):
        return ((x - mean) / scale) @ w

    def value(rank: int) -> float:
        """The score at a rank, by halving the doubles between the ends, BUCKETS ways at a time."""
        lo, hi, below = -1e300, 1e300, 0
        edges = np.concatenate([[lo], -np.logspace(300, -300, BUCKETS // 2), np.logspace(-300, 300, BUCKETS // 2), [hi]])
        while True:
            def find(y, u, own, x, edges=edges):
                k = np.clip(np.searchsorted(edges, of(x)[own], side="right") - 1, -1, len(edges) - 1) + 1
                return np.bincount(k, u[own], len(edges) + 1)

            upto = np.cumsum(_each(table, find))
            k = int(np.searchsorted(upto, rank, side="right"))
            lo, hi = edges[k - 1], edges[min(k, len(edges) - 1)]
            if hi <= np.nextafter(lo, np.inf):
                return float(lo)
            edges = np.unique(np.concatenate([np.linspace(lo, hi, BUCKETS), [lo, np.nextafter(lo, np.inf), hi]]))

    first = value(rank)
    return first if at == rank else first + (at - rank) * (value(rank + 1) - first)


def learnt(found: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> BradleyTerry:
    """Fits on every labelled row of found (doc_id, features) that lies in other folds. No labels: all pass.

    Rows are dealt into blocks by a hash; in each block every good row is compared with every bad one. Newton's method takes the sums of
    all blocks, a job a step, so nothing but sums comes to the driver. Mean, scale and cut are those of all rows.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    scratch, size = Scratch(found.sparkSession, "quality"), len(text_features(""))
    # Equal rows are one with their number.
    rows = scratch.save(found.join(known, "doc_id").groupBy("features", "y").agg(F.count(F.lit(1)).cast("double").alias("w")), "rows")
    counts = {r.y: (r.k, int(r.n)) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("n")).collect()}
    zero = np.zeros(size)
    if len(counts) < 2:
        return BradleyTerry(zero, zero + 1, zero, np.inf if 0 in counts else -np.inf)
    rare = min(counts, key=lambda k: (counts[k][0], k))
    table = scratch.save(_blocks(rows, sum(k for k, _ in counts.values()), counts[rare][0], rare), "blocks")
    n = sum(c for _, c in counts.values())
    mean = _each(table, lambda y, w, own, x: (w * own) @ x) / n
    scale = np.sqrt(_each(table, lambda y, w, own, x: (w * own) @ (x - mean) ** 2) / n) + 1e-6
    w = zero
    loss, slope, bend = _loss(table, mean, scale, w)
    for _ in range(STEPS):
        step = np.linalg.solve(bend, slope)
        if slope @ step < 1e-12:
            break
        for part in (1.0, 0.25, 0.05, 0.01):
            next_ = _loss(table, mean, scale, w - part * step)
            if next_[0] < loss:
                break
        else:
            break
        w, (loss, slope, bend) = w - part * step, next_
    # The quantile: as many training rows lie below it as are labelled bad.
    return BradleyTerry(mean, scale, w, _quantile(table, mean, scale, w, n, counts[0][1] / n))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> BradleyTerry:
    """`learnt` from texts."""
    mine = docs.filter(F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held))
    return learnt(featured(mine), labels, folds, held)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, empty and null texts too, and whole texts of any length.

    Rows that repeat an id are scored each; equal texts have equal scores, and a
    score of just THRESHOLD counts as good. A null doc_id is held out or not as
    the empty string is. An empty table gives no rows; other columns are ignored.
    """
    # Figures are taken once, for the fit and for the scores.
    found = Scratch(docs.sparkSession, "quality").save(featured(docs), "features")
    model = learnt(found, labels)

    def run(batches):
        for b in batches:
            s = model.scores(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = found.select("doc_id", "features", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns, whatever these are named.

    Null text is judged as an empty one. Rows that repeat an id or a text are
    judged each by its text, so equal texts go or stay together. An empty table
    gives no rows; with no usable label all stay.
    """
    model, at = fit(docs, labels), docs.columns.index("text")

    def run(batches):
        for b in blocks(batches, at):
            s = model.scores(np.array([text_features(t or "") for t in b.column(at).to_pylist()]))
            yield b.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
