"""Toxic spans by a linear-chain conditional random field.

Only documents are labelled, so token labels are learnt with the field: a token of a
clean document is clean, and those of a toxic one are weighed by their marginals
given that at least one of them is toxic (expectation-maximisation). Emissions
add up weights of the word, its prefixes and its suffix, and of the two
neighbouring words; forward-backward marginals give each token's probability, and
the document's score and the offending offsets follow from them.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import crc_mod
from .textblocks import blocks, texts_of

#: Bounds of the fit for each label: documents, and characters of all of them together (one document is always taken).
SAMPLE_ROWS, SAMPLE_CHARS = 1_500, 12_000_000
#: Weights are trained on windows of so many words that together cover each document; padded cells of a batch.
WINDOW, CELLS = 400, 1_000_000
#: Rounds of expectation, steps of each, size of a step, and shrinkage.
ROUNDS, STEPS, RATE, SHRINK = 5, 10, 0.5, 1e-3
PREFIXES, SUFFIX = (3, 4, 5, 6, 7), 3
#: A feature is used from these log odds on; a token starts as toxic from STRONG on.
THRESHOLD, WEAK, STRONG, NOISE, MEMORY = 0.7, 1.0, 3.0, 0.1, 300_000
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Words, each in lower case, so that offsets stay those of the text."""
    return [w.lower() for w in _WORD.findall(text)]


def keys_of(word: str) -> list[tuple[int, str]]:
    return [(0, word), *((n, word[:n]) for n in PREFIXES if len(word) > n), (-SUFFIX, word[-SUFFIX:])]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CRF:
    """Two states; `trans` are the transition weights, `own`, `before` and `after` those of a word's features for itself and its neighbours."""

    def __init__(self, texts: list[str], toxic: list[int]) -> None:
        docs = [words_of(t) for t in texts]
        y = np.array(toxic, int)
        self.ready = bool(y.any())
        self.known: dict[str, tuple[float, float, float]] = {}
        self.trans, self.bias, self.scale = np.zeros((2, 2)), -4.0, np.array([0.0, 1.0, 1.0])
        self.index, self.own, self.before, self.after = {}, np.zeros(0), np.zeros(0), np.zeros(0)
        if not self.ready:
            return
        count = {0: Counter(), 1: Counter()}
        for d, label in zip(docs, y):
            count[label].update({k for w in set(d) for k in keys_of(w)})
        n1, n0 = int(y.sum()), max(1, int((1 - y).sum()))
        odds = {k: float(np.log((c + 0.1) / n1) - np.log((count[0][k] + 0.1) / n0)) for k, c in count[1].items() if c >= max(4, round(0.004 * n1))}
        odds = {k: o for k, o in odds.items() if o > WEAK}
        self.index = {k: i for i, k in enumerate(sorted(odds))}
        first = np.array([min(8.0, odds[k]) for k in sorted(odds)])
        self.own, self.before, self.after = np.zeros(len(first)), np.zeros(len(first)), np.zeros(len(first))
        rest = np.where(y == 1, np.cumsum(y), np.cumsum(1 - y)) % 4 == 3  # a quarter of each label tells how scores follow from marginals
        if not y[rest].any() or y[rest].all():
            rest = np.zeros(len(y), bool)
        self._train([d for d, r in zip(docs, rest) if not r], y[~rest], first)
        use = rest if rest.any() else ~rest
        self._calibrate([d for d, r in zip(docs, use) if r], y[use])

    def _train(self, docs: list[list[str]], y: np.ndarray, first: np.ndarray) -> None:
        words = sorted({w for d in docs for w in d})
        at = {w: i for i, w in enumerate(words)}
        pairs = [(i, self.index[k]) for i, w in enumerate(words) for k in keys_of(w) if k in self.index]
        row, col = (np.array(x, int) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
        score = lambda w: np.bincount(row, w[col], len(words))  # noqa: E731  of each word
        back = lambda g: np.bincount(col, g[row], len(first))  # noqa: E731  to each feature
        windows = [(k, np.array([at[w] for w in d[i : i + WINDOW]])) for k, d in enumerate(docs) for i in range(0, len(d), WINDOW)]
        windows.sort(key=lambda x: len(x[1]))
        groups = [windows[i : i + CELLS // WINDOW] for i in range(0, len(windows), CELLS // WINDOW)]
        batches = []
        for g in groups:
            n, doc = np.array([len(x) for _, x in g]), np.array([k for k, _ in g])
            ids = np.full((int(n.max()), len(g)), len(words))  # the last word is a padding
            for j, (_, x) in enumerate(g):
                ids[: len(x), j] = x
            batches.append((ids, n, doc))
        best = np.zeros(len(words))
        np.maximum.at(best, row, first[col])
        strong = np.append(best > STRONG, False).astype(float)
        targets = [strong[ids] * y[doc] for ids, _, doc in batches]
        sums = {k: 1e-6 for k in ("own", "before", "after", "bias", "trans")}
        for turn in range(ROUNDS):
            for _ in range(STEPS if turn else 3 * STEPS):
                u, b, a = (np.append(score(w), 0.0) for w in (self.own, self.before, self.after))
                grads = {"own": np.zeros(len(words) + 1), "before": np.zeros(len(words) + 1), "after": np.zeros(len(words) + 1), "bias": 0.0, "trans": np.zeros((2, 2))}
                for (ids, n, _), q in zip(batches, targets):
                    p, move = self.chain(self.emissions(u[ids], b[ids], a[ids]), n, q)
                    d = np.where(np.arange(len(ids))[:, None] < n, q - p, 0.0)
                    grads["own"] += np.bincount(ids.ravel(), d.ravel(), len(words) + 1)
                    grads["before"] += np.bincount(ids[:-1].ravel(), d[1:].ravel(), len(words) + 1)
                    grads["after"] += np.bincount(ids[1:].ravel(), d[:-1].ravel(), len(words) + 1)
                    grads["bias"] += d.sum()
                    grads["trans"] += move
                for k in ("own", "before", "after"):
                    grads[k] = back(grads[k][:-1])
                for k, g in grads.items():  # steps shrink with the gradients seen so far
                    name = {"own": self.own, "before": self.before, "after": self.after, "bias": self.bias, "trans": self.trans}[k]
                    g = g - SHRINK * len(y) * name
                    sums[k] = sums[k] + g * g
                    setattr(self, k, name + RATE * g / np.sqrt(sums[k]))
            u, b, a = (np.append(score(w), 0.0) for w in (self.own, self.before, self.after))
            clean = np.zeros(len(y))  # log of the probability that no token of a document is toxic
            found = []
            for ids, n, doc in batches:
                p = np.where(np.arange(len(ids))[:, None] < n, self.chain(self.emissions(u[ids], b[ids], a[ids]), n)[0], 0.0)
                found.append(p)
                np.add.at(clean, doc, np.log1p(-np.minimum(p, 1 - 1e-9)).sum(0))
            any_ = np.maximum(-np.expm1(clean), 1e-3)
            targets = [np.minimum(1.0, p / any_[doc]) * y[doc] for (_, _, doc), p in zip(batches, found)]

    def emissions(self, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Log potentials of the toxic state along the first axis; neighbours over an edge add nothing."""
        x = self.bias + own
        x[1:] += before[:-1]
        x[:-1] += after[1:]
        return x

    def chain(self, x: np.ndarray, n: np.ndarray, q: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward-backward over columns of length n: toxic marginals, and with targets q the gradient of the transitions."""
        T = len(x)
        e, t = np.exp(np.clip(x, -30, 30)), np.exp(self.trans)
        f, b = np.empty_like(e), np.empty_like(e)  # share of state 1 forwards; backwards, scaled to sum 1
        f[0] = e[0] / (1 + e[0])
        for i in range(1, T):
            a1 = ((1 - f[i - 1]) * t[0, 1] + f[i - 1] * t[1, 1]) * e[i]
            f[i] = a1 / ((1 - f[i - 1]) * t[0, 0] + f[i - 1] * t[1, 0] + a1)
        b[T - 1] = 0.5
        for i in range(T - 2, -1, -1):
            y1, y0 = b[i + 1] * e[i + 1], 1 - b[i + 1]
            b1, b0 = t[1, 1] * y1 + t[1, 0] * y0, t[0, 1] * y1 + t[0, 0] * y0
            b[i] = np.where(i >= n - 1, 0.5, b1 / (b0 + b1))
        p = f * b / (f * b + (1 - f) * (1 - b))
        move = np.zeros((2, 2))
        if q is not None and T > 1:
            inside = np.arange(1, T)[:, None] < n
            f0, f1, b0, b1 = 1 - f[:-1], f[:-1], 1 - b[1:], b[1:] * e[1:]
            j = [[f0 * t[0, 0] * b0, f0 * t[0, 1] * b1], [f1 * t[1, 0] * b0, f1 * t[1, 1] * b1]]
            whole = j[0][0] + j[0][1] + j[1][0] + j[1][1]
            for r, left in enumerate((1 - q[:-1], q[:-1])):
                for c, right in enumerate((1 - q[1:], q[1:])):
                    move[r, c] = ((left * right - j[r][c] / whole) * inside).sum()
        return p, move

    def weights(self, word: str) -> tuple[float, float, float]:
        """What a word adds to its own emission, to that of the next word, and to that of the word before."""
        w = self.known.get(word)
        if w is None:
            if len(self.known) > MEMORY:
                self.known = {}
            ids = [self.index[k] for k in keys_of(word) if k in self.index]
            w = self.known[word] = (float(self.own[ids].sum()), float(self.before[ids].sum()), float(self.after[ids].sum())) if ids else (0.0, 0.0, 0.0)
        return w

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        """P(token is toxic), by forward-backward over documents of like length together; cells bound a batch with its padding."""
        out: list = [np.zeros(len(d)) for d in docs]
        if not self.ready:
            return out
        rows = {i: np.array([self.weights(w) for w in d]) for i, d in enumerate(docs) if d}
        order = sorted(rows, key=lambda i: len(docs[i]))
        while order:
            # The longest that fits: padded cells are its length times the number of documents.
            k = 1
            while k < len(order) and len(docs[order[k]]) <= max(64, 2 * len(docs[order[0]])) and len(docs[order[k]]) * (k + 1) <= CELLS:
                k += 1
            part, order = order[:k], order[k:]
            n = np.array([len(docs[i]) for i in part])
            x = np.full((int(n.max()), k), -30.0)
            for j, i in enumerate(part):
                x[: n[j], j] = self.emissions(*rows[i].T)
            p = self.chain(x, n)[0]
            for j, i in enumerate(part):
                out[i] = p[: n[j], j]
        return out

    @staticmethod
    def figures(p: np.ndarray) -> np.ndarray:
        """What a document's score depends on: a constant, its expected toxic tokens, and their density, the last two as logarithms.

        Marginals under NOISE are left out, which in a long text would add up to a token.
        """
        s = float(p[p >= NOISE].sum()) + 0.01
        return np.array([1.0, np.log(s), np.log(s / (len(p) + 20))])

    def _calibrate(self, docs: list[list[str]], y: np.ndarray) -> None:
        x = np.array([self.figures(p) for p in self.marginals(docs)])
        mean, dev = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-6
        z, w = np.column_stack([np.ones(len(x)), (x[:, 1:] - mean) / dev]), np.zeros(3)
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / max(1, (1 - y).sum()))
        for _ in range(2000):
            w += 2.0 * (((y - sigmoid(z @ w)) * weight) @ z - 1e-4 * w)
        s = z @ w
        order = np.argsort(s, kind="stable")
        miss = np.concatenate([[0.0], np.cumsum(y[order] / y.sum())])
        false = np.concatenate([[1.0], 1 - np.cumsum((1 - y[order]) / max(1, (1 - y).sum()))])
        k = int((miss + false).argmin())
        edge = np.concatenate([[s[order][0] - 2], s[order], [s[order][-1] + 2]])
        cut = float((edge[k] + edge[k + 1]) / 2)
        self.scale = np.array([w[0] - (w[1:] * mean / dev).sum() - cut + np.log(THRESHOLD / (1 - THRESHOLD)), *(w[1:] / dev)])

    def score(self, p: np.ndarray) -> float:
        return float(sigmoid(self.figures(p) @ self.scale)) if self.ready else 0.0


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> CRF:
    """Fits on at most `rows` documents of each label, drawn by a hash of their id; not on the held-out fold.

    Texts of any length are taken, whole, in the order of that hash, up to the first of a label with which SAMPLE_CHARS
    would be passed: none is skipped for its length.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))
    sizes = docs.filter(F.length("text") > 0).join(drawn, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.sum(F.length("text")).alias("chars"), F.xxhash64("doc_id").alias("h")).collect()
    used, full, ids = [0, 0], [False, False], []
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        full[r.y] |= used[r.y] > 0 and used[r.y] + r.chars > SAMPLE_CHARS
        if not full[r.y]:
            used[r.y] += r.chars
            ids.append((r.doc_id, r.y))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, y int"))
    got = docs.select("doc_id", "text").join(chosen, "doc_id").filter(F.length("text") > 0).collect()
    got.sort(key=lambda r: (r.doc_id, r.text))
    return CRF([r.text for r in got], [r.y for r in got])


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:long,end:long,p:double>>"


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and spans: character offsets of tokens likelier toxic than not.

    Null and empty texts have no tokens and a low score; texts of any length are tagged whole. Rows that repeat an id
    are scored each, equal texts alike; a score of just THRESHOLD counts as toxic.
    Without a toxic label every score is 0. An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    model = fit(docs, labels)
    model.known = {}

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for b in blocks(batches):
            texts = b.column(1).to_pylist()
            marked = model.marginals([words_of(t) for t in texts])
            s, spans = np.array([model.score(p) for p in marked]), []
            for t, p in zip(texts, marked):
                hot = np.flatnonzero(p >= 0.5)
                at = [m.span() for m in _WORD.finditer(t)] if len(hot) else []
                spans.append([{"start": at[i][0], "end": at[i][1], "p": float(p[i])} for i in hot])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "held_out", "score", "predicted", "spans"])

    rows = texts_of(docs, (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    return rows.mapInArrow(run, SCHEMA)
