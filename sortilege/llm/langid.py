"""Language identification by prediction by partial matching.

Each language has byte context trees of orders ORDER down to 0. A byte seen in the
longest known context costs its share there (method C: occurrences over
occurrences and distinct successors); any other costs the escape and is looked for
in the next shorter context, and in the end among all 256 bytes. Statistics are
frozen after the fit, so the code length of a byte depends on the ORDER bytes before it
only. Orders 0 and 1 are laid out densely over the bytes seen, longer ones sparsely.
Texts are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import crc_mod
from .textblocks import blocks, raw_bytes, texts_of

#: Bound of the fit: documents expected for each language, of any length. Their counts are added up in Spark.
SAMPLE_ROWS = 1_000
#: Longest context; contexts longer than two bytes are kept if they occur so often in the fit.
ORDER, LEAST = 4, 4
_LETTER = regex.compile(r"\p{L}")


def _spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with ORDER spaces before each row, and the place of each row's first byte less ORDER."""
    n = len(at) - 1
    spaced = np.full(len(data) + ORDER * n, 32, np.uint8)
    row = np.repeat(np.arange(n), np.diff(at))
    spaced[np.arange(len(data)) + ORDER * (row + 1)] = data
    return spaced, at[:-1] + ORDER * np.arange(n)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ORDER before it, as one number, and how often it occurs; a text starts after ORDER spaces."""
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    spaced, first = _spaced(np.frombuffer(b"".join(raw), np.uint8), at)
    c = spaced.astype(np.int64)
    key = np.zeros(max(0, len(c) - ORDER), np.int64)
    for i in range(ORDER + 1):
        key = key << 8 | c[i : len(c) - ORDER + i]
    own = np.zeros(len(key), bool)  # others would predict a space before a text
    for a, n in zip(first, np.diff(at)):
        own[a : a + n] = True
    return np.unique(key[own], return_counts=True)


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(key, return_inverse=True)
    return kinds, np.bincount(at, n, len(kinds))


def bits(p: np.ndarray) -> np.ndarray:
    return -np.log2(np.maximum(p, 1e-30)).astype(np.float32)


class PPM:
    """Of {language: (ORDER + 1 bytes as one number, occurrences)}.

    `least`: contexts of three and four bytes that occur less often are left out, so that the model is small;
    with 1 it holds every context and code lengths are those of the whole trees.
    """

    def __init__(self, samples: dict[str, tuple[np.ndarray, np.ndarray]], least: int = LEAST) -> None:
        self.langs = sorted(samples)
        seen = np.unique(np.concatenate([[32], *(k >> 8 * s & 255 for k, _ in samples.values() for s in range(ORDER + 1))]).astype(int))
        self.size = a = len(seen) + 1  # the last stands for all bytes never seen, which no statistic tells apart
        self.klass = np.full(256, a - 1, np.int64)
        self.klass[seen] = np.arange(a - 1)
        self.models = []
        for lang in self.langs:
            raw, n = samples[lang]
            key = np.zeros(len(raw), np.int64)
            for s in range(ORDER, -1, -1):
                key = key * a + self.klass[raw >> 8 * s & 255]
            p = np.full((1, a), 1 / 256)
            for rows in (1, a):
                c = np.bincount(key % (rows * a), n, rows * a).reshape(rows, a)
                total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                both = np.maximum(1, total + kinds)
                p = np.where(c > 0, c / both, np.where(total > 0, kinds / both, 1.0) * p)
            trees = []
            for k in range(2, ORDER + 1):
                known, often = _sums(key % a ** (k + 1), n)
                context, total = _sums(known // a, often)
                at = np.searchsorted(context, known // a)
                kinds = np.bincount(at, minlength=len(context))
                keep = (total >= least) | (k == 2)
                cost, escape = bits(often / (total + kinds)[at]), bits(kinds / (total + kinds))
                trees.append((known[keep[at]], cost[keep[at]], context[keep], escape[keep]))
            self.models.append((bits(p.reshape(-1)), trees))

    def lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length in bits of each row in each language; a row starts after ORDER spaces."""
        n, a = len(at) - 1, self.size
        out = np.zeros((n, len(self.langs)))
        spaced, first = _spaced(data, at)
        c = self.klass[spaced]
        key = np.zeros(max(0, len(c) - ORDER), np.int64)
        for i in range(ORDER + 1):
            key = key * a + c[i : len(c) - ORDER + i]
        where, kinds = pd.factorize(key)
        # The distinct strings of each order, in order, so that they are found in the trees fast; languages share them.
        strings = []
        for k in range(2, ORDER + 1):
            known, to = np.unique(kinds % a ** (k + 1), return_inverse=True)
            context, up = np.unique(known // a, return_inverse=True)
            strings.append((known, to, context, up))
        for j, (dense, trees) in enumerate(self.models):
            cost = dense[kinds % (a * a)]
            for (known, to, context, up), (keys, best, contexts, escape) in zip(strings, trees):
                hit, i = _find(keys, known)
                held, e = _find(contexts, context)
                extra = np.where(held, np.append(escape, np.float32(0))[e], np.float32(0))[up]
                cost = np.where(hit[to], np.append(best, np.float32(0))[i][to], cost + extra[to])
            sums = np.concatenate([[0.0], np.cumsum(cost[where], dtype=np.float64)])
            out[:, j] = sums[first + np.diff(at)] - sums[first]
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each is among the sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), int)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[i] == wanted, i


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, least: int = LEAST) -> PPM:
    """Fits on about `rows` documents of each language, drawn by a hash of their id, outside the held-out fold.

    Texts of any length and all languages that have one are learnt; counts meet in Spark, so no text reaches the driver. The driver
    holds a language's different strings of ORDER + 1 bytes, at most as many as the bytes of its `rows` documents.
    """
    known = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & (crc_mod(F.col("doc_id"), 3) != 1)).select("lang", "doc_id", "text")
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    langs = known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs_"), F.min(hashed).alias("least_"))
    part = known.join(F.broadcast(langs), "lang").filter((hashed < F.lit(rows) * 1_000_000 / F.col("docs_")) | (hashed == F.col("least_")))

    def run(batches):
        for b in blocks(batches):
            texts: dict[str, list] = {}
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(lang, []).append(t)
            for lang, got in texts.items():
                key, n = counts(got)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["lang", "key", "n"])

    got = part.select("lang", "text").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    lang, key, n = got.column("lang").to_numpy(), got.column("key").to_numpy(), got.column("n").to_numpy()
    order = np.lexsort((key, lang)) if len(key) else np.zeros(0, int)
    lang, key, n = lang[order], key[order], n[order]
    starts = [i for i in range(len(lang)) if not i or lang[i] != lang[i - 1]]
    return PPM({lang[i]: (key[i:j], n[i:j]) for i, j in zip(starts, [*starts[1:], len(lang)])}, least)


def identify(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, lang_pred, score, of whole texts of any length.

    Texts that are null or hold no letter, or no learnt language: und, score 0. Of
    languages with equal code lengths the first by code point wins. Rows that
    repeat an id are judged each, equal texts alike. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    model = fit(docs, least=least)

    def run(batches):
        for b in blocks(batches):
            data, at = raw_bytes(b.column(1))
            letters = np.array([bool(_LETTER.search(t)) for t in b.column(1).to_pylist()])
            if not model.langs:
                pred, score = ["und"] * len(letters), np.zeros(len(letters))
            else:
                bits = model.lengths(data, at)
                odds = np.exp2(-np.minimum(1000, bits - bits.min(1, keepdims=True)))
                score = np.where(letters, odds.max(1) / odds.sum(1), 0.0)
                pred = [model.langs[k] if ok else "und" for k, ok in zip(bits.argmin(1), letters)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(pred), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = texts_of(docs, (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
