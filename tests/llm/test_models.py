"""The learning operators' formulas against loops and enumeration."""

import itertools
import math
import zlib

import numpy as np
import pytest

from sortilege.llm import quality, toxicity


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_chain_by_all_taggings(n):
    """Marginals and the gradient of the transitions, against a sum over every tagging."""
    rng = np.random.default_rng(n)
    model = object.__new__(toxicity.CRF)
    model.trans, x, q = rng.normal(size=(2, 2)), rng.normal(size=(n + 2, 3)) * 2, rng.random((n + 2, 3))
    lengths = np.array([n, n + 2, 1])
    p, move = model.chain(x, lengths, q)
    want = np.zeros((2, 2))
    for j, size in enumerate(lengths):
        weight = {}
        for tags in itertools.product((0, 1), repeat=int(size)):
            weight[tags] = math.exp(sum(x[i, j] for i in range(size) if tags[i]) + sum(model.trans[a, b] for a, b in zip(tags, tags[1:])))
        whole = sum(weight.values())
        for i in range(size):
            assert abs(p[i, j] - sum(w for t, w in weight.items() if t[i]) / whole) < 1e-9
        for i in range(1, size):
            for a, b in itertools.product((0, 1), repeat=2):
                due = (q[i - 1, j] if a else 1 - q[i - 1, j]) * (q[i, j] if b else 1 - q[i, j])
                want[a, b] += due - sum(w for t, w in weight.items() if (t[i - 1], t[i]) == (a, b)) / whole
    assert np.allclose(move, want, atol=1e-9)


def test_emission_gradient_is_target_less_marginal():
    """The log likelihood of a soft tagging changes with an emission as target less marginal says."""
    rng = np.random.default_rng(2)
    model = object.__new__(toxicity.CRF)
    model.trans, x = rng.normal(size=(2, 2)), rng.normal(size=(6, 1))
    tags = [0, 1, 1, 0, 1, 0]

    def likelihood(x):
        score = lambda t: sum(x[i, 0] for i in range(6) if t[i]) + sum(model.trans[a, b] for a, b in zip(t, t[1:]))
        return score(tags) - math.log(sum(math.exp(score(t)) for t in itertools.product((0, 1), repeat=6)))

    p, _ = model.chain(x, np.array([6]))
    for i in range(6):
        step = np.zeros_like(x)
        step[i] = 1e-5
        assert abs((likelihood(x + step) - likelihood(x - step)) / 2e-5 - (tags[i] - p[i, 0])) < 1e-6


def test_pair_loss_by_loops():
    rng = np.random.default_rng(1)
    w, good, bad = rng.normal(size=4), rng.normal(size=(5, 4)), rng.normal(size=(6, 4))
    d = np.array([g - b for g in good for b in bad])
    by_hand = sum(math.log(1 + math.exp(-sum(w[k] * (g[k] - b[k]) for k in range(4)))) for g in good for b in bad) / 30 + quality.SHRINK / 2 * sum(v * v for v in w)
    assert abs(quality.pair_loss(w, d) - by_hand) < 1e-12
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert abs((quality.pair_loss(w + step, d) - quality.pair_loss(w - step, d)) / 2e-6 - quality.pair_gradient(w, d)[k]) < 1e-6


def test_ranking_is_fitted_and_scores_follow(spark):
    """After the fit no step lowers the loss by much, good documents win their pairs, and the table's scores are the model's, row by row."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels)
    texts, y = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    z = {i: [(f - m) / s for f, m, s in zip(quality.text_features(t), model.mean, model.scale)] for i, t in texts.items()}
    raw = {i: sum(w * f for w, f in zip(model.w, v)) for i, v in z.items()}
    pairs = [(a, b) for a in y for b in y if y[a] == 1 and y[b] == 0]
    assert sum(raw[a] > raw[b] for a, b in pairs) > 0.75 * len(pairs)
    diff = np.array([np.subtract(z[a], z[b]) for a, b in pairs])
    assert quality.pair_loss(model.w, diff) < quality.pair_loss(np.zeros(len(model.w)), diff)
    odds = math.log(quality.THRESHOLD / (1 - quality.THRESHOLD))
    for r in quality.score(docs, labels).collect():
        want = 1 / (1 + math.exp(-max(-40, min(40, raw[r.doc_id] - model.cut + odds))))
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= quality.THRESHOLD)


def test_equal_texts_have_equal_scores(spark):
    rows = [(i, ["you moron now", "a fine day it is"][i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows + [(99, "you moron now")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    for got in (toxicity.score(df, lab).collect(), quality.score(df, lab).collect()):
        by = {}
        for r in got:
            by.setdefault(dict(rows + [(99, rows[0][1])])[r.doc_id], set()).add(round(r.score, 9))
        assert all(len(v) == 1 for v in by.values())


def test_every_labelled_row_is_fitted(spark, monkeypatch):
    """With one block the weights are the least of the loss of all pairs; with many, mean, scale and cut are still those of all rows, repeated ones too."""
    rows = [(i, "word " * (i % 23 + 1) + ("!!! " * (i % 4) if i % 3 else "fine. " * (i % 7)), int(i % 3 == 0 or i % 11 == 0)) for i in range(260)] + [(500 + i, "same text", int(i > 1)) for i in range(6)]
    docs, lab = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    mine = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    x, y = np.array([quality.text_features(r[1]) for r in mine]), np.array([r[2] for r in mine])
    for size in (512, 16):
        monkeypatch.setattr(quality, "BLOCK_ROWS", size)
        monkeypatch.setattr(quality, "PARTNERS", 3)
        m = quality.fit(docs, lab)
        assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.scale, x.std(0) + 1e-6)
        z = (x - m.mean) / m.scale
        assert abs(m.cut - np.quantile(z @ m.w, (y == 0).mean())) < 1e-9
        if size == 512:
            diff = (z[y == 1][:, None] - z[y == 0]).reshape(-1, z.shape[1])
            assert np.abs(quality.pair_gradient(m.w, diff)).max() < 1e-6
