"""The index against plain counting, and decontamination against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from sortilege.llm import decontaminate, fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for item, phrase in items:
            p = words(phrase)
            for i in range(max(1, len(p) - size + 1) if p else 0):
                g = p[i : i + size]
                at = [a for a in range(len(w) - len(g) + 1) if w[a : a + len(g)] == g]
                hit.update(x for a in at for x in range(a, a + len(g)))
                named.update({str(item)} if at and item is not None else ())
        edges = [(a, next(z for z in range(a, len(w) + 1) if z not in hit)) for a in sorted(hit) if a - 1 not in hit]
        yield str((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), len(hit) > 0, sorted(named), edges))


def test_words():
    texts = ["", "Ab,c  d", "ÉÀ x\u0085y 1-2", None, "...", "z"]
    got, counts = decontaminate.words_of(pa.array([t or "" for t in texts]))
    assert [x.decode() for x in got.to_pylist()] == [x for t in texts for x in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]


@pytest.mark.parametrize("alphabet, n", [(1, 1), (1, 300), (2, 400), (7, 500), (300, 900)])
def test_index(alphabet, n):
    rng = np.random.default_rng(n)
    text = rng.integers(0, alphabet + 1, n)
    text[n // 2 : n // 2 + n // 4] = text[: n // 4]  # a long repeat
    text[-1] = 0
    place = [tuple((0, i) if x == 0 else (1, x) for i, x in enumerate(text[a:].tolist(), a)) for a in range(n)]
    assert fmindex.suffix_order(text).tolist() == sorted(range(n), key=place.__getitem__)
    index = fmindex.FMIndex(text, every=5)
    assert index.locate(np.arange(n)).tolist() == sorted(range(n), key=place.__getitem__)
    for size in (1, 2, 4):
        phrases = np.array([text[a : a + size] for a in range(n - size) if text[a : a + size].all()] + [[alphabet] * size])
        low, high = index.search(np.concatenate([np.full((len(phrases), 2), -1), phrases], axis=1))
        for p, a, z in zip(phrases.tolist(), low, high):
            want = [i for i in range(n) if text[i : i + size].tolist() == p]
            assert sorted(index.locate(np.arange(a, z)).tolist()) == want


def test_wavelet_ranks():
    x = np.random.default_rng(3).integers(0, 11, 700)
    tree, at = fmindex.Wavelet(x, 4), np.arange(701)
    for v in range(11):
        assert tree.rank(np.full(701, v), at).tolist() == [0, *np.cumsum(x == v).tolist()]
    value, rank = tree.take(at[:-1])
    assert (value == x).all() and rank.tolist() == [(x[:i] == x[i]).sum() for i in range(700)]


ITEMS = [(1, "one two three four five six"), (2, "two three, FOUR five six seven eight"), (10, "Rare"), (None, "alpha beta gamma delta epsilon"), (3, ""), (4, None), (5, "one two three four five six"), (6, "... !"), (7, "absent words"), (1, "theta iota")]
BASE = "zero one two three four five six seven eight nine"
DOCS = [(1, BASE), (2, None), (3, ""), (4, " . "), (5, f"{BASE} {BASE}"), (5, BASE), (None, "rare"), (6, "alpha-beta.gamma delta epsilon zeta"), (7, "x " * 3000 + BASE.upper() + " y" * 3000), (8, "one two three"), (9, "Theta  iota rare rare"), (10, BASE)] + [(20 + i, "three four five six seven rare q") for i in range(40)]


@pytest.mark.parametrize("shard", [1 << 20, 50, 7])
def test_scan(spark, shard):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in DOCS], "doc_id long, text string, item long, items string, spans int")
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, item string")
    before, decontaminate.SHARD_WORDS = decontaminate.SHARD_WORDS, shard
    try:
        got = decontaminate.scan(df.coalesce(1), items, 5).collect()  # the driver's value goes along with the function
    finally:
        decontaminate.SHARD_WORDS = before
    rows = [str((*tuple(r)[:7], [tuple(s) for s in r.spans])) for r in got]
    assert sorted(rows) == sorted(brute(DOCS, ITEMS, 5))


def test_empty_tables(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.scan(df.limit(0), items).count() == 0
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.scan(df, items.limit(0)).collect())


def test_many_items_in_batches(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    monkeypatch.setattr(decontaminate, "ROWS", 3)
    d = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("cast(item_id as string) item", "coalesce(text, '') text")
    from sortilege.llm.scratch import Scratch

    scratch = Scratch(spark, "test")
    scratch.save(d.coalesce(1), "items")
    w, n = decontaminate.words_of(pa.array([t or "" for _, t in DOCS]))
    hit, held = decontaminate.search(w, n, decontaminate.Items(scratch.path("items")), 5)
    want = list(brute(DOCS, ITEMS, 5))
    ends = np.cumsum(n)
    assert [str(sorted(x - {None})) in w for x, w in zip(held, want)] == [True] * len(DOCS)
    assert [f", {hit[z - k : z].sum()}, " in w for z, k, w in zip(ends, n, want)] == [True] * len(DOCS)
