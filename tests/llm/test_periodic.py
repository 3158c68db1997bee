"""Runs of words against brute force, on made words and whole documents."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from sortilege.llm import periodic


def brute_runs(w, exponent, least):
    """Stretches of equal words q apart, for every q; a stretch belongs to the smallest q that gives it."""
    got = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                got.setdefault((i, j + q), q)
            i = j
    return sorted(((a, z, q) for (a, z), q in got.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent, least", [(2, 1), (3, 2), (4, 6)])
def test_runs(exponent, least):
    rng = random.Random(exponent)
    for _ in range(1500):
        w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randint(0, len(w)), rng.randint(1, 8)
            for i in range(a + p, min(len(w), a + rng.randint(1, 40))):
                w[i] = w[i - p]
        w = w + [9] * rng.randint(0, 1) + w[rng.randint(0, 3) :] if rng.random() < 0.4 else w
        want = brute_runs(w, exponent, least)
        assert sorted(periodic.runs(w, exponent, least), key=lambda r: (r[0], r[2])) == want
        assert periodic.find_runs(w, exponent, least) == want  # pieces lose none


def test_factors():
    rng = random.Random(7)
    for _ in range(300):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        at = 0
        for a, z, before in periodic.factors(w):
            assert a == at and (before < a and w[before : before + z - a] == w[a:z] if before >= 0 else z == a + 1 and w[a] not in w[:a])
            assert before < 0 or z == len(w) or not any(w[i : i + z - a + 1] == w[a : z + 1] for i in range(a))
            at = z
        assert at == len(w)


def expected(doc_id, text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 4, 6)
    gone = {i for a, z, q in runs for i in range(a + q, z)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return len(runs), *top, sha("".join(f"{a},{z - a},{q}\n" for a, z, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


TEXTS = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x " + "a b " * 4 + "c", "é\x85b " * 9, "a b\x0bc\x0cd\re " * 5, "ab " * 30 + "q " + "ab " * 30, "w " * 5000 + "v " * 5000, " ".join(f"u{i % 700}" for i in range(6300))]


def test_scan(spark):
    rows = [(i, t, 1, 2, "x") for i, t in enumerate(TEXTS)] + [(None, "a a a a a a a", 1, 2, "x"), (5, "b b b b b b b", 1, 2, "x")]
    rows += [(i, f"w0 w1 w2 {'w3 ' * (i % 5)}" * 9, 1, 2, "x") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, runs long, period string")
    got = sorted(map(str, (tuple(r)[:8] for r in periodic.scan(df, damage=True).collect())))
    assert got == sorted(str((r[0], *expected(r[0], r[1]))) for r in rows)
    assert periodic.scan(df.limit(0)).count() == 0
    plain = {r.doc_id: r for r in periodic.scan(spark.createDataFrame([(1, "x y y y y y y z")], "doc_id long, text string")).collect()}
    assert plain[1].collapsed == "x y z" and [tuple(r) for r in plain[1].runs] == [(1, 6, 1)]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:8] for r in periodic.scan(docs, damage=True).collect()}
    assert got == {r.doc_id: expected(r.doc_id, r.text) for r in docs.collect()}
    assert sum(r[0] for r in got.values()) > 20
