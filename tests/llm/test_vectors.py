"""The order of the traversal, its reach, many lengths, and recall against brute force."""

import numpy as np

from sortilege.llm import vectors


def test_traversal_is_in_order():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random(7) ** 2, rng.random(5) ** 2
        cost = (a[:, None] + b[None]).ravel()
        got = vectors.traverse(a, b, 0.6)
        assert sorted(got) == np.flatnonzero(cost <= 0.6).tolist() and (np.diff(cost[got]) >= 0).all()


def test_recall(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 32))
    rows = [(i, (base[i % 1500] + rng.normal(size=32) * 0.16 * (i >= 1500)).tolist(), i % 3) for i in range(3000)]
    got = {r.vec_id: r.n_links for r in vectors.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = vectors.unit([np.array(r[1], np.float32).astype(float).tolist() for r in rows])
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    want = near.sum(1) - 1
    assert want.sum() > 500 and sum(got.values()) >= 0.995 * want.sum() and all(got[i] <= want[i] for i in got)


def test_more_lengths_than_codebooks(spark):
    rows = [(100 * n + k, [float(1 + (j + n) % 5) * (1 + k) for j in range(n)], 1) for n in range(1, 9) for k in range(3)]
    before, vectors.LENGTHS = vectors.LENGTHS, 3
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    finally:
        vectors.LENGTHS = before
    assert got == {r[0]: (2, r[0] - r[0] % 100) for r in rows}


def test_repeated_ids_and_clashing_columns(spark):
    """Each vector of a repeated id has its own links; columns named as the operator's own change nothing; an empty table gives no rows."""
    from pyspark.sql import functions as F

    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (9, [1.0, 0.0], 1), (5, [1.0, 0.0], 2), (2, [-1.0, 0.0], 1), (2, [-1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    names = ["rep", "v", "times", "cell", "visits", "ok", "size", "least", "c", "l", "node", "component", "label_", "s", "a"]
    for d in (df, df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])):
        got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in vectors.neighbours(d).collect())
        assert got == sorted([("5", 2, "5", True), ("5", 1, "3", False), ("7", 2, "5", False), ("3", 1, "3", True), ("9", 2, "5", False), ("5", 0, "5", True), ("2", 1, "2", True), ("2", 1, "2", True), ("None", 0, "None", True)])
    assert vectors.neighbours(df.limit(0)).count() == 0


def test_border_cost_by_hand():
    rng = np.random.default_rng(1)
    x, codes = rng.normal(size=(40, 5)), rng.normal(size=(7, 5))
    near, cost = vectors.border_cost(x, codes)
    d = ((x[:, None] - codes[None]) ** 2).sum(2)
    assert (near == d.argmin(1)).all()
    gap = np.sqrt(((codes[:, None] - codes[None]) ** 2).sum(2))[near]
    want = ((d - d.min(1)[:, None]) / (2 * np.where(gap > 0, gap, 1))) ** 2
    assert np.allclose(cost, want, atol=1e-9)
