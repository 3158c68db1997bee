"""The pipeline's rows against plain Python, stage by stage, with nulls, repeats, extra columns and an empty table."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sortilege.llm import bpe, mixing, neardup, quality
from sortilege.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, norm string"


def saved(spark, path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(i % 3 > 0), 0) for i, r in enumerate(rows) if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def documents():
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        words = [f"w{rng.integers(400)}" for _ in range(60)]
        text = " ".join(words) if i % 3 else "!! " * 40 + str(i)  # a third is junk
        rows.append((i, text, "en", [None, "a", "b"][i % 3], 0, "x"))
    rows += [(100 + i, rows[3 * i + 1][1].replace(" ", "  "), "en", "a", 0, "x") for i in range(8)]
    rows += [(200 + i, rows[3 * i + 2][1] + " and more", "en", "b", 0, "x") for i in range(8)]
    return [*rows, (300, None, None, None, None, None), (301, "", "en", "a", 0, "x"), (None, "a b c d e f g", "en", "a", 0, "x"), (5, rows[5][1], "en", "a", 0, "x")]


def test_rows_by_hand(spark, tmp_path):
    rows = documents()
    d = saved(spark, tmp_path / "d", rows)
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels)
    left = [r for r in rows if model.scores(np.array([quality.text_features(r[1] or "")]))[0] >= quality.THRESHOLD]
    assert 0 < len(left) < len(rows)
    best = {}
    for r in sorted(left, key=lambda r: (r[0] is None, r[0] or 0)):
        best.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r[1] or ""), r)
    left = list(best.values())
    sets = {r[0]: neardup.shingles(r[1] or "", 5) for r in left if r[0] is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    left = [r for r in left if r[0] is None or root[r[0]] == r[0]]
    mixed = {r.doc_id: (r.taken, r.size) for r in mixing.mix(spark.createDataFrame(left, DOCS)).collect()}
    tok, want = bpe._tokenizer(vocabulary()), Counter()
    for r in left:
        taken, size = mixed[r[0]]
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += taken // size if size else 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, d).collect())
    assert got == +want


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    d = saved(spark, tmp_path / "e", documents())
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns({"n": F.lit(1), "rep": F.lit("r")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
    none = tmp_path / "none"
    spark.createDataFrame([], DOCS).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, str(none)).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_mix_targets_by_hand(spark, seed):
    """Targets of the mix by sharing the excess again and again."""
    rng = np.random.default_rng(seed)
    sizes = {None: 40, "a": 300, "b": 7, "c": 55, "d": 900}
    rows = [(i, "w " * int(rng.integers(1, 9)), "en", s, 0, "x") for i, s in enumerate(k for k, n in sizes.items() for _ in range(n))]
    got = {r.source: (r.source_size, r.target) for r in mixing.mix(spark.createDataFrame(rows, DOCS)).select("source", "source_size", "target").distinct().collect()}
    names = sorted((k for k in got if k is not None)) + [None]
    weight, total = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}, sum(s for s, _ in got.values())
    target, open_, left = {}, set(names), 1.5 * total
    while open_:
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        full = {k for k in open_ if share[k] > 2 * got[k][0]}
        if not full:
            target |= share
            break
        for k in full:
            target[k] = 2.0 * got[k][0]
            left -= target[k]
        open_ -= full
    assert all(abs(got[k][1] - target[k]) < 1e-6 * total for k in names)
