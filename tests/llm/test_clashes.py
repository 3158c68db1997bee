"""Extra columns with clashing names, shuffled input, repeated and odd ids; each operator gives what it gives without them."""

import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortilege.llm import bpe, exactdup, langid, license, mixing, neardup, quality, scratch, tokenfiles, toxicity
from sortilege.llm.queries import vocabulary

NAMES = "k_id k_rows k_norm t_copies t_times t_source n least held_out spans sha_ g_id gone_id low copies size hash c0_ rep key set_hash word block part tie times nth".split()
TEXTS = ["a b c d e f", "a  b c\td e f", None, "", "Zwei drei vier", " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(81)), "you moron", "x y z"]


def plain(spark):
    rows = [(i, t, ["en", "de"][i % 2], ["s", None][i % 3 == 0], 0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def wide(spark):
    return plain(spark).select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 7)) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")


QUERIES = {
    "license": lambda d, s: license.scan(d),
    "exact": lambda d, s: exactdup.find_copies(d).drop("keep_locator"),
    "bpe": lambda d, s: bpe.encode(d, vocabulary()),
    "files": lambda d, s: tokenfiles.round_trip(d, vocabulary()),
    "quality": lambda d, s: quality.score(d, labels(s)),
    "near": lambda d, s: neardup.classes(d, 5),
    "toxic": lambda d, s: toxicity.score(d, labels(s)),
    "mix": lambda d, s: mixing.mix(d),
    "lang": lambda d, s: langid.identify(d),
}


@pytest.mark.parametrize("name", QUERIES)
def test_clashing_columns(spark, name):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(QUERIES[name](wide(spark), spark)) == rows(QUERIES[name](plain(spark), spark))


def test_stages_keep_columns(spark):
    df = wide(spark)
    for got in (quality.accepted(df, labels(spark)), exactdup.without_copies(df), neardup.one_of_each(df), mixing.mixed_rows(df)):
        assert got.columns == df.columns
        assert all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in got.collect())
    assert sorted(r.doc_id for r in neardup.one_of_each(df).collect()) == [0, 2, 3, 4, 5, 7, 8]


def test_bpe_of_shuffled_files(spark):
    """Rows that a shuffle deals in another order are encoded all the same, also where a side file lacks their words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.ids_sha256 for r in bpe.encode(docs, vocabulary(), scanned=True).collect()}
    assert {r.doc_id: r.ids_sha256 for r in bpe.encode(docs.repartition(3), vocabulary()).collect()} == want
    block, bpe.BLOCK_CHARS = bpe.BLOCK_CHARS, 50_000
    try:
        assert {r.doc_id: r.ids_sha256 for r in bpe.encode(docs.repartition(3).sort(F.rand()), vocabulary(), scanned=True).collect()} == want
    finally:
        bpe.BLOCK_CHARS = block


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_with_special_tokens():
    tok = bpe._tokenizer(vocabulary())
    words = ["a", "b<|endoftext|>c", "<|startoftext|>", "d<|", "e", "|>", "<", "f."] * 600
    got = bpe.encode_words(tok, words, "<u2")
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [tok.encode(w, add_special_tokens=False).ids for w in words]


def test_least_and_missing_ids_in_files(spark):
    rows = [(None, "a"), (-(2**63), "b c"), (2**63 - 1, "d"), (None, None)]
    got = sorted(tokenfiles.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -(2**63), 2**63 - 1]
    assert sum(r.n_tokens for r in got) == 4 + 4
    assert got[2].ids_crc32 == zlib.crc32(np.array(bpe._tokenizer(vocabulary()).encode("b c").ids + [1], "<u4").tobytes())


def test_ids_with_several_texts(spark):
    far, near = " ".join(f"p{i}" for i in range(50)), " ".join(f"q{i}" for i in range(50))
    rows = [(5, far), (5, near), (3, far), (7, near + " end"), (9, far), (9, far), (1, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.classes(df, 2).collect()}
    assert got == {(5, 49): 3, (3, 49): 3, (7, 50): 3, (9, 49): 3, (1, 2): 1}
    kept = exactdup.without_copies(df)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, near), (3, far), (7, near + " end"), (1, "a b c")])


@pytest.mark.parametrize("central", [True, False])
def test_large_near_group(spark, central):
    """A group of several blocks, whether or not some member is close to all: one class per brute force, and few rows."""
    rng = np.random.default_rng(4)
    texts = []
    for i in range(700):
        w = [f"g{k}" for k in range(60)]
        for k in rng.choice(60, (0 if central and i < 3 else int(rng.integers(1, 9))), replace=False):
            w[k] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(w))
    sets = [neardup.shingles(t, 2) for t in texts]
    inc = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    x = np.zeros((len(sets), len(inc)), np.float32)
    for i, s in enumerate(sets):
        x[i, [inc[k] for k in s]] = 1
    common, n = x @ x.T, x.sum(1)
    linked = 100 * common >= 80 * (n[:, None] + n[None] - common)
    low = neardup.lowest(linked, np.arange(len(sets)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.classes(df, 2).collect()} == dict(enumerate(low.tolist()))


def test_common_counts_by_columns():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = neardup.common_counts(sets, wide=16)
    assert (got - np.diag(np.diag(got)) == np.array(want) - np.diag([len(s) for s in sets])).all()


def test_cluster_without_shared_folder_is_refused():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError):
        scratch.shared_dir(Session)


def test_words_cut_by_arrow():
    """The parts of many words at once are those of each."""
    import pyarrow as pa

    words = ["a", "A.b", "Abc.,", "x|", "...", "1", "1.", "ALİ.", "क़.", "Été!", "é", "naïve?", "ABC", "z!?", "don't", "don't.", "", "日本.", "ß,"]
    parts, order, first = bpe.cut_words(pa.array(words, pa.string()))
    got = [parts.take(pa.array(order[a:z])).to_pylist() for a, z in zip(first, first[1:])]
    assert got == [list(bpe.parts_of(w)) for w in words]
    assert bpe.cut_words(pa.array(["q"] + words, pa.string()).slice(1))[0].to_pylist() == parts.to_pylist()


def test_words_split_by_arrow():
    """Arrow splits at the signs that str.split splits at, of all planes; texts with control signs go their own way."""
    import sys

    import pyarrow as pa

    texts = ["", " ", "a", " a  b\tc ", "a\x85b\xa0c d　", "x​y﻿z", "\x0b\x0c"]
    texts += [f"a{chr(c)}b" for c in range(sys.maxunicode + 1) if not (0xD800 <= c < 0xE000 or 0x1C <= c < 0x20)]
    words, counts = bpe.words_in(pa.array(texts, pa.string()))
    assert counts.tolist() == [len(t.split()) for t in texts] and words.to_pylist()[:60] == [w for t in texts for w in t.split()][:60]
    mixed = ["p q", "a\x1cb c\x1f", " "]
    words, counts = bpe.words_in(pa.array(["left", *mixed], pa.string()).slice(1))
    assert words.to_pylist() == [w for t in mixed for w in bpe.split_words(t)] and counts.tolist() == [2, 2, 0]
    assert bpe.words_in(pa.array(["left out", "p q", " r"], pa.string()).slice(1))[0].to_pylist() == ["p", "q", "r"]


def test_workers_give_memory_back():
    """A worker that has encoded words holds little more than before, however many tasks it had, and reads the rules of no vocabulary."""
    code = """
import re
import numpy as np, pyarrow as pa
from tokenizers import Tokenizer
from sortilege.llm import bpe
from sortilege.llm.queries import vocabulary
from sortilege.llm.textblocks import settle
held = lambda: sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
bpe._tokenizer = None
words = pa.array(sorted(f"w{i * 7919 % 100003}" for i in range(20_000)))
batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), words], ["block", "word"])
settle()
before = held()
for _ in range(6):
    n = sum(b.num_rows for b in bpe.encoded(iter([batch.slice(0, 9_000), batch.slice(0, 0), batch.slice(9_000)]), vocabulary(), "<u2"))
assert n == len(words) and bpe._loaded.cache_info().currsize == 0
print(held() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < 15


def test_exact_copies_need_no_python_worker(spark, tmp_path, monkeypatch):
    """The pipeline's second stage makes no rows by the driver's Python: they would keep a second set of workers in each executor."""
    rows = [(1, "a b"), (2, "a  b"), (3, None), (4, ""), (5, "c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/rows")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none")

    def refused(*args, **kwargs):
        raise AssertionError("rows made by the driver's Python")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    left = exactdup.without_copies(spark.read.parquet(f"{tmp_path}/rows"))
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 5]
    assert exactdup.without_copies(spark.read.parquet(f"{tmp_path}/none")).collect() == []
