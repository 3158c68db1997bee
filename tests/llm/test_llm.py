"""Small tables with nulls, empty, long, tied and repeated rows against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortilege.llm import bpe, exactdup, langid, license, mixing, neardup, quality, tokenfiles, toxicity, vectors
from sortilege.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, norm string, digest string"
LONG = "the cat sat on " * 4000
BASE = " ".join(f"w{i}" for i in range(200))
TEXTS = ["", None, " \t\n", "a", "A  b\tc", "a b c", "A b c", LONG, LONG + "mat", BASE, BASE + " x", "y " + BASE, "Released under the MIT License.", "relesed under the mit licence now", "gnu general public license CC-BY", "é́ x\x1cy <|endoftext|> don't 42", "a b c"]


def table(spark, rows=None):
    rows = [(i, t, "en", "s" if i % 3 else None, 0, "n", "d") for i, t in enumerate(TEXTS)] + [(None, "a b c", None, None, None, None, None), (5, "a b c", "en", "s", 0, "n", "d")] if rows is None else rows
    return spark.createDataFrame(rows, DOCS)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, None if i == 3 else (i // 2) % 2) for i in range(len(TEXTS))] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def by(df, key="doc_id"):
    return {(r[key], i): r for i, r in enumerate(df.collect())}.values()


def test_license(spark):
    got = {r.doc_id: r for r in license.scan(table(spark)).collect()}
    assert got[12].base_labels == "mit" and got[12].n_base == 1 and got[12].first_word == 3
    assert got[13].base_labels == "" and got[13].labels == "mit" and 0 < got[13].score < 1
    assert got[14].base_labels == "cc-by,gpl" and (got[14].first_word, got[14].last_word) == (0, 4)
    assert got[1].n_words == 0 and got[1].first_word is None and got[9].labels == ""


def test_license_by_brute_force(spark):
    """Base columns on whole documents against a plain search; every edited notice is found, and each of two in a row."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in license.scan(docs).collect()}
    for d in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in d.text or ""))
        at = [(i, label) for phrase, label in license.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
    finder = license.Finder()
    for phrase, label, k in license.FUZZY:
        for edit in (lambda p: p, lambda p: p[: len(p) // 2] + p[len(p) // 2 + 1 :], lambda p: p[:5] + "x" + p[5:], lambda p: p[:-2] + "zz" if k > 1 else p):
            found = license.scan_text(f"see the {edit(phrase)} here", finder)
            assert label in found["labels"].split(","), (phrase, edit(phrase))
    two = license.scan_text("relesed under the mit license released under the mit license", finder)["spans"]
    assert [(x["start"], x["end"]) for x in two if x["end"] - x["start"] > 20] == [(1, 30), (31, 61)]


def test_license_borders():
    """Edits stay within whole words, and short names take none."""
    finder = license.Finder()
    for text in ("submit license", "summit license", "admit license", "it licensed under", "geheit licensed", "emit license", "mix license", "mit licenseholder", "apaches licensee"):
        assert license.scan_text(text, finder)["labels"] == "", text
    for text, label in (("MIT Licence", "mit"), ("apache licence", "apache"), ("gnu genral publik license", "gpl"), ("mit-licensed", "mit"), ("Mozila Public Licence", "mpl")):
        assert license.scan_text(f"under {text} here", finder)["labels"] == label, text


def test_license_adds_no_label_to_clean_text(spark):
    """The given documents hold base notices only: whatever the method adds there is a notice by hand."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert license.scan(docs).filter("labels <> base_labels").count() == 0


@pytest.mark.parametrize("files", [None, 1])
def test_exact(spark, files):
    df = table(spark).repartition(3)
    for digest in (exactdup.sha256, lambda c: F.substring(exactdup.sha256(c), 1, 1)):  # the second clashes
        got = exactdup.find_copies(df, digest, files).collect()
        assert len(got) == len(TEXTS) + 2
        want = {}
        for r in df.collect():
            want.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), []).append(r.doc_id)
        for t, ids in want.items():
            keep = min((i for i in ids if i is not None), default=None)
            for r in got:
                if r.doc_id in ids and r.doc_id is not None:
                    assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep), t
    assert exactdup.find_copies(table(spark, [])).count() == 0


def test_exact_over_several_calls(spark, tmp_path):
    """Rows of a second call find the copies among the first call's rows, whose texts are read by locator only; a clash of digests is told by bytes."""
    one, two = [(5, "a b"), (7, "q r"), (8, "only here")], [(3, "a  b"), (9, "q\tr"), (10, "new"), (11, "new"), (None, "q r")]
    for digest in (exactdup.sha256, lambda c: F.substring(exactdup.sha256(c), 1, 0)):  # of the second all agree
        folder = f"file://{tmp_path}/{digest is exactdup.sha256}"
        docs = spark.createDataFrame(one, "doc_id long, text string")
        docs.coalesce(1).write.parquet(f"{folder}/in")
        first = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdup.find_copies(spark.read.parquet(f"{folder}/in"), digest, folder=f"{folder}/state").collect()}
        assert first == {5: (5, 1, True), 7: (7, 1, True), 8: (8, 1, True)}
        again = exactdup.find_copies(spark.createDataFrame(two, "doc_id long, text string"), digest, folder=f"{folder}/state")
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in again.collect()}
        assert got == {3: (3, 2, True), 9: (7, 3, False), 10: (10, 2, True), 11: (10, 2, False), None: (7, 3, False)}
        third = exactdup.find_copies(spark.createDataFrame([(20, "only here")], "doc_id long, text string"), digest, folder=f"{folder}/state").first()
        assert (third.keep_id, third.group_size) == (8, 2)
        if digest is exactdup.sha256:
            assert "/in/part-" in third.keep_locator


def test_exact_batches_meet_in_the_state(spark):
    """Copies that come in different micro-batches meet."""
    df = spark.createDataFrame([(i, f"t {i % 7}") for i in range(70)], "doc_id long, text string").repartition(9)
    got = exactdup.find_copies(df).collect()
    assert {(r.doc_id % 7, r.keep_id, r.group_size) for r in got} == {(i, i, 10) for i in range(7)} and len(got) == 70


def test_exact_rows(spark):
    kept = exactdup.without_copies(table(spark)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15]


def test_bpe_and_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation(), t.no_padding()
    df = table(spark)
    enc = lambda x: t.encode(x or "", add_special_tokens=False).ids
    want = sorted((r.doc_id or -1, len(i := enc(r.text)), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r in df.collect())
    assert sorted((r.doc_id or -1, r.n_tokens, r.decoded_sha256) for r in bpe.encode(df, vocabulary()).collect()) == want
    got = sorted(tokenfiles.round_trip(df, vocabulary()).collect(), key=lambda r: r.start)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id is not None and r.doc_id != 5:
            assert r.ids_crc32 == zlib.crc32(np.array(enc(TEXTS[r.doc_id]) + [1], "<u4").tobytes())
    assert [r.doc_id for r in got][:2] == [None, 0]
    assert bpe.encode(table(spark, []), vocabulary()).count() == tokenfiles.round_trip(table(spark, []), vocabulary()).count() == 0


def test_letters_that_become_marks(spark):
    """Letters that NFC or lower case turn into letter and mark join the signs behind them."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation(), t.no_padding()
    texts = ["AL\u0130. bir", "\u0958. \u0958!", "\ufb2a. x", "\u0130 \u00c9t\u00e9. na\u00efve!", "\u0958\u0915.,"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    df = spark.createDataFrame([(i, x, "tr", "s", 0, "n", "d") for i, x in enumerate(texts)], DOCS)
    assert {r.doc_id: r.ids for r in bpe.encode(df, vocabulary()).collect()} == dict(enumerate(want))
    starts = np.cumsum([0] + [len(w) + 1 for w in want])
    for r in tokenfiles.round_trip(df, vocabulary()).collect():
        assert (r.start, r.n_tokens, r.ids_crc32) == (starts[r.doc_id], len(want[r.doc_id]) + 1, zlib.crc32(np.array(want[r.doc_id] + [1], "<u4").tobytes()))


@pytest.mark.parametrize("size", [2, 5])
def test_near(spark, size):
    rng = np.random.default_rng(size)
    near = [(100 + i, " ".join(f"z{i // 60}_{k}" if rng.random() > 0.012 * (i % 6) else f"q{rng.integers(9999)}" for k in range(150)), "en", "s", 0, "n", "d") for i in range(120)]
    rows = [tuple(r) for r in table(spark).collect()] + near
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], neardup.shingles(r[1] or "", size))
    root = {i: i for i in sets}
    ids = sorted(sets)
    for _ in range(len(ids)):
        before = dict(root)
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    got = neardup.classes(spark.createDataFrame(rows, DOCS), size).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.n_shingles) == (root[r.doc_id], len(sets[r.doc_id])), r.doc_id
    assert neardup.classes(table(spark, []), size).count() == 0


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = neardup.registers(h[:1000]), neardup.registers(h[200:])
    assert (neardup.merge(a, b) == neardup.registers(h)).all()
    j = neardup.joint_estimate(a[None], b[None], np.array([1000]), np.array([1300]))[0]
    assert abs(j - 800 / 1500) < 0.12


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in base[i % 20] + rng.normal(size=8) * 0.12 * (i % 3)], i % 2) for i in range(60)]
    rows += [(70, rows[0][1], 0), (71, None, 0), (72, [0.0] * 8, 0), (73, [float("nan")] * 8, 1), (74, rows[0][1], None), (75, [None] * 8, 0), (76, [1.0, 2.0], 0), (77, [2.0, 4.0], 0), (78, [], 0)]
    got = {r.vec_id: r for r in vectors.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    links = {r[0]: set() for r in rows}
    for a in rows:
        for b in rows:
            if a[0] != b[0] and a[2] is not None and a[2] == b[2] and a[1] and b[1] and len(a[1]) == len(b[1]) and None not in a[1] + b[1]:
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                n = np.linalg.norm(x) * np.linalg.norm(y)
                if n > 0 and x @ y / n >= 0.98 - 1e-12:
                    links[a[0]].add(b[0])
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in links.items()} and sum(map(len, links.values())) > 20
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        assert got[i].component_id == min(seen)


def test_mixing(spark):
    rows = [(i, "w " * (i % 7 + (400 if i == 9 else 0)), "en", [None, "a", "b", "c"][min(3, i % 10)], 0, "n", "d") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    sums = {}
    for r in got:
        assert r.taken <= 2 * r.size
        s = sums.setdefault(r.source, [0, r.target, r.source_size, 0])
        s[0] += r.taken
        s[3] = max(s[3], r.size)
    assert abs(sum(s[1] for s in sums.values()) - 1.5 * sum(s[2] for s in sums.values())) < 1e-6
    assert all(abs(s[0] - s[1]) <= s[3] for s in sums.values())
    assert mixing.mix(table(spark, [])).count() == 0
    rows_out = mixing.mixed_rows(table(spark))
    assert rows_out.columns == table(spark).columns


def test_models_take_odd_rows(spark):
    df, lab = table(spark), labels(spark)
    for got in (quality.score(df, lab), toxicity.score(df, lab), langid.identify(df)):
        rows = got.collect()
        assert len(rows) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}[1] == "und"
    for got in (quality.score(table(spark, []), lab), toxicity.score(df, lab.limit(0)), langid.identify(table(spark, [])), license.scan(table(spark, []))):
        got.collect()
    assert quality.accepted(df, lab).columns == df.columns


def test_toxic_spans():
    texts = [f"alpha beta {'moron' if i % 2 else 'gamma'} delta w{i % 9}" for i in range(80)]
    m = toxicity.CRF(texts, [i % 2 for i in range(80)])
    p = m.marginals([["alpha", "moron", "delta"], []])
    assert p[0][1] > 0.5 > p[0][0] and m.score(p[0]) > 0.7 > m.score(p[1])


@pytest.mark.parametrize("short_clean", [False, True])
def test_toxic_long_texts(short_clean):
    """Labelled texts of over 400 words train the weights too, whether or not there are short clean ones."""
    fill = lambda i: " ".join(f"w{(i * 7 + k) % 300}" for k in range(500))
    texts = [f"{fill(i)} {'moron' if i % 2 else 'gamma'} {fill(i + 3)}" for i in range(60)] + (["alpha beta w1"] * 20 if short_clean else [])
    toxic = [i % 2 for i in range(60)] + [0] * (len(texts) - 60)
    m = toxicity.CRF(texts, toxic)
    p = m.marginals([t.split() for t in texts])
    assert [int(m.score(x) >= toxicity.THRESHOLD) for x in p] == toxic
    assert m.weights("moron")[0] > 1.0 > m.weights("gamma")[0]  # towards the toxic tokens


def test_toxic_offsets_and_padding(spark):
    """Offsets are those of the text where lower case changes a length, and one very long text pads no others."""
    rows = [(i, f"w{i} a {'moron' if i % 2 else 'gamma'} b", "en", "s", 0, "n", "d") for i in range(60)] + [(100, "İİ a moron b", "tr", "s", 0, "n", "d"), (101, "w " * 700_000, "en", "s", 0, "n", "d")]
    got = {r.doc_id: r for r in toxicity.score(table(spark, rows), spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")).collect()}
    assert [(s.start, s.end) for s in got[100].spans] == [(5, 10)]
    assert got[100].predicted == 1 and got[101].predicted == 0


def test_toxic_very_long_text(spark):
    rows = [(i, "w1 w2 " * 8000 + ("moron" if i % 2 else "gamma"), "en", "s", 0, "n", "d") for i in range(30)]
    got = toxicity.score(table(spark, rows), spark.createDataFrame([(i, 0, i % 2) for i in range(30)], "doc_id long, quality int, toxic int"))
    assert {r.doc_id: r.predicted for r in got.collect()} == {i: i % 2 for i in range(30)}


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    q = quality.score(docs, lab).filter("held_out").join(lab, "doc_id")
    assert q.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
    t = toxicity.score(docs, lab).filter("held_out").join(lab, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in t) >= 0.95 * len(t) and sum(r.predicted for r in t if r.toxic) >= 0.7 * sum(r.toxic for r in t)
    n = langid.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert n.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_words_of_one_piece():
    """Words of Latin letters go to the vocabulary's model as the very piece that the rules make of them."""
    tok = bpe._tokenizer(vocabulary())
    letters = [c for c in map(chr, range(0x41, 0x24F)) if c.isalpha()]
    rng = np.random.default_rng(4)
    words = letters + ["".join(rng.choice(letters, rng.integers(2, 12))) for _ in range(3000)] + ["don't", "a1", "İstanbul", "ΣΑΣ", "é", "порт", "x<|y", "..."]
    assert bpe.encode_words(tok, words, "<u2") == [np.array(tok.encode(w, add_special_tokens=False).ids, "<u2").tobytes() for w in words]
    assert bpe.one_piece("Año") == "aÃ±o" and bpe.one_piece("İb") is None and bpe.one_piece("a1") is None
