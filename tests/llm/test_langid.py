"""Languages with long texts, and many scripts, against code lengths computed byte by byte."""

import zlib

import numpy as np

from sortilege.llm import langid

DOCS = "doc_id long, text string, lang string, source string, n_chars long, norm string, digest string"


def test_language_of_long_texts_and_all_bytes(spark):
    """Languages whose texts are all over 20,000 characters, and many scripts, are learnt; code lengths are exact."""
    rng = np.random.default_rng(3)
    scripts = {f"l{k}": [chr(0x400 + 90 * k + i) for i in range(60)] for k in range(8)} | {"long": list("abcdefghijklm"), "longer": list("NOPQRSTUVWXYZ0123456789")}
    rows = []
    for k, (lang, letters) in enumerate(scripts.items()):
        for i in range(12):
            rows.append((100 * k + i, "".join(rng.choice([*letters, " "], 21_000 if lang.startswith("long") else 600)), lang, "s", 0, "n", "d"))
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()} == {r[0]: r[2] for r in rows}
    m = langid.fit(docs)
    assert m.langs == sorted(scripts) and m.size > 97
    train = [r[1] for r in rows if r[2] == "l0" and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    tables = [{} for _ in range(langid.ORDER + 1)]
    for t in train:
        b = b" " * langid.ORDER + t.encode()
        for i in range(langid.ORDER, len(b)):
            for o in range(langid.ORDER + 1):
                c = tables[o].setdefault(b[i - o : i], {})
                c[b[i]] = c.get(b[i], 0) + 1

    def p(ctx, x, o, least):
        if o < 0:
            return 1 / 256
        c = tables[o].get(ctx[langid.ORDER - o :])
        if c is None or o > 2 and sum(c.values()) < least:
            return p(ctx, x, o - 1, least)
        return (c[x] if x in c else len(c) * p(ctx, x, o - 1, least)) / (sum(c.values()) + len(c))

    for least in (langid.LEAST, 1):  # with 1 no context is left out
        m = langid.fit(docs, least=least)
        for text in (train[0][:50], "xyz \u0d15", rows[20][1][:20]):
            b = b" " * langid.ORDER + text.encode()
            want = sum(-np.log2(p(b[i - langid.ORDER : i], b[i], langid.ORDER, least)) for i in range(langid.ORDER, len(b)))
            got = m.lengths(np.frombuffer(text.encode(), np.uint8), np.array([0, len(b) - langid.ORDER]))[0, m.langs.index("l0")]
            assert abs(got - want) < 1e-3 * want


def test_ties_and_repeats(spark):
    """Languages that learnt the same text tie: the first by code point wins, with half the score; repeated rows agree."""
    rows = [(i, "same words here", ["b", "a"][i % 2], "s", 0, "n", "d") for i in range(40)] + [(99, "same words here", None, "s", 0, "n", "d")] * 2
    counts = {x: sum(r[2] == x and zlib.crc32(str(r[0]).encode()) % 3 != 1 for r in rows) for x in "ab"}
    got = {(r.lang_pred, round(r.score, 6)) for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == 1 and (counts["a"] != counts["b"] or got == {("a", 0.5)})
