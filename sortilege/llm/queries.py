"""The operN queries, each a thin selection of its operator's result."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, conversations, decontaminate, exactdup, langid, license, mixing, neardup, periodic, quality, tokenfiles, toxicity, vectors


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _labels(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet")


def vocabulary() -> str:
    """The vocabulary that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _leaks(spark, d):
    found = decontaminate.scan(_docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))
    text = F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return found.drop("items").withColumn("spans", F.concat_ws(",", text))


QUERIES = {
    "op1_license": lambda s, d: license.scan(_docs(s, d)),
    "op2_exact_dedup": lambda s, d: exactdup.find_copies(_docs(s, d)).drop("keep_locator"),
    "op3_bpe": lambda s, d: bpe.encode(_docs(s, d), vocabulary(), scanned=True).drop("ids", "decoded"),
    "op4_token_files": lambda s, d: tokenfiles.round_trip(_docs(s, d), vocabulary()),
    "op5_quality": lambda s, d: quality.score(_docs(s, d), _labels(s, d)),
    "op6_near_dedup": lambda s, d: neardup.classes(_docs(s, d), size=2, percent=80),
    "op7_vectors": lambda s, d: vectors.neighbours(s.read.parquet(f"{d}/embeddings.parquet")),
    "op8_toxicity": lambda s, d: toxicity.score(_docs(s, d), _labels(s, d)),
    "op9_mixing": lambda s, d: mixing.mix(_docs(s, d)).drop("source"),
    "op10_langid": lambda s, d: langid.identify(_docs(s, d)),
    "op11_periodic": lambda s, d: periodic.scan(_docs(s, d), damage=True).drop("runs", "collapsed"),
    "op12_decontaminate": _leaks,
    "op13_conversations": lambda s, d: conversations.repair(s.read.parquet(f"{d}/conversations.parquet"), damage=True),
}

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op12_decontaminate": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        x AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
        l AS (SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM x),
        g AS (SELECT r, i, k, array_to_string(l[1 : k], ' ') AS g FROM l, (SELECT DISTINCT k FROM win) WHERE len(l) >= k),
        o AS (SELECT g.r, g.i, g.k, win.item_id FROM g JOIN win ON g.g = win.g AND g.k = win.k),
        h AS (SELECT DISTINCT r, unnest(range(i, i + k)) AS i FROM (SELECT DISTINCT r, i, k FROM o)),
        e AS (SELECT r, min(i) - 1 AS a, max(i) AS z FROM (SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS s FROM h) GROUP BY r, s),
        s AS (SELECT r, string_agg(a || '-' || z, ',' ORDER BY a) AS spans, sum(z - a)::BIGINT AS n_hit FROM e GROUP BY r),
        n AS (SELECT r, count(*) AS n_items, string_agg(c, ',' ORDER BY c COLLATE "C") AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS c FROM o WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
        FROM d LEFT JOIN s USING (r) LEFT JOIN n USING (r)""",
}
