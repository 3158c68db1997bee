"""Fuzzy search for short licence notices.

A notice found with at most k edits holds one of k + 1 pieces of it unchanged
(pigeonhole), so exact seeds locate candidates; the regex library's bounded-error
matching then verifies a window around each and reports its span and edits.
"""

from __future__ import annotations

import bisect

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textblocks import blocks, texts_of

# Base phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Notices searched with edits: phrase, label, most edits.
FUZZY = [
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under the apache license", "apache", 3),
    ("apache license", "apache", 1),
    ("released under the mit license", "mit", 3),
    ("mit license", "mit", 1),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("boost software license", "bsl", 2),
    ("creative commons attribution", "cc-by", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
]
#: Names that an edit turns into other words: a notice that has one must have it unchanged.
NAMES = {"mit"}

_CLEAN = bytes((c | 32) if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
PATTERNS = [(p, BASE[p], 0, True) for p in BASE] + [(p, label, k, False) for p, label, k in FUZZY]


def pieces(phrase: str, k: int) -> list[tuple[int, str]]:
    cuts = [len(phrase) * i // (k + 1) for i in range(k + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class Finder:
    def __init__(self) -> None:
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (phrase, _, k, base) in enumerate(PATTERNS):
            for start, piece in pieces(f" {phrase} " if base else phrase, k):
                at.setdefault(piece, []).append((n, start))
        for piece, uses in at.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        # A notice with edits begins and ends where words do: the spaces around it take no edit.
        self.checks = [regex.compile(regex.escape(f" {p} ") if base else f"(?e) (?P<notice>{regex.escape(p)})" + "{e<=%d}(?= )" % k) for p, _, k, base in PATTERNS]
        self.names = [NAMES & set(p.split()) for p, *_ in PATTERNS]

    def spans(self, norm: str) -> list[tuple[int, int, int, int]]:
        """(pattern, start, end, edits) of each match in words joined by single spaces, with one before and after."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.seeds.iter(norm):
            for n, start in uses:
                phrase, _, k, base = PATTERNS[n]
                a = end + 1 - size - start - k - (not base)
                b = a + len(phrase) + 2 + 3 * k
                kept = windows.setdefault(n, [])
                if kept and a < kept[-1][1] and not base:
                    kept[-1][:] = [min(a, kept[-1][0]), max(b, kept[-1][1])]
                else:
                    kept.append([a, b])
        found = set()
        for n, kept in windows.items():
            for a, b in kept:
                a = max(0, a)
                for m in self.checks[n].finditer(norm[a:max(b, 0)]):
                    start, end = m.span(0 if PATTERNS[n][3] else "notice")
                    if self.names[n] <= set(m[0].split()):
                        found.add((n, a + start, a + end, sum(m.fuzzy_counts)))
        return sorted(found, key=lambda s: (s[1], s[0]))


def scan_text(text: str, finder: Finder) -> dict:
    words = text.encode().translate(_CLEAN).split()
    norm = " " + b" ".join(words).decode() + " "
    spans = finder.spans(norm) if words else []
    base, labels, best, starts = set(), set(), 0.0, []
    for n, start, end, edits in spans:
        phrase, label, _, exact = PATTERNS[n]
        labels.add(label)
        best = max(best, 1 - edits / len(phrase))
        if exact:
            base.add(label)
            starts.append(start)
    at = []
    if starts:
        gaps, i = [], norm.find(" ")
        while i >= 0:
            gaps.append(i)
            i = norm.find(" ", i + 1)
        at = [bisect.bisect_left(gaps, s) for s in starts]
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": best, "spans": [{"label": PATTERNS[n][1], "start": s, "end": e, "edits": d} for n, s, e, d in spans]}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document. Null and empty texts have no words and no hits; spans are offsets in the words joined by spaces, after one space.

    Spans of a notice run from left to right and do not overlap; of several fits the
    first is taken, with as few edits as its place allows. A notice with edits begins and ends
    at borders of words, and its names (`NAMES`) take no edit. Rows that repeat an id are
    scanned each; texts of any length are scanned whole, one at a time; an empty table gives no rows; other columns are ignored.
    """
    def run(batches):
        finder, span = Finder(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
        for b in blocks(batches):
            rows = [scan_text(t, finder) for t in b.column(1).to_pylist()]
            col = lambda k, t: pa.array([r[k] for r in rows], t)  # noqa: E731,B023
            i, s = pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([b.column(0), col("n_words", i), col("n_base", i), col("first_word", i), col("last_word", i), col("base_labels", s), col("labels", s), col("score", pa.float64()), col("spans", span)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return texts_of(docs).mapInArrow(run, SCHEMA)
