"""Benchmark decontamination: an FM-index for each shard of training text.

Each task deals its documents, in their order, into shards of bounded size and
indexes a shard's words. Every window of the benchmark's items is searched in every
index, in blocks; occurrences are located by sampled places and merged into spans.
Texts never move between tasks; the items lie in a table that tasks read in batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import open_fs
from .fmindex import FMIndex
from .scratch import Scratch
from .textblocks import blocks, raw_bytes, texts_of

#: Words of a shard; items read at a time; occurrences located at a time.
SHARD_WORDS, ITEMS, ROWS = 1 << 20, 5_000, 200_000
#: A window has so many words, or all of a shorter item.
WINDOW = 10

#: A-Z in lower case, other signs below 128 as white space; letters, digits and all bytes from 128 on as they are.
_CLEAN = np.array([c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts together, and how many each text has."""
    data, at = raw_bytes(texts)
    low = _CLEAN[data]
    inner = low != 32
    starts = inner.copy()
    starts[1:] &= ~inner[:-1]
    begin = at[:-1][at[:-1] < at[1:]]
    starts[begin] = inner[begin]
    at_word = np.flatnonzero(starts)
    letters = low[inner]
    ends = np.concatenate([np.cumsum(inner, dtype=np.int64)[at_word] - 1, [len(letters)]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at_word), [None, pa.py_buffer(ends), pa.py_buffer(letters)]), np.diff(np.searchsorted(at_word, at))


def windows(ids: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the items as rows of numbers, short ones filled up on the left, and the item of each."""
    of, first = [], np.cumsum(counts) - counts
    n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    of = np.repeat(np.arange(len(counts)), n)
    begin = first[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
    short = size - np.minimum(counts[of], size)
    columns = np.arange(size)[None] - short[:, None]
    rows = ids[np.minimum(begin[:, None] + np.maximum(columns, 0), len(ids) - 1)] if len(of) else np.zeros((0, size), np.int64)
    return np.where(columns < 0, -1, rows), of


class Items:
    """The benchmark's items in batches: (ids as text, words, number of words of each). A small table is read once for a task."""

    def __init__(self, path: str) -> None:
        self.path, self.held = path, None

    def _read(self) -> Iterator[tuple[list, pa.Array, np.ndarray]]:
        fs, at = open_fs(self.path)
        for b in pyarrow.dataset.dataset(at, filesystem=fs, format="parquet").to_batches(columns=["item", "text"], batch_size=ITEMS):
            if b.num_rows:
                yield b.column(0).to_pylist(), *words_of(b.column(1))

    def __iter__(self):
        if self.held is None:
            several = []
            for batch in self._read():
                several.append(batch)
                if len(several) > 4:
                    return self._read()
            self.held = several
        return iter(self.held)


def search(words: pa.Array, counts: np.ndarray, items: Items, size: int) -> tuple[np.ndarray, list[set]]:
    """Which words lie in an occurrence of a window, and the ids of the items that each document holds."""
    coded = words.dictionary_encode()
    n, docs = len(words), len(counts)
    hit, held = np.zeros(n + docs, bool), [set() for _ in range(docs)]
    ends = np.cumsum(counts + 1) - 1  # a 0 behind each document
    text = np.zeros(n + docs, np.int64)
    place = np.arange(n) + np.repeat(np.arange(docs), counts)
    text[place] = coded.indices.to_numpy() + 1
    index = FMIndex(text)
    for names, item_words, item_counts in items:
        ids = pc.fill_null(pc.index_in(item_words, value_set=coded.dictionary), -1).to_numpy().astype(np.int64) + 1
        phrases, of = windows(ids, item_counts, size)
        there = (phrases != 0).all(1)  # all its words occur in the shard
        phrases, of = phrases[there], of[there]
        low, high = index.search(phrases)
        lengths = (phrases >= 0).sum(1)
        edge, found = np.zeros(n + docs + 1, np.int32), np.flatnonzero(high > low)
        for some in _parts(high[found] - low[found]):
            w = found[some]
            many = high[w] - low[w]
            which = np.repeat(w, many)
            for a in range(0, len(which), ROWS):  # one window may occur very often
                part = which[a : a + ROWS]
                rows = low[part] + (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many))[a : a + ROWS]
                at = index.locate(rows)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + lengths[part], -1)
                pairs = np.unique(np.searchsorted(ends, at) * len(names) + of[part])
                for d, i in zip((pairs // len(names)).tolist(), (pairs % len(names)).tolist()):
                    held[d].add(names[i])
        hit |= np.cumsum(edge[:-1]) > 0
    return hit[place], held


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of neighbours of about ROWS together."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // ROWS)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return (slice(a, z) for a, z in zip(edges, edges[1:]) if z > a)


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"


def scan(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of docs: what of it stands in the benchmark `items` (item_id, text), and where.

    spans are stretches of words (numbered from 0, the end not included), merged where
    occurrences meet or overlap. Null and empty texts have no words; items without words are
    found nowhere; an item without an id marks words but is not named; items that repeat
    an id count once, items that repeat a text each; of equal documents each has its row, as
    have rows that repeat an id; other columns are ignored. An empty table of documents gives no rows,
    an empty benchmark no hits. A text longer than a shard is indexed in pieces that
    overlap by one word less than a window.
    """
    scratch = Scratch(docs.sparkSession, "benchmark")
    table = items.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    scratch.save(table, "items")
    path = scratch.path("items")

    def run(batches):
        known, ids, words, counts, n = Items(path), [], [], [], 0
        for b in blocks(batches):
            w, c = words_of(b.column(1))
            begin = 0
            for doc_id, k in zip(b.column(0).to_pylist(), c.tolist()):
                if n and n + k > SHARD_WORDS:
                    yield result(ids, words, counts, known)
                    ids, words, counts, n = [], [], [], 0
                ids.append(doc_id)
                words.append(w.slice(begin, k))
                counts.append(k)
                begin, n = begin + k, n + k
        if ids:
            yield result(ids, words, counts, known)

    def result(ids, words, counts, known):
        if len(ids) == 1 and counts[0] > SHARD_WORDS:
            hit, held = np.zeros(counts[0], bool), [set()]
            for a in range(0, counts[0], SHARD_WORDS):
                piece = words[0].slice(a, SHARD_WORDS + size - 1)
                h, i = search(piece, np.array([len(piece)]), known, size)
                hit[a : a + len(piece)] |= h
                held[0] |= i[0]
        else:
            hit, held = search(pa.concat_arrays(words), np.array(counts), known, size)
        ends = np.cumsum(counts)
        spans = [spans_of(hit[z - k : z]) for z, k in zip(ends.tolist(), counts)]
        n_hit = [sum(z - a for a, z in s) for s in spans]
        named = [sorted(x for x in h if x is not None) for h in held]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]
        i, span = pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [pa.array(ids, i), pa.array(counts, i), pa.array(n_hit, i), pa.array([len(x) for x in named], i), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit]), pa.array(named, pa.list_(pa.string())), pa.array([[{"start": a, "end": z} for a, z in s] for s in spans], span)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])

    return texts_of(docs).mapInArrow(run, SCHEMA)
