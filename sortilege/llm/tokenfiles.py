"""Token files: flat unsigned integers and 64-bit document offsets, memory-mapped.

Documents are dealt by ranges of doc_id, so files in partition order are in
ascending doc_id order. Each task writes one pair of files under a name of its
own attempt; the manifest, which is written once, names the files that count.
A partition's base is the sum of the tokens before it.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _tokenizer, encode_words, id_type, open_fs, parts_of, split_words
from .scratch import Scratch
from .textblocks import blocks, texts_of

#: Mean bytes of text behind a file: LEAST where that gives no more files than four times the cores, else up to FILE_BYTES.
FILE_BYTES, LEAST = 512_000_000, 12_000_000
#: Encoded words that a worker remembers; id that ends a document.
MEMORY, END = 700_000, 1


class WordCache:
    """Ids of words as bytes of self.kind: 16 bits where every id fits, else 32; forgets all when MEMORY words are held."""

    def __init__(self, path: str, end: int = END) -> None:
        self.tok, self.known, self.parts = _tokenizer(path), {}, {}
        self.kind = id_type(self.tok, end)

    def learn(self, words: set) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self.known, self.parts, new = {}, {}, list(words)
        cut = [parts_of(w) for w in new]
        need = list({p for c in cut for p in c if p not in self.parts})
        self.parts.update(zip(need, encode_words(self.tok, need, self.kind)))
        for w, c in zip(new, cut):
            self.known[w] = b"".join([self.parts[p] for p in c])


@lru_cache(1)
def word_cache(path: str, end: int) -> WordCache:
    """One for each Python worker, which tasks use one after another."""
    return WordCache(path, end)


def write_files(docs: DataFrame, path: str, folder: str | None = None, end: int = END) -> tuple[DataFrame, str]:
    """Writes the files and returns the manifest and the folder.

    Manifest: file, part, docs, nulls (documents without an id, which come first), tokens, width (bytes of an id), base (tokens before it).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    folder = folder or scratch.path("files")
    rows = texts_of(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Ties of doc_id are dealt by a hash of the text, so that rows that repeat an id have one order.
    rows = rows.withColumn("tie", F.xxhash64("text"))
    files = max(1, -(-total // FILE_BYTES), min(total // LEAST, 4 * spark.sparkContext.defaultParallelism))
    rows = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def run(batches):
        fs, at = open_fs(folder)
        fs.create_dir(at, recursive=True)
        part, name = TaskContext.get().partitionId(), ""
        cache, tokens, offs, ids, nulls = word_cache(path, end), 0, [0], [], 0
        wide, last = int(cache.kind[-1]), np.array([end], cache.kind).tobytes()
        out = None
        for b in blocks(batches):
            if out is None:
                name = f"{part:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{at}/{name}.bin")
            lists = [split_words(t) for t in b.column(1).to_pylist()]
            cache.learn(set().union(*lists))
            for i, words in zip(b.column(0).to_pylist(), lists):
                data = b"".join(map(cache.known.__getitem__, words)) + last
                out.write(data)
                tokens += len(data) // wide
                offs.append(tokens)
                ids.append(i or 0)
                nulls += i is None
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{at}/{name}.idx") as f:
                f.write(np.array(offs, "<u8").tobytes() + np.array(ids, "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([nulls], pa.int64()), pa.array([tokens], pa.int64()), pa.array([wide], pa.int32())], ["file", "part", "docs", "nulls", "tokens", "width"])

    made = scratch.save(rows.select("doc_id", "text").mapInArrow(run, "file string, part int, docs long, nulls long, tokens long, width int"), "made")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return scratch.save(made.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "manifest"), folder


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the memory-mapped files."""
    def run(batches):
        fs, at = open_fs(folder)
        for b in batches:
            for name, docs, base, nulls, width in zip(*(b.column(k).to_pylist() for k in range(5))):
                local = isinstance(fs, pyarrow.fs.LocalFileSystem)
                get = (lambda e: np.memmap(f"{at}/{name}.{e}", np.uint8, "r")) if local else (lambda e: np.frombuffer(fs.open_input_stream(f"{at}/{name}.{e}").read(), np.uint8))  # noqa: B023
                index, data = get("idx"), get("bin")
                offs, ids = index[: 8 * (docs + 1)].view("<u8").astype(np.int64), index[8 * (docs + 1) :].view("<i8")
                data = data.view(f"<u{width}")
                crc = [zlib.crc32(data[a:z].astype("<u4").tobytes()) for a, z in zip(offs, offs[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=np.arange(docs) < nulls), pa.array(offs[:-1] + base), pa.array(np.diff(offs)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("file", "docs", "base", "nulls", "width", "part")
    n = max(1, manifest.count())
    return spread.repartition(n, "part").select("file", "docs", "base", "nulls", "width").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Writes and reads back: doc_id, start, n_tokens, ids_crc32.

    Null text is empty (the end id alone); texts of any length are written whole; a null doc_id comes first; rows that
    repeat an id stand side by side, in the order of a hash of their text; other
    columns are ignored; an empty table gives no rows.
    """
    return read_files(*write_files(docs, path))
