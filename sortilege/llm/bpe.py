"""BPE encoding and decoding through a table of distinct words.

Each scan task deals its texts, in their order, into blocks of bounded size and
names each block's distinct words. The words of all blocks meet in one table dealt
and sorted by word, where each distinct word is encoded once; its ids go back to a
side file for each block that holds it. A second scan deals the same blocks, joins
ids to pieces through the vocabulary, and puts both at the words' positions. So
words move between tasks, and texts never do.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textblocks import blocks, offsets, raw_bytes, settle, texts_of

#: Characters of text after which a block ends; rows of an Arrow batch of words.
BLOCK_CHARS, ROWS = 24_000_000, 50_000
#: Bytes of text joined at once; bytes of a row group of a side file, which holds many blocks.
SLICE_BYTES, GROUP_BYTES = 1_500_000, 4_000_000
#: Signs that may end a word; behind letters they are tokens of their own, but not behind a combining mark.
TAILS = ".,!?|"
_CONTROL = re.compile("[\x1c-\x1f]")
#: White space as the vocabulary's own split sees it, for texts where str.split would differ.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


# The rules of normalising, splitting and decoding under which words between white space are independent.
WORD_RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    None,
]


def split_words(text: str) -> list[str]:
    """Words between white space; the tokenizer never joins across it."""
    if _CONTROL.search(text):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """`split_words` of many texts: all words, and how many each text has."""
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
        lists = [split_words(t) for t in texts.to_pylist()]
        return pa.array(chain.from_iterable(lists), pa.string()), np.array([len(w) for w in lists])
    split = pc.utf8_split_whitespace(texts)
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), np.diff(upto[split.offsets.to_numpy() - split.offsets[0].as_py()])


def parts_of(word: str) -> tuple[str, ...]:
    """Parts of a word that the vocabulary's split never joins, so that fewer distinct ones are left.

    A letter that the vocabulary's NFC or lower case turns into letter and mark
    (U+0130, nukta letters) joins the signs behind it: such words stay whole.
    """
    core = word.rstrip(TAILS)
    if not core.isalpha():
        return (word,)
    if len(core) < len(word) and not (core.isascii() or unicodedata.normalize("NFC", core).lower().isalpha()):
        return (word,)
    low = core.lower() if core.isascii() else core
    return (low, word[len(core) :]) if len(core) < len(word) else (low,)


def cut_words(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """`parts_of` of many words: the parts, their numbers word by word, and where each word begins among these.

    Words of ASCII letters and tails are cut by Arrow, the others one by one.
    """
    core = pc.ascii_rtrim(words, characters=TAILS)
    plain = pc.and_(pc.string_is_ascii(words), pc.ascii_is_alpha(core))
    data, at = raw_bytes(words)
    size = np.diff(raw_bytes(core)[1])
    rest = np.diff(at) - size
    ends = np.concatenate([[0], np.cumsum(rest)])
    tail = data[np.repeat(at[:-1] + size - ends[:-1], rest) + np.arange(ends[-1])]
    tails = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(tail)])
    heads, other = pc.ascii_lower(core), pc.invert(plain)
    cut = [parts_of(w) for w in words.filter(other).to_pylist()]
    heads = pc.replace_with_mask(heads, other, pa.array([c[0] for c in cut], pa.string()))
    tails = pc.replace_with_mask(tails, other, pa.array([c[1] if len(c) > 1 else "" for c in cut], pa.string()))
    two = pc.greater(pc.binary_length(tails), 0).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(1 + two)])
    order = np.empty(first[-1], np.int64)
    order[first[:-1]] = np.arange(len(words))
    order[first[:-1][two] + 1] = len(words) + np.arange(two.sum())
    return pa.concat_arrays([heads, tails.filter(pa.array(two))]), order, first


@lru_cache(1)
def _loaded(path: str):
    """One for each Python worker; padding and truncation unused. Its rules are not looked at: the driver has done so."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation(), tok.no_padding()
    return tok


@lru_cache(1)
def _tokenizer(path: str):
    """`_loaded`, if its rules are those of this module. They are read from a copy as text, which takes as much memory again."""
    tok = _loaded(path)
    kind = json.loads(tok.to_str())
    if [kind["normalizer"], kind["pre_tokenizer"], kind["decoder"]] != WORD_RULES:
        raise ValueError(f"{path} splits or joins words by rules other than those that split_words and parts_of know")
    return tok


def id_type(tok, end: int = 0) -> str:
    """16 bits where every id fits, else 32."""
    return "<u2" if max(end, *tok.get_vocab(with_added_tokens=True).values()) < 65_536 else "<u4"


# The sign that stands for each byte in byte-level pieces; bytes of printing signs stand for themselves.
_PRINTING = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = {b: 256 + n for n, b in enumerate(sorted({*range(256)} - _PRINTING))}
#: Below it every letter is in NFC, and lower case of a letter does not depend on its neighbours.
LATIN = "\u0250"


def one_piece(word: str) -> str | None:
    """The one piece of byte-level signs that the rules make of a word of Latin letters; None of another word."""
    if not word.isalpha():
        return None
    if word.isascii():
        return word.lower()
    low = word.lower()
    if max(word) >= LATIN or not low.isalpha():
        return None
    return low.encode().decode("latin-1").translate(BYTE_SIGNS)


def encode_words(tok, words: list[str], kind: str) -> list[bytes]:
    """Ids of each word as bytes of `kind`.

    Words of Latin letters are one piece each, which goes straight to the vocabulary's model. The others go to the tokenizer
    in one text, parted by a special token, which splits a text before any other rule; a word that holds part of one goes alone.
    """
    wide = int(kind[-1])
    whole = not any(t.content.isalpha() for t in tok.get_added_tokens_decoder().values())
    pieces = [one_piece(w) if whole else None for w in words]
    tokenize, found, upto = tok.model.tokenize, [], [0]
    for p in pieces:
        if p is not None:
            found += [t.id for t in tokenize(p)]
            upto.append(len(found) * wide)
    data = np.array(found, kind).tobytes()
    mine = (data[a:z] for a, z in zip(upto, upto[1:]))
    others = iter(_encode_rest(tok, [w for w, p in zip(words, pieces) if p is None], kind))
    return [next(others) if p is None else next(mine) for p in pieces]


def _encode_rest(tok, words: list[str], kind: str) -> list[bytes]:
    special = next((i, t.content) for i, t in tok.get_added_tokens_decoder().items() if t.special and not t.normalized)
    alone = [i for i, w in enumerate(words) if special[1][:2] in w]
    rest = words if not alone else [w for w in words if special[1][:2] not in w]
    out, wide = [], int(kind[-1])
    for i in range(0, len(rest), 4000):
        ids = np.array(tok.encode_batch_fast([special[1].join(rest[i : i + 4000])], add_special_tokens=False)[0].ids, kind)
        cuts, data = np.flatnonzero(ids == special[0]), ids.tobytes()
        out += [data[a:z] for a, z in zip([0, *((cuts + 1) * wide).tolist()], [*(cuts * wide).tolist(), len(data)])]
    for i in alone:  # ascending, so that each comes to its place
        out.insert(i, np.array(tok.encode(words[i], add_special_tokens=False).ids, kind).tobytes())
    return out


def open_fs(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def token_texts(path: str) -> tuple[pa.Array, pa.Array]:
    """Each id of the vocabulary, and its piece, as text with a space behind: two columns as long as the vocabulary, whatever the input."""
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        pieces[i] = piece
    return pa.array([f"{i} ".encode() for i in range(len(pieces))], pa.binary()), pa.array([f"{p} ".encode() for p in pieces], pa.binary())


class Side:
    """The distinct words of one block and their ids, as two Arrow columns."""

    def __init__(self, block: int, words: pa.Array, ids: pa.Array, path: str, kind: str) -> None:
        self.block, self.words, self.ids, self.path, self.kind = block, words, ids, path, kind

    def find(self, words: pa.Array) -> pa.Array:
        """The ids of each word; those that are missing (rows dealt otherwise than in the first pass) are encoded now."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            new = pc.unique(words.filter(pc.is_null(at)))
            ids = encode_words(_loaded(self.path), new.to_pylist(), self.kind)
            self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, pa.array(ids, pa.binary())])
            at = pc.index_in(words, value_set=self.words)
        return self.ids.take(at)


class Blocks:
    """Deals the texts of one task into blocks: a block ends with the text that fills it."""

    def __init__(self) -> None:
        self.id, self.size = TaskContext.get().partitionId() << 24, 0

    def parts(self, texts: pa.Array):
        """(block, start, stop, whether the block ends there) of the stretches of texts that lie in one block each."""
        begin = 0
        for i, size in enumerate(pc.utf8_length(texts).to_pylist()):
            self.size += size
            if self.size >= BLOCK_CHARS:
                yield self.id, begin, i + 1, True
                self.id, self.size, begin = self.id + 1, 0, i + 1
        if begin < len(texts):
            yield self.id, begin, len(texts), False


def encoded(batches, path: str, kind: str):
    """Adds ids to batches (block, word) that are sorted by word, so that equal words are neighbours.

    Many small tasks follow each other in a worker: each gives the vocabulary and all that was taken with it back at its end.
    """
    yield from _encoded(batches, path, kind)
    _loaded.cache_clear()
    settle()


def _encoded(batches, path: str, kind: str):
    last = None, b""
    for b in batches:
        if not b.num_rows:
            continue
        coded = b.column(1).dictionary_encode()
        words = coded.dictionary.to_pylist()
        seen = words[0] == last[0]
        ids = ([last[1]] if seen else []) + encode_words(_loaded(path), words[seen:], kind)
        last = words[-1], ids[-1]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()).take(coded.indices)], ["block", "word", "ids"])


def encode(docs: DataFrame, path: str, scanned: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded, decoded_sha256, one row per row of docs.

    Null and empty texts have no ids and decode to nothing; one of any length is encoded whole, in the slice
    that it fills. Rows that repeat an
    id are encoded each; other columns are ignored; an empty table gives no rows.
    Rows are written first, so that both passes deal them alike, unless docs is
    said to be `scanned`, a table as read from its files. If the second pass is
    dealt otherwise all the same (executors lost or gained between the two), words
    that its side file lacks are encoded where they stand.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    rows = texts_of(docs)
    if not scanned:
        rows = scratch.save(rows, "docs")
    kind = id_type(_tokenizer(path))

    def distinct(batches):
        at, seen, last = Blocks(), [], None
        for b in blocks(batches, "text", SLICE_BYTES):
            for block, a, z, ends in at.parts(b.column(0)):
                seen.append(pc.unique(cut_words(pc.unique(words_in(b.column(0).slice(a, z - a))[0]))[0]))
                last = block
                if ends:
                    yield from named(block, seen)
                    seen = []
        if seen:
            yield from named(last, seen)

    def named(block, seen):
        words = pc.unique(pa.concat_arrays(seen))
        for i in range(0, len(words), ROWS):
            w = words.slice(i, ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), block)), w], ["block", "word"])

    words = rows.select("text").mapInArrow(distinct, "block long, word string").repartition("word").sortWithinPartitions("word")
    back = words.mapInArrow(lambda batches: encoded(batches, path, kind), "block long, word string, ids binary")
    # Side files are as many as shuffle partitions, each with whole blocks in order; a block's file is found by its number.
    files, side = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch.path("back")
    file = ((F.shiftright("block", 24) + F.col("block").bitwiseAND((1 << 24) - 1)) % files).cast("int")  # as file_of
    dealt = back.repartitionById(files, file).sortWithinPartitions("block")
    dealt.write.option("parquet.block.size", GROUP_BYTES).option("compression", "zstd").parquet(side)
    columns = spark.sparkContext.broadcast(token_texts(path))  # bounded by the vocabulary

    def side_of(block: int, names: dict) -> Side:
        fs, at = open_fs(side)
        if not names:
            for f in fs.get_file_info(pyarrow.fs.FileSelector(at)):
                if f.base_name.startswith("part-"):
                    names.setdefault(int(f.base_name.split("-")[1]), []).append(f.path)
        found = names.get(file_of(block, files), [])
        words, ids = pa.array([], pa.string()), pa.array([], pa.binary())
        if found:  # only row groups that hold the block are read
            got = pyarrow.dataset.dataset(found, filesystem=fs, format="parquet").to_table(columns=["word", "ids"], filter=pc.field("block") == block, use_threads=False)
            words, ids = (x.combine_chunks() for x in (got.column("word"), got.column("ids")))
        return Side(block, words, ids, path, kind)

    def assemble(batches):
        at, now, names = Blocks(), None, {}
        for b in blocks(batches, "text", SLICE_BYTES):
            for block, a, z, _ in at.parts(b.column(1)):
                if now is None or now.block != block:
                    now = side_of(block, names)
                yield joined(b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), now)
                settle()
        del now
        settle()

    def joined(doc_ids: pa.Array, texts: pa.Array, side: Side) -> pa.RecordBatch:
        """Ids and pieces at the places of the words of each text: ids are taken by the number of the word, pieces by id."""
        words, counts = words_in(texts)
        coded = words.dictionary_encode()
        parts, order, first = cut_words(coded.dictionary)
        found = side.find(parts).take(pa.array(order))
        raw, ends = raw_bytes(found)[0], offsets(found) // int(kind[-1])
        of_word = pa.ListArray.from_arrays(pa.array((ends - ends[0])[first], pa.int32()), pa.array(raw.view(kind).astype(np.int32)))
        taken = of_word.take(coded.indices)
        ids, at = taken.values, taken.offsets.to_numpy()[np.cumsum([0, *counts])]
        texts_ = [slices(column.take(ids), at) for column in columns.value]
        sha = [pa.array([hashlib.sha256(x).hexdigest() for x in t], pa.string()) for t in texts_]
        decoded = pa.array([bytes(x) for x in texts_[1]], pa.string())
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids), sha[0], decoded, sha[1]], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"])

    return rows.mapInArrow(assemble, SCHEMA)


def slices(column: pa.Array, at: np.ndarray) -> list[memoryview]:
    """The bytes of each stretch of rows, without the space behind the last."""
    data, to = raw_bytes(column)
    whole = memoryview(data)
    return [whole[a : max(a, z - 1)] for a, z in zip(to[at[:-1]].tolist(), to[at[1:]].tolist())]


def file_of(block: int, files: int) -> int:
    """The side file of a block: the blocks of one task, and those of its neighbours, lie in files of their own."""
    return ((block >> 24) + (block & (1 << 24) - 1)) % files


SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string"
