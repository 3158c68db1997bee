"""Near-duplicate documents by SetSketch registers.

Register i of a set is K = floor(1 - log_b(x)), where x is the smallest of its
elements' exponential hash values, truncated to 0..q+1; sketches of parts merge by
the greater register. Registers are banded. In each bucket the members are
compared with its most central member; where that leaves several classes, the
members outside the largest class are compared with all others in bounded blocks.
Candidates are kept by a joint likelihood estimate of their similarity and confirmed
on the full sets of 64-bit shingle hashes. Blocks report one row per linked
member, not its pairs, so that rows grow with members whatever a group's size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, numbered
from .textblocks import blocks, gathered, runs, texts_of

BANDS, ROWS = 42, 6
M = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 65_535
#: A pair is read in full if its estimate lies less than so many standard errors under the threshold.
SLACK = 4.5
#: Members of a bucket in one block, two of which meet at a time; bytes of sets that one slice of pairs holds.
BLOCK, SET_BYTES = 256, 8_000_000
#: Word hashes that a task remembers.
MEMORY = 200_000
#: Ids sent to every executor up to this number (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 2**31, M, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 2**32, M, dtype=np.uint64).astype(np.uint32)
_MIX = (_rng.integers(0, 2**62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def words_of(text: str) -> list[bytes]:
    """Words of the contract: A-Z lower-cased, split at ASCII white space."""
    return text.encode().lower().split()


def shingles(text: str, size: int) -> set:
    w = words_of(text)
    if not w:
        return set()
    return set(zip(*(w[i:] for i in range(size)))) if len(w) >= size else {tuple(w)}


class WordHashes(dict):
    """64-bit hashes of words; forgets all when MEMORY words are held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(word_hash: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the shingles of one text."""
    n = max(1, len(word_hash) - size + 1)
    out = np.full(n, len(word_hash) if len(word_hash) < size else size, np.uint64)
    for i in range(min(size, len(word_hash))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + word_hash[i : i + n])
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    low = np.full(M, 2**32 - 1, np.uint32)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    room = np.empty((512, M), np.uint32)
    for i in range(0, len(h), 512):
        part = h[i : i + 512, None]
        out = np.multiply(part, _A, out=room[: len(part)])
        out += _B
        np.minimum(low, out.min(0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


@lru_cache(1)
def _grid() -> np.ndarray:
    return np.linspace(0, 1, 201)


def joint_estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows), given the sets' sizes."""
    more, less = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = _grid()[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    like = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + (M - more - less) * np.log(np.maximum(1 - up - down, 1e-12))
    return j[np.arange(len(j)), like.argmax(1)]


SKETCH = "doc_id long, n_shingles long, set_hash binary, regs binary, keys array<long>"


def sketch(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        known = WordHashes()
        for b in blocks(batches):
            ids, ns, sets, regs, keys = [], [], [], [], []
            lists = [words_of(t) for t in b.column(1).to_pylist()]
            flat = [w for x in lists for w in x]
            hashed = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
            at = 0
            for doc, x in zip(b.column(0).to_pylist(), lists):
                ids.append(doc)
                if not x:
                    ns.append(0), sets.append(None), regs.append(None), keys.append(None)
                    continue
                h = np.unique(shingle_hashes(hashed[at : at + len(x)], size))
                at += len(x)
                r = registers(h)
                key = _mix((r.astype(np.uint64).reshape(BANDS, ROWS) * _MIX).sum(1) + np.arange(BANDS, dtype=np.uint64))
                ns.append(len(h))
                sets.append(np.array([len(h), h.sum(dtype=np.uint64), _mix(h).sum(dtype=np.uint64)], np.uint64).tobytes())
                regs.append(r.tobytes())
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(sets, pa.binary()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "regs", "keys"])

    return texts_of(docs).mapInArrow(run, SKETCH)


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, set): the sorted shingle hashes of each text of the wanted nodes (w)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    few = wanted.count() <= BROADCAST_ROWS
    texts = texts.join(F.broadcast(wanted) if few else wanted, F.col("node") == F.col("w"), "left_semi")

    def run(batches):
        known = WordHashes()
        for b in blocks(batches):
            ids, sets = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = words_of(text)
                if x:
                    hashed = np.fromiter(map(known.__getitem__, x), np.uint64, len(x))
                    ids.append(doc)
                    sets.append(np.unique(shingle_hashes(hashed, size)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    return texts.mapInArrow(run, "node long, set binary")


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are links: size filter, likelihood estimate, then the full sets."""
    side = lambda s: reps.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    met = met.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "na", "nb", "ra", "rb")
    t = percent / 100
    floor = t - SLACK * (t * (1 - t) / M) ** 0.5

    def likely(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                c = b.slice(i, 2000)
                wide = lambda k: np.frombuffer(b"".join(c.column(k).to_pylist()), np.uint16).reshape(-1, M)  # noqa: E731,B023
                j = joint_estimate(wide(4), wide(5), c.column(2).to_numpy(), c.column(3).to_numpy())
                keep = pa.array(j >= floor)
                yield pa.RecordBatch.from_arrays([c.column(0).filter(keep), c.column(1).filter(keep)], ["a", "b"])

    near = scratch.save(met.mapInArrow(likely, "a long, b long"), "near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    sets = scratch.save(sets_of(docs, wanted, size), "sets-near")
    both = near.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").select("a", "b", "sa", "sb")

    def full(batches):
        for b in blocks(blocks(batches, 2, SET_BYTES), 3, SET_BYTES):
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    links = scratch.save(both.mapInArrow(full, "a long, b long"), "links-star")
    scratch.drop("near", "sets-near")
    return links


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, are links."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def common_counts(sets: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of a bounded number of columns of the incidence matrix."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1  # a shingle of one set alone is common to none
    row, column = row[shared], np.cumsum(first[shared]) - 1
    out = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers up to 2**24 are exact
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, z = np.searchsorted(column, [at, at + wide])
        x = np.zeros((len(sets), wide), np.float32)
        x[row[a:z], column[a:z] - at] = 1
        out += x @ x.T
    return out.astype(np.int64)


def lowest(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches by links of a symmetric matrix."""
    low, top = ids.copy(), np.iinfo(np.int64).max
    while True:
        new = np.minimum(low, np.where(linked, low[None], top).min(1))
        if (new == low).all():
            return low
        low = new


def between_classes(members: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that tie together the classes of members (task, rep, component) that meet in a task.

    Registers show which members have a likely partner of another class in
    their task; only these are compared on their full sets. Each of them yields
    one row at most: the smallest member that it reaches there.
    """
    t = percent / 100
    least = (t - (SLACK + 1) * (t * (1 - t) / M) ** 0.5) * M
    by_task = lambda df: df.repartition("task").sortWithinPartitions("task")

    def suspects(batches):
        return gathered(map(of_task, runs(batches)))

    def of_task(g):
        r = np.frombuffer(b"".join(g.column(4).to_pylist()), np.uint16).reshape(-1, M)
        comp, n = g.column(2).to_numpy(), g.column(3).to_numpy()
        kinds, at, often = np.unique(comp, return_inverse=True, return_counts=True)
        hit = np.zeros(len(r), bool)
        for k in np.flatnonzero(at != often.argmax()):  # a pair of two classes has a member outside the largest one
            other = np.flatnonzero((at != at[k]) & (np.minimum(n, n[k]) * 100 >= np.maximum(n, n[k]) * percent))
            other = other[(r[other] == r[k]).sum(1) >= least]
            hit[other] = True
            hit[k] |= len(other) > 0
        keep = pa.array(hit)
        return pa.RecordBatch.from_arrays([g.column(k).filter(keep) for k in range(3)], ["task", "rep", "component"])

    m = members.join(reps.select("rep", "n_shingles", "regs"), "rep").select("task", "rep", "component", "n_shingles", "regs")
    some = scratch.save(by_task(m).mapInArrow(suspects, "task long, rep long, component long"), "suspects")
    sets = scratch.save(sets_of(docs, some.select(F.col("rep").alias("w")).distinct(), size), "sets-rest")

    def verified(batches):
        return gathered(map(links_of_task, runs(batches)))

    def links_of_task(g):
        rep, comp = g.column(1).to_numpy(), g.column(2).to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in g.column(3).to_pylist()]
        n, common = np.array([len(x) for x in sets]), common_counts(sets)
        linked = (common > 0) & (100 * common >= percent * (n[:, None] + n[None] - common)) & (comp[:, None] != comp[None])
        low = lowest(linked, rep)
        far = np.flatnonzero(low != rep)
        return pa.RecordBatch.from_arrays([pa.array(rep[far]), pa.array(low[far])], ["a", "b"])

    met = some.join(sets, F.col("rep") == F.col("node")).select("task", "rep", "component", "set")
    links = scratch.save(by_task(met).mapInArrow(verified, "a long, b long").distinct(), "links-rest")
    scratch.drop("suspects", "sets-rest")
    return links


def block_tasks(left: DataFrame) -> DataFrame:
    """Deals members (key, rep, component) of buckets with several classes into tasks of at most two blocks.

    A bucket of BLOCK members or fewer is one task. In a larger one, blocks of
    members outside the largest class meet each other and the blocks of that
    class, whose own pairs need no comparison.
    """
    sizes = left.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    split = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("classes"), F.max(F.struct("c", "component")).alias("top")).filter("classes > 1")
    small, main = F.col("m") <= BLOCK, F.col("component") == F.col("top.component")
    u = F.when(small, 1).otherwise(F.ceil((F.col("m") - F.col("top.c")) / BLOCK)).cast("int")
    v = F.when(small, 0).otherwise(F.ceil(F.col("top.c") / BLOCK)).cast("int")
    x = left.join(split, "key").withColumn("u", u).withColumn("v", v).withColumn("main", main & ~small)
    block = F.when(F.col("main"), F.col("u") + F.pmod(F.xxhash64("rep"), F.greatest("v", F.lit(1)))).otherwise(F.pmod(F.xxhash64("rep"), F.col("u"))).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.when(F.col("main"), F.col("u") - 1).otherwise(F.col("u") + F.col("v") - 1)))
    x = x.withColumn("block", block).withColumn("o", meets)
    # Two tasks whose hashes agree are merely compared together.
    return x.select(F.xxhash64("key", F.least("block", "o"), F.greatest("block", "o")).alias("task"), "rep", "component")


def distinct_buckets(members: DataFrame) -> DataFrame:
    """Keys of the buckets (key, rep), one for all that hold the same members, told by their number and two 64-bit hashes."""
    x = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    return x.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")


def classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents with equal sets (told by a 192-bit digest) share one
    representative, so thousands of copies meet as one. Texts of any length are shingled whole; a similarity
    of just `percent` links. Null, empty and blank
    texts link with nothing; a null doc_id links with nothing; rows that repeat a
    doc_id are one document, which has the links of all of its texts. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    all_ = scratch.save(sketch(docs, size), "sketch")
    some = all_.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = scratch.save(some.groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "sets")
    own = some.join(sets.select(F.col("set_hash").alias("s"), "rep"), (F.col("doc_id") == F.col("rep")) & (F.col("set_hash") == F.col("s")))
    reps = scratch.save(own.select("rep", "set_hash", "n_shingles", "regs", "keys").dropDuplicates(["rep", "set_hash"]), "reps")
    rows = reps.select("rep", F.explode("keys").alias("key"))
    shared = scratch.save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    met = scratch.save(rows.join(shared, "key").select("key", "n", "rep"), "met")
    kept = scratch.save(distinct_buckets(met), "buckets")
    central = met.groupBy("rep").agg(F.sum("n").alias("w"))
    members = scratch.save(met.join(kept, "key", "left_semi").join(central, "rep").select("key", "rep", "w"), "members")

    # Star: each bucket's members against the one that shares the most buckets with others.
    pivots = members.groupBy("key").agg(F.max(F.struct("w", (-F.col("rep")).alias("r"))).alias("p")).select("key", (-F.col("p.r")).alias("pivot"))
    stars = members.join(scratch.save(pivots, "pivots"), "key").filter("rep <> pivot")
    pairs = stars.select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
    links = confirmed(pairs, reps, docs, size, percent, scratch)
    # Texts that share an id tie their sets together, through the id as a node.
    again = some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = scratch.save(again.select(F.col("doc_id").alias("id")), "again")
    if not again.isEmpty():
        tied = some.join(again, F.col("doc_id") == F.col("id"), "left_semi").join(sets, "set_hash")
        links = links.unionByName(tied.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    comp = scratch.save(components(links, scratch, "cc-star"), "comp-star")
    # Buckets whose other members are not yet one class: members outside the largest class against all.
    left = stars.select("key", "rep").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    left = scratch.save(left, "left")
    tasks = scratch.save(block_tasks(left), "tasks")
    rest = between_classes(tasks, reps, docs, size, percent, scratch)
    links = comp.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)
    comp = scratch.save(components(links, scratch, "cc-all"), "comp-all")
    scratch.drop("reps", "shared", "met", "buckets", "members", "pivots", "again", "links-star", "comp-star", "left", "tasks", "links-rest")

    of_set = sets.join(comp, sets["rep"] == comp["node"], "left").select(F.col("set_hash").alias("s"), F.coalesce("component", "rep").alias("c"))
    # Rows without a set have keys of their own, so that they do not meet in one task.
    own_key = F.coalesce("set_hash", F.encode(F.concat(F.lit("-"), F.col("doc_id").cast("string")), "utf-8"))
    out = all_.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own_key).alias("k"))
    out = out.join(of_set, F.col("k") == F.col("s"), "left").withColumn("component_id", F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each class, with their own columns.

    Rows that repeat the id that stays all stay, as do null ids and texts without
    words. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "neardup-rows")
    gone = scratch.save(classes(docs, size, percent).filter("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    own, name = numbered(docs)
    left = own.join(F.broadcast(gone) if few else gone, F.col(name["doc_id"]).cast("long") == F.col("gone_id"), "left_anti")
    return left.toDF(*docs.columns)
