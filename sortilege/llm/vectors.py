"""Near-duplicate vectors by an inverted multi-index.

Each half of a vector has its own codebook; their product is a grid of cells. A
vector is stored in the cell of its nearest codewords. As a query it visits cells
in multi-sequence order, by the squared distance to the cell's borders, until the
next one lies farther than partners at the wanted cosine do with probability
TARGET, as measured on a sample. Visited cells are verified by cosine in double
precision. Codebooks grow with the rows, so that cells do not.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch

#: Codewords for each half, least and most; rows for each cell that their number aims at. The grid grows with the rows up to 840 million
#: of one length, cells from then on.
CODES, MOST_CODES, CELL_ROWS = 16, 2_048, 200
#: Vectors that codebooks are fitted on: at least so many, and so many for each codeword; the driver holds them.
SAMPLE_ROWS, SAMPLE_EACH = 4_000, 8
#: Share of partners within reach; rows of a cell that one task holds, stored and asking.
TARGET, STORED, ASKING = 0.9998, 1_500, 3_000
#: Vector lengths that get codebooks; vectors of further lengths meet all others of their length and label.
LENGTHS = 100


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return np.unique(c, axis=0)


def unit(vectors: list) -> np.ndarray:
    v = np.array(vectors, np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def border_cost(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword, and for each other one the squared distance to the border with it."""
    own = (codes * codes).sum(1)
    d = own[None] - 2 * x @ codes.T  # squared distances less the vector's own square
    near = d.argmin(1)
    between = np.sqrt(np.maximum(own[:, None] + own[None] - 2 * codes @ codes.T, 0))[near]
    step = (d - d[np.arange(len(x)), near][:, None]) / (2 * np.where(between > 0, between, 1))
    return near, step**2


def traverse(left: np.ndarray, right: np.ndarray, reach: float) -> list[int]:
    """Cells of the grid in ascending order of left cost plus right cost, up to reach; only these are looked at."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    x, y, wide = left[a].tolist(), right[b].tolist(), len(right)
    a, b = a.tolist(), b.tolist()
    heap, out = [(x[0] + y[0], 0, 0)], []
    while heap and heap[0][0] <= reach:
        _, i, j = heapq.heappop(heap)
        out.append(a[i] * wide + b[j])
        if j + 1 < wide:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return out


def reach_of(x: np.ndarray, books: tuple, cut: int, cosine: float, seed: int = 5) -> float:
    """Border cost within which a share TARGET of partners lie: of vectors turned by the wanted cosine in random directions, and of the sample's own pairs.

    No partner lies beyond the squared distance that belongs to the cosine, which bounds it.
    """
    radius, rng = 2 - 2 * cosine + 1e-9, np.random.default_rng(seed)
    pairs = []
    for _ in range(5):
        u = rng.normal(size=x.shape)
        u -= (u * x).sum(1, keepdims=True) * x
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
        pairs.append((x, cosine * x + max(0.0, 1 - cosine**2) ** 0.5 * u))
    for at in range(0, len(x), 500):
        i, j = np.nonzero(x[at : at + 500] @ x.T >= cosine)  # 500 rows at a time
        own = i + at != j
        pairs.append((x[i[own] + at], x[j[own]]))
    costs = []
    for p, q in (tuple(map(np.concatenate, zip(*pairs[:5]))), tuple(map(np.concatenate, zip(*pairs[5:])))):
        if len(p):
            cost = np.zeros(len(p))
            for half, book in zip((slice(0, cut), slice(cut, None)), books):
                for k in range(0, len(p), 5000):
                    cost[k : k + 5000] += border_cost(p[k : k + 5000, half], book)[1][np.arange(len(p[k : k + 5000])), border_cost(q[k : k + 5000, half], book)[0]]
            costs.append(float(np.quantile(cost, TARGET)))
    return min(radius, 1.1 * max(costs))


def neighbours(rows: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per vector of rows (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Null labels, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing. Vectors of different length never
    link. Equal vectors of a label are searched once and counted as often as they
    occur. Of vectors that repeat a vec_id each has its own links and its own class, named by the smallest
    vec_id in it. Vectors at just the wanted cosine link. A null vec_id has no class; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("ok", sound)
    groups = scratch.save(v.filter("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times")), "groups")
    # `rep` names a group in what follows: its smallest id, or a hash of its own where an id has several vectors.
    twice = groups.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = scratch.save(twice.select(F.col("rep").alias("t_rep")), "shared")
    several = not shared.isEmpty()
    if several:
        marked = groups.join(shared, F.col("rep") == F.col("t_rep"), "left")
        rep = F.when(F.col("t_rep").isNull(), F.col("rep")).otherwise(F.xxhash64("label", "v"))
        groups = scratch.save(marked.select("label", "v", rep.alias("rep"), "times", F.col("rep").alias("least")), "nodes")
    reps = groups.withColumn("size", F.size("v"))
    edges, counts = [], []
    lengths = reps.groupBy("size").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), "size").limit(LENGTHS).collect()
    for size, rows_ in lengths:
        own = reps.filter(F.col("size") == size)
        codes = int(min(MOST_CODES, max(CODES, round((rows_ / CELL_ROWS) ** 0.5))))
        drawn = own.orderBy(F.xxhash64("rep"), "rep").select("v").limit(max(SAMPLE_ROWS, SAMPLE_EACH * codes)).collect()
        x, cut = unit([r[0] for r in drawn]), size // 2
        books = (kmeans(x[:, :cut], codes) if cut else np.zeros((1, 0))), kmeans(x[:, cut:], codes)
        e, n = _search(own, books, cut, cosine, reach_of(x, books, cut, cosine), scratch, size)
        edges.append(e), counts.append(n)
    if len(lengths) == LENGTHS:
        rest = reps.filter(~F.col("size").isin([r[0] for r in lengths]))
        e, n = _compare(rest.select("label", "rep", "v", "times", F.col("size").alias("cell"), F.array("size").alias("visits")), cosine, scratch, "rest")
        edges.append(e), counts.append(n)
    if not edges:
        none = F.col("vec_id")
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), none.alias("component_id"), F.lit(True).alias("kept"))
    e, n = edges[0], counts[0]
    for k in range(1, len(edges)):
        e, n = e.unionByName(edges[k]), n.unionByName(counts[k])
    comp = components(e, scratch)
    if several:  # the smallest id of each class in place of its smallest name
        named = comp.join(groups.select("rep", "least"), F.col("node") == F.col("rep"))
        least = named.groupBy(F.col("component").alias("c_")).agg(F.min("least").alias("l_"))
        comp = comp.join(least, F.col("component") == F.col("c_")).select("node", F.col("l_").alias("component"))
    near = n.groupBy("rep").agg(F.sum("links").alias("links"))
    found = groups.join(near, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    found = found.select(F.col("label").alias("g_label"), F.col("v").alias("g_v"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("l"), F.coalesce("component", "least" if several else "rep").alias("c"))
    out = v.join(found, F.col("ok") & (F.col("label") == F.col("g_label")) & (F.col("v") == F.col("g_v")), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("l", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _search(own: DataFrame, books: tuple, cut: int, cosine: float, reach: float, scratch: Scratch, size: int) -> tuple[DataFrame, DataFrame]:
    left, right = books

    def assign(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                c = b.slice(i, 1000)
                x = unit(c.column(2).to_pylist())
                (n1, c1), (n2, c2) = border_cost(x[:, :cut], left), border_cost(x[:, cut:], right)
                visited = [traverse(a, b, reach) for a, b in zip(c1, c2)]
                cell = (n1 * len(right) + n2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), c.column(2), c.column(3), pa.array(cell), pa.array(visited, pa.list_(pa.int32()))], ["label", "rep", "v", "times", "cell", "visits"])

    kind = dict(own.dtypes)["label"]
    table = scratch.save(own.select("label", "rep", "v", "times").mapInArrow(assign, f"label {kind}, rep long, v array<double>, times long, cell int, visits array<int>"), f"cells-{size}")
    return _compare(table, cosine, scratch, str(size))


def _compare(table: DataFrame, cosine: float, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Edges and links of rows (label, rep, v, times, cell, visits) with those stored in the cells that they visit, in blocks of bounded size."""
    stored = table.select("label", "cell", "rep", "v", "times")
    asking = table.select("label", F.explode("visits").alias("cell"), "rep", "v", "times")
    n_s = stored.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / STORED).cast("int").alias("sb"))
    n_a = table.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("ab"))
    parts = scratch.save(n_s.join(n_a, ["label", "cell"]), f"parts-{name}")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = stored.join(parts, ["label", "cell"]).select("label", "cell", block("sb").alias("s"), each("ab").alias("a"), "rep", "v", "times")
    asking = asking.join(parts, ["label", "cell"]).select("label", "cell", each("sb").alias("s"), block("ab").alias("a"), "rep", "v")

    def verify(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})
        if not len(q) or not len(s):
            return empty
        qi, si = q.rep.to_numpy(), s.rep.to_numpy()
        near = (unit(q.v.tolist()) @ unit(s.v.tolist()).T >= cosine) & (qi[:, None] != si[None])
        links = near @ s.times.to_numpy()
        low_s = si.copy()
        while True:  # components of this block: every linked row learns the smallest stored id it reaches
            low_q = np.where(near, low_s[None], np.iinfo(np.int64).max).min(1)
            new = np.minimum(low_s, np.where(near, low_q[:, None], np.iinfo(np.int64).max).min(0))
            if (new == low_s).all():
                break
            low_s = new
        hit, linked = near.any(1), near.any(0)
        return pd.DataFrame({"a": np.concatenate([qi[hit], si[linked]]), "b": np.concatenate([low_q[hit], low_s[linked]]), "links": np.concatenate([links[hit], np.zeros(int(linked.sum()), np.int64)])})

    keys = ["label", "cell", "s", "a"]
    stored = scratch.save(stored, f"stored-{name}")  # a table of its own, so that the sides' columns differ
    got = asking.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(verify, "a long, b long, links long")
    got = scratch.save(got, f"found-{name}")
    scratch.drop(f"cells-{name}", f"parts-{name}", f"stored-{name}")
    return got.select("a", "b"), got.filter("links > 0").select(F.col("a").alias("rep"), "links")
