"""Repair of conversations by the cheapest edits, found as shortest paths.

A node is a place between rows and what the repaired roles so far allow next; arcs
keep, re-role or delete a row, or insert one, at costs of 0 to 3. Dial's buckets, one
for each distance, give the distance of every node to the end; a walk along arcs that
lie on a shortest path, in ASCII order of their letters, gives the audit.

Rows are dealt by ranges of (conversation, turn), so a long conversation lies in many
tasks. Each cuts its part into blocks of bounded size and gives a block's distances
from every state before it to every state after it. Summaries meet by conversation and
give each block the distances behind it, then each block walks from every state that
it may be entered in, and last the pieces are put together in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows and characters of a block; rows of output held at a time.
BLOCK_ROWS, BLOCK_CHARS, HELD = 2_000, 1_000_000, 500
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
# States of the repaired roles: nothing yet, after a first s, after u, after ua. Each but the third may be followed by u, the third by a.
STATES, FINAL, NEXT, BEFORE = 4, (0, 3), (2, 2, 3, 2), ((), (), (0, 1, 3), (2,))
ROLES = ("user", "user", "assistant", "user")
FAR = 1 << 60
REROLE, DELETE, INSERT = 2, 3, 2


def kept(state: int, initial: str) -> int | None:
    """The state behind a row that is kept; None where its role may not stand."""
    if initial == "s":
        return 1 if state == 0 else None
    return NEXT[state] if initial == ROLES[state][0] else None


def distances(live: list[tuple[str, int]], behind: list[int]) -> list[int]:
    """Distance to the end of node 4 * place + state, by Dial's buckets; live rows are (initial, 1 if truncated), `behind` those of the states after them."""
    n = len(live)
    far = [FAR] * (STATES * (n + 1))
    low = min(behind)
    buckets: list[list[int]] = [[]]

    def reach(node: int, d: int) -> None:
        if d < far[node]:
            far[node] = d
            while len(buckets) <= d - low:
                buckets.append([])
            buckets[d - low].append(node)

    for s, d in enumerate(behind):
        if d < FAR:
            reach(STATES * n + s, d)
    d = low
    while d - low < len(buckets):
        for node in buckets[d - low]:  # grows by no arc, as those within a bucket cost 0 and lead to other places
            if far[node] != d:
                continue
            i, t = divmod(node, STATES)
            for s in BEFORE[t]:
                reach(node - t + s, d + INSERT)
            if i:
                initial, cut = live[i - 1]
                reach(node - STATES, d + DELETE)
                for s in range(STATES):
                    if kept(s, initial) == t:
                        reach(node - STATES - t + s, d + cut)
                    if NEXT[s] == t:
                        reach(node - STATES - t + s, d + cut + REROLE)
        d += 1
    return far


def walk(rows: list[tuple[str, int, bool, int]], far: list[int], state: int, last: bool) -> tuple[str, int]:
    """Letters of the least shortest path from `state` through rows (initial, truncated, doomed, times), and the state behind it.

    Doomed rows (blank or seen before) and all repeats are deleted where they stand: that is the least letter
    and changes no state, so they need no node. Rows inserted at the end of a block are left to the next one.
    """
    out, node = [], state
    for initial, cut, doomed, times in rows:
        if doomed:
            out.append("D" * times)
            continue
        while True:
            state, here = node % STATES, far[node]
            base = node - state + STATES
            if far[base + state] + DELETE == here:
                out.append("D")
                node = base + state
                break
            if far[node - state + NEXT[state]] + INSERT == here:
                out.append("I")
                node += NEXT[state] - state
                continue
            to = kept(state, initial)
            keep = to is not None and far[base + to] + cut == here
            out.append("K" if keep else "R")
            node = base + (to if keep else NEXT[state])
            break
        out.append("D" * (times - 1))
    while last and far[node]:
        out.append("I")
        node += NEXT[node % STATES] - node % STATES
    return "".join(out), node % STATES


def applied(rows: list[tuple[str, str, int]], letters: str, state: int):
    """The repaired rows (role, text) that the letters make of rows (role, text, times)."""
    each = ((role, text) for role, text, times in rows for _ in range(times))
    for x in letters:
        if x == "I":
            yield ROLES[state], ""
            state = NEXT[state]
            continue
        role, text = next(each)
        if x == "K":
            yield role, text
            state = kept(state, role[:1])
        elif x == "R":
            yield ROLES[state], text
            state = NEXT[state]


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (c, turn, role, text, times) after the damage by crc32 of `conversation:turn`."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(part("c"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = rows.withColumn("h", h).filter("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("c", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("h") == 3, 2).otherwise(1).cast("long").alias("times"))


def _rows(conversations: DataFrame, damage: bool) -> DataFrame:
    """(c, turn, role, text, digest, times, seen): equal rows of a turn as one; seen: the same role and text stands in an earlier turn."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"))
    rows = damaged(rows) if damage else rows.withColumn("times", F.lit(1).cast("long"))
    rows = rows.groupBy("c", "turn", "role", "text").agg(F.sum("times").alias("times")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    first = rows.groupBy(F.col("c").alias("f_c"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"))
    first = first.agg(F.min("turn").alias("f_turn"), F.max(F.col("turn").isNull().cast("int")).alias("f_null"))
    same = F.col("c").eqNullSafe(F.col("f_c")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    seen = F.col("turn").isNotNull() & ((F.col("f_null") == 1) | (F.col("f_turn") < F.col("turn")))
    return rows.join(first, same).select("c", "turn", "role", "text", "digest", "times", seen.alias("seen"))


ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("times", pa.int64()), ("seen", pa.bool_())])
ROW_SQL = "struct<turn:long,role:string,text:string,times:long,seen:boolean>"


def judged(rows: list[dict]) -> list[tuple[str, int, bool, int]]:
    """(initial, truncated, doomed, times) of each row."""
    out = []
    for r in rows:
        text = r["text"].rstrip(SPACE)
        out.append((r["role"][:1], int(bool(text) and not text.endswith(ENDS)), not text or r["seen"], r["times"]))
    return out


def _blocks(rows: DataFrame, kind: str) -> DataFrame:
    """(c, seq, costs, rows): blocks of rows in the order of seq; costs from state s to state t at 4 * s + t."""

    def run(batches):
        seq, key, held, chars, out = TaskContext.get().partitionId() << 32, None, [], 0, []

        def block():
            live = [r[:2] for r in judged(held) if not r[2]]
            to = [distances(live, [FAR] * t + [0] + [FAR] * (3 - t)) for t in range(STATES)]
            return key, seq, [to[t][s] for s in range(STATES) for t in range(STATES)], held

        for b in batches:
            for c, *r in zip(*(x.to_pylist() for x in b.columns)):
                if held and (c != key or len(held) >= BLOCK_ROWS or chars >= BLOCK_CHARS):
                    out.append(block())
                    seq, held, chars = seq + 1, [], 0
                    if len(out) >= HELD:
                        yield pack(out)
                        out = []
                key = c
                held.append(dict(zip(("turn", "role", "text", "times", "seen"), r)))
                chars += len(r[2])
        if held:
            out.append(block())
        if out:
            yield pack(out)

    def pack(out):
        return _batch(out, [pa.int64() if kind == "bigint" else pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(ROW)], ["c", "seq", "costs", "rows"])

    order = ["c", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "turn", "role", "text", "times", "seen")
    return dealt.mapInArrow(run, f"c {kind}, seq long, costs array<long>, rows array<{ROW_SQL}>")


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


def _behind(blocks: DataFrame) -> DataFrame:
    """(seq, behind, first, last): each block's distances from the states after it to the end of its conversation."""

    def run(batches):
        key, behind, seq, costs = (), None, None, None
        for b in batches:  # by conversation, its last block first
            out = []
            for c, s, x in zip(*(y.to_pylist() for y in b.columns)):
                last = (c,) != key
                if seq is not None:
                    out.append((seq, behind, last))
                behind = [0 if t in FINAL else FAR for t in range(STATES)] if last else [min(FAR, *(costs[4 * a + t] + behind[t] for t in range(STATES))) for a in range(STATES)]
                key, seq, costs = (c,), s, x
                if last:
                    ends.add(s)
            if out:
                yield pack(out)
        if seq is not None:
            yield pack([(seq, behind, True)])

    ends: set = set()

    def pack(out):
        found = [(s, d, first, s in ends) for s, d, first in out]
        ends.difference_update([x[0] for x in found])
        return _batch(found, [pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_()], ["seq", "behind", "first", "last"])

    dealt = blocks.select("c", "seq", "costs").repartition("c").sortWithinPartitions("c", F.col("seq").desc())
    return dealt.mapInArrow(run, "seq long, behind array<long>, first boolean, last boolean")


def _walked(conversations: DataFrame, damage: bool) -> tuple[DataFrame, str]:
    """(c, seq, rows, cost, letters, states): of each block, for each state it may be entered in, the distance, the letters and the state behind."""
    kind = dict(conversations.dtypes)["conv_id"]
    if kind not in ("bigint", "string"):
        conversations = conversations.withColumn("conv_id", F.col("conv_id").cast("bigint" if kind in ("int", "smallint", "tinyint") else "string"))
        kind = dict(conversations.dtypes)["conv_id"]
    scratch = Scratch(conversations.sparkSession, "conversations")
    rows = scratch.save(_rows(conversations, damage), "rows")
    blocks = scratch.save(_blocks(rows, kind), "blocks")
    behind = scratch.save(_behind(blocks).withColumnRenamed("seq", "b_seq"), "behind")
    scratch.drop("rows")

    def run(batches):
        for b in batches:
            out = []
            for c, seq, rows, behind, first, last in zip(*(x.to_pylist() for x in b.columns)):
                known = judged(rows)
                far = distances([r[:2] for r in known if not r[2]], behind)
                found = [walk(known, far, s, last) for s in ((0,) if first else range(STATES))]
                out.append((c, seq, rows, far[:STATES], [x[0] for x in found], [x[1] for x in found]))
                if len(out) >= HELD:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    def pack(out):
        return _batch(out, [pa.int64() if kind == "bigint" else pa.string(), pa.int64(), pa.list_(ROW), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())], ["c", "seq", "rows", "cost", "letters", "states"])

    joined = blocks.join(behind, F.col("seq") == F.col("b_seq")).select("c", "seq", "rows", "behind", "first", "last")
    walked = joined.mapInArrow(run, f"c {kind}, seq long, rows array<{ROW_SQL}>, cost array<long>, letters array<string>, states array<long>")
    return walked.repartition("c").sortWithinPartitions("c", "seq"), kind


def _in_order(batches):
    """(conversation, whether its first block, rows, cost, letters, state before) of each block, in order."""
    key, state = (), 0
    for b in batches:
        for c, _, rows, cost, letters, states in zip(*(x.to_pylist() for x in b.columns)):
            new = (c,) != key
            before = 0 if new else state
            key, state = (c,), states[before]
            yield c, new, rows, cost[before], letters[before], before


class _Totals:
    """What is known of one conversation so far."""

    def __init__(self, c, cost: int) -> None:
        self.c, self.cost, self.sha, self.lines, self.audit = c, cost, hashlib.sha256(), 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initial = None

    def add(self, rows: list[dict], letters: str, state: int) -> None:
        for r, (initial, cut, doomed, times) in zip(rows, judged(rows)):
            if not r["text"].strip(SPACE):
                self.blank += times
            else:
                self.duplicate += times - 1 + doomed
                self.truncated += cut and not doomed
            if r["turn"] is not None:  # in order
                self.turns += r["turn"] != self.high
                self.low = r["turn"] if self.low is None else self.low
                self.high = r["turn"]
            self.illegal += (self.initial is not None and self.initial + initial not in ("su", "ua", "au")) + (times - 1) * (initial * 2 not in ("su", "ua", "au"))
            self.initial = initial
            self.cost += DELETE * (times - (not doomed))
        for role, text in applied([(r["role"], r["text"], r["times"]) for r in rows], letters, state):
            self.sha.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
            self.lines += 1
        self.audit.append(letters)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.c, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand in the order of turn, nulls first; of rows of one turn that of the
    least role, then of the least SHA-256 of the text comes first. A null role or text is one space;
    a null conv_id is a conversation of its own. Equal rows of a turn are taken together with
    their number. A conversation whose rows are all gone has zeros, an empty audit and the hash of nothing.
    Texts of any length are read whole; other columns are ignored; an empty table gives no rows.
    The audit and the hash of one conversation are made in one task, block by block; all else is dealt in blocks.
    `damage` first spoils rows by the crc32 of their conversation and turn.
    """
    walked, kind = _walked(conversations, damage)

    def run(batches):
        out, now = [], None
        for c, new, rows, cost, letters, state in _in_order(batches):
            if new:
                if now:
                    out.append(now.row())
                now = _Totals(c, cost)
                if len(out) >= 20 * HELD:
                    yield pack(out)
                    out = []
            now.add(rows, letters, state)
        if now:
            yield pack([*out, now.row()])

    def pack(out):
        return _batch(out, [pa.int64() if kind == "bigint" else pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()], COLUMNS)

    numbers = "".join(f", {x} long" for x in COLUMNS[1:7])
    found = walked.mapInArrow(run, f"conv_id {kind}{numbers}, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "r_id")
    ids = conversations.select(F.col("conv_id").cast(kind).alias("conv_id")).distinct()
    values: list[Column] = [F.coalesce(x, F.lit(0)).alias(x) for x in COLUMNS[1:7]]
    values += [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("r_id")), "left").select("conv_id", *values)


def repaired(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """The rows after repair: conv_id, place (from 0), role, text."""
    walked, kind = _walked(conversations, damage)

    def run(batches):
        out, place = [], 0
        for c, new, rows, _, letters, state in _in_order(batches):
            place = 0 if new else place
            for role, text in applied([(r["role"], r["text"], r["times"]) for r in rows], letters, state):
                out.append((c, place, role, text))
                place += 1
            if len(out) >= HELD:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    def pack(out):
        return _batch(out, [pa.int64() if kind == "bigint" else pa.string(), pa.int64(), pa.string(), pa.string()], ["conv_id", "place", "role", "text"])

    return walked.mapInArrow(run, f"conv_id {kind}, place long, role string, text string")
