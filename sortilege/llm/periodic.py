"""Maximal runs of repeated words, by Kolpakov and Kucherov.

A run is a stretch of words with smallest period q that no neighbour extends. The
text is cut into factors, each the longest stretch that occurs before, or a new
word (found in a suffix automaton that knows where each state first ends). A run
that touches a border of factors is found by Main's algorithm from common prefixes
and suffixes around that border; any other lies inside a factor, and is copied from
the factor's earlier occurrence.

A word of a run of exponent e occurs at least floor(e) times in it. So a text is
first cut at words that are rarer than that, and its pieces are cut likewise until
nothing changes: what is left of ordinary prose is short, and no run is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .textblocks import blocks, texts_of

#: A run has at least so many periods, and so many words.
EXPONENT, LEAST = 4, 6


class Automaton:
    """The suffix automaton of a list of numbers: every stretch of it is a path from state 0.

    Most states have one way out, which two arrays hold; only states where ways part have a dict.
    """

    def __init__(self, word: list[int]) -> None:
        self.letter, self.target, self.link, self.size, self.first = (array("q", [x]) for x in (-1, 0, -1, 0, -1))
        self.more: dict[int, dict[int, int]] = {}
        last = 0
        for i, c in enumerate(word):
            last = self._extend(last, c, i)

    def step(self, s: int, c: int) -> int:
        """The state behind s by c; -1 where there is none."""
        if self.letter[s] == c:
            return self.target[s]
        return self.more[s].get(c, -1) if s in self.more else -1

    def _put(self, s: int, c: int, to: int) -> None:
        if self.letter[s] in (-1, c):
            self.letter[s], self.target[s] = c, to
        else:
            self.more.setdefault(s, {})[c] = to

    def _new(self, size: int, first: int) -> int:
        for a, x in ((self.letter, -1), (self.target, 0), (self.link, 0), (self.size, size), (self.first, first)):
            a.append(x)
        return len(self.size) - 1

    def _extend(self, last: int, c: int, i: int) -> int:
        new, s = self._new(self.size[last] + 1, i), last
        while s >= 0 and self.step(s, c) < 0:
            self._put(s, c, new)
            s = self.link[s]
        if s < 0:
            return new
        old = self.step(s, c)
        if self.size[old] == self.size[s] + 1:
            self.link[new] = old
            return new
        copy = self._new(self.size[s] + 1, self.first[old])
        self.letter[copy], self.target[copy], self.link[copy] = self.letter[old], self.target[old], self.link[old]
        if old in self.more:
            self.more[copy] = dict(self.more[old])
        while s >= 0 and self.step(s, c) == old:
            self._put(s, c, copy)
            s = self.link[s]
        self.link[old] = self.link[new] = copy
        return new


def factors(word: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence or -1): each factor is the longest that occurs earlier, or one new number."""
    auto, i, n = Automaton(word), 0, len(word)
    while i < n:
        s, j, before = 0, i, -1
        while j < n:
            s = auto.step(s, word[j])
            if auto.first[s] >= j:  # its first occurrence is this one
                break
            j += 1
            before = auto.first[s]
        if j == i:
            yield i, i + 1, -1
            i += 1
        else:
            yield i, j, before - (j - i) + 1
            i = j


def prefixes(word: list[int]) -> list[int]:
    """For each place, the length of the longest stretch from there that begins the word."""
    n = len(word)
    z, a, b = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(z[i - a], b - i) if i < b else 0
        while i + k < n and word[k] == word[i + k]:
            k += 1
        if i + k > b:
            a, b = i, i + k
        z[i] = k
    return z


def around(word: list[int], left: int, border: int, right: int, most: int) -> Iterator[tuple[int, int, int]]:
    """Main's algorithm: (start, end, period) of the stretches of period up to `most` within [left, right) that touch the border and hold a whole period on one side of it."""
    u, v = word[border:right], word[left:border]
    back, nu, nv = v[::-1], len(u), len(v)
    # Common prefixes with u and common suffixes with v, from every place of u and of v.
    in_u, in_v = prefixes(u), prefixes(back)
    u_at_v = prefixes([*u, -1, *v])[nu + 1 :]
    v_at_u = prefixes([*back, -1, *u[::-1]])[nv + 1 :]
    for p in range(1, most + 1):
        on, back_on = in_u[p] if p < nu else 0, in_v[p] if p < nv else 0
        if p <= nu:  # the first p words of u are the whole period
            same = v_at_u[nu - p]
            yield border - same - (back_on if same == p else 0), border + p + on, p
        if p <= nv:  # and here the last p words of v
            same = u_at_v[nv - p]
            yield border - p - back_on, border + same + (on if same == p else 0), p


def runs(word: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, smallest period), by start, of all maximal runs of at least `exponent` (2 or more) periods and `least` words."""
    n, found, known = len(word), [], {}

    def add(start: int, end: int, p: int) -> None:
        if end - start < max(least, exponent * p) or start and word[start - 1] == word[start - 1 + p] or end < n and word[end] == word[end - p]:
            return
        if (start, end) not in known:
            insort(found, (start, end))
            known[start, end] = p
        elif p < known[start, end]:
            known[start, end] = p

    begin = 0
    for start, end, before in [*factors(word), (n, n, -1)]:
        # A run over this border that holds the factor before it, and a word more, begins less than a period before
        # that factor, which else would be longer. So (exponent - 1) periods are shorter than both factors together.
        most = (end - begin - 1) // (exponent - 1)
        if most > 0:
            for x in around(word, max(0, begin - most), start, end, most):
                add(*x)
        if before >= 0:  # runs that neither touch the start nor the end of the factor, in order, so that copies are copied
            shift, k = start - before, bisect_right(found, (before, n))
            while k < len(found) and found[k][0] < before + end - start:
                a, z = found[k]
                if z < before + end - start:
                    add(a + shift, z + shift, known[a, z])
                k += 1
        begin = start
    return [(a, z, known[a, z]) for a, z in found]


def pieces(word: list, count: int, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches left when words that occur fewer than `count` times in theirs are cut out, again and again."""
    todo, short = [(0, len(word))], max(count, least)
    while todo:
        a, z = todo.pop()
        seen = Counter(word[a:z])
        if min(seen.values(), default=count) >= count:
            if z > a:
                yield a, z
            continue
        cuts = [a - 1, *[i for i in range(a, z) if seen[word[i]] < count], z]
        todo += [(x + 1, y) for x, y in zip(cuts, cuts[1:]) if y - x > short]


def find_runs(words: list, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of a list of words, by start, then period."""
    out = []
    for a, z in pieces(words, exponent, least):
        ids: dict = {}
        coded = [ids.setdefault(w, len(ids)) for w in words[a:z]]
        out += [(a + s, a + e, p) for s, e, p in runs(coded, exponent, least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated(words: list, doc_id: int | None) -> list:
    """The words after the contract's damage: those of a tenth of all documents go round in a period from some place on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return (words[:a] + words[a : a + p] * (-(-(n - a) // p)))[:n]


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that are in no run, or in the first period of each run they are in."""
    keep, at = [], 0
    for a, z in sorted((s + p, e) for s, e, p in found):
        if z > at:
            keep += words[at : max(at, a)]
            at = z
    return keep + words[at:]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def scan(docs: DataFrame, damage: bool = False) -> DataFrame:
    """One row per row of docs: its runs of words, the one of the greatest length for its period, and the text without repeats.

    Null and empty texts have no words and no runs; of equal exponents the smallest
    start stands, then the smallest period; rows that repeat an id are scanned each;
    other columns are ignored; an empty table gives no rows. Texts of any length are
    scanned whole: a stretch left by `pieces` takes some hundred bytes a word. `damage`
    first repeats words in a tenth of the documents; a null id is never damaged.
    """

    def row(doc_id, text):
        words = text.encode().split()  # at ASCII white space
        if damage:
            words = repeated(words, doc_id)
        found = find_runs(words)
        text = b" ".join(collapsed(words, found) if found else words)
        listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
        best = found[0] if found else None
        for s, e, p in found:
            if (e - s) * best[2] > (best[1] - best[0]) * p:
                best = s, e, p
        top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        return doc_id, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), [{"start": s, "length": e - s, "period": p} for s, e, p in found], text.decode()

    def run(batches):
        i, s = pa.int64(), pa.string()
        kinds = [i] * 6 + [s, s, pa.list_(pa.struct([(k, i) for k in ("start", "length", "period")])), s]
        names = [x.split()[0] for x in SCHEMA.split("<")[0].split(", ")] + ["collapsed"]
        for b in blocks(batches):
            rows = [row(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return texts_of(docs).mapInArrow(run, SCHEMA)
