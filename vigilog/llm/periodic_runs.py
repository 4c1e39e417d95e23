"""Periodic runs of words: suffix trees of a text and of its reversal.

A run is a stretch of words with smallest period ``q`` and a length of at least
``least`` and ``times * q`` that no neighbouring word extends keeping the period.
Every text is judged by itself:

1. Ukkonen's algorithm builds the suffix tree of the words, and one of the words
   backwards. An Euler tour of each, with a sparse table of least depths, gives the
   lowest common ancestor of two suffixes, and so the length of their common
   extension forwards or backwards, in constant time.
2. The longest Lyndon word that starts at a position ends before the next smaller
   suffix; under the reversed order of words, before the next greater one. Every
   run has such a word as its root (the runs theorem), so these two periods for
   each position are all the candidates.
3. Each candidate is extended both ways by the two trees; those long enough are
   the runs, and their period is the smallest, as Lyndon words are primitive.

Trees are built only over stretches in which a run can lie, found first: a run of
period ``q`` repeats each of its stretches of ``(times - 1) * q`` words after ``q``
words. So for periods from each power of two to the next, stretches of as many
words as the smallest of these periods repeats are hashed, and what is covered by
such as come again within the largest of them holds all runs of these periods.
Texts without any, most of them, need no tree. Nothing is lost by it.

Words are everything but ASCII white space, compared byte by byte. A task holds
one text at a time; its trees take some 300 bytes a word of the stretch.

Defined results: null and empty texts have no words and no run; repeated rows and
rows of null id are judged each; a tie for the longest run goes to the smallest
start, then period; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix

_NEVER = 1 << 60
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of collapsed text in one batch of results.
_BATCH = 1 << 22


# -- suffix trees ----------------------------------------------------------------


def suffix_tree(symbols: list[int], width: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Edges ``node * width + first symbol -> node``, and of each node's own edge
    the start and end in ``symbols`` (below ``width``; the last one occurs once)."""
    start, end, link = [0], [0], [0]
    go: dict[int, int] = {}
    node = edge = length = waiting = 0
    for i, symbol in enumerate(symbols):
        pending = 0
        waiting += 1
        while waiting:
            if not length:
                edge = i
            key = node * width + symbols[edge]
            child = go.get(key)
            if child is None:
                go[key] = len(start)
                start.append(i), end.append(_NEVER), link.append(0)
                if pending:
                    link[pending] = node
                    pending = 0
            else:
                size = min(end[child], i + 1) - start[child]
                if length >= size:
                    edge += size
                    length -= size
                    node = child
                    continue
                at = start[child] + length
                if symbols[at] == symbol:
                    length += 1
                    if pending:
                        link[pending] = node
                    break
                split = len(start)
                go[key] = split
                start.append(start[child]), end.append(at), link.append(0)
                go[split * width + symbol] = split + 1
                start.append(i), end.append(_NEVER), link.append(0)
                start[child] = at
                go[split * width + symbols[at]] = child
                if pending:
                    link[pending] = split
                pending = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return go, start, end


class Extensions:
    """Common extensions of the suffixes of ``words`` in constant time each, and
    the suffixes' ranks. Words are numbers from 1; the end is smaller than all."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        width = int(words.max(initial=0)) + 1
        go, start, end = suffix_tree([*words.tolist(), 0], width)
        keys = np.fromiter(go.keys(), np.int64, len(go))
        order = np.argsort(keys)  # by parent, then symbol
        children = np.fromiter(go.values(), np.int64, len(go))[order].tolist()
        bounds = np.searchsorted(keys[order] // width, np.arange(len(start) + 1)).tolist()
        # The Euler tour: the depth of a node each time it is met. A leaf's own
        # edge starts as far behind its suffix as its parent is deep.
        tour, met, ranked = [0], [0] * (n + 1), []
        depth, above, left = 0, [], iter(children[bounds[0] : bounds[1]])
        while True:
            for v in left:
                lo, hi = bounds[v], bounds[v + 1]
                if lo == hi:
                    suffix = start[v] - depth
                    met[suffix] = len(tour)
                    ranked.append(suffix)
                    tour += (n + 1 - suffix, depth)
                else:
                    above.append((depth, left))
                    depth += end[v] - start[v]
                    tour.append(depth)
                    left = iter(children[lo:hi])
                    break
            else:
                if not above:
                    break
                depth, left = above.pop()
                tour.append(depth)
        self.met = np.array(met)
        self.rank = np.zeros(n + 1, np.int64)
        self.rank[ranked] = np.arange(n + 1)
        self.least = [np.array(tour, np.int32)]
        size = 1
        while 2 * size <= len(tour):
            before = self.least[-1]
            self.least.append(np.minimum(before[:-size], before[size:]))
            size *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the different suffixes ``a`` and ``b``:
        the depths of their lowest common ancestors."""
        low = np.minimum(self.met[a], self.met[b])
        high = np.maximum(self.met[a], self.met[b])
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            table = self.least[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k)) + 1])
        return out


def _next_beyond(rank: list[int]) -> list[int]:
    """For each place the next one of smaller rank, the length if there is none."""
    out = [len(rank)] * len(rank)
    open_: list[int] = []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return out


# -- runs ------------------------------------------------------------------------


def runs_of(words: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``words``, sorted."""
    n = len(words)
    _, words = np.unique(words, return_inverse=True)
    words = words.astype(np.int64) + 1
    forward, backward = Extensions(words), Extensions(words[::-1])
    rank = forward.rank
    after = [_next_beyond(r.tolist()) for r in (rank, n - rank)]
    at = np.concatenate([np.arange(n + 1)] * 2)
    period = np.concatenate([np.array(x) for x in after]) - at
    ok = (at + period < n) & (times * period <= n)
    at, period = at[ok], period[ok]
    right = forward.common(at, at + period)
    # The words before position x, backwards, are the suffix n - x of the reversal.
    left = backward.common(n - at, n - at - period)
    length = left + period + right
    ok = length >= np.maximum(least, times * period)
    found = np.stack([(at - left)[ok], length[ok], period[ok]], 1)
    return np.unique(found, axis=0)


def stretches(words: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Ranges of ``words`` that hold all its runs, each run in one of them."""
    size = -(-least * (times - 1) // times)
    grams = _grams(words.astype(np.uint64) + np.uint64(1), size)
    by_value = np.sort(grams)
    if not (by_value[1:] == by_value[:-1]).any():
        return []
    inside = np.zeros(len(words) + 1, np.int64)
    low = 1  # periods from low to below 2 * low
    while times * low <= len(words):
        wide = max(size, (times - 1) * low)
        if wide > size:
            grams = _grams(words.astype(np.uint64) + np.uint64(1), wide)
        order = np.argsort(grams, kind="stable")
        own = grams[order]
        equal = own[1:] == own[:-1]
        if not equal.any():
            break
        near = equal & (np.diff(order) < 2 * low)
        # Between two near starts all words are covered, as grams are longer.
        np.add.at(inside, order[:-1][near], 1)
        np.add.at(inside, order[1:][near] + wide, -1)
        low *= 2
    edges = np.flatnonzero(np.diff(np.r_[0, np.cumsum(inside) > 0])).reshape(-1, 2)
    return [(a, b) for a, b in edges.tolist() if b - a >= least]


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of ``size`` words, from those of powers of two."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, done, power, width = None, 0, words, 1
    while True:
        if size & width:
            part = power[done : done + n]
            out = part.copy() if out is None else mix(out * _ODD + part)
            done += width
        if done == size:
            return out
        power = mix(power[: len(power) - width] * _ODD + power[width:])
        width *= 2


def all_runs(words: list[bytes], least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of a text's words, sorted."""
    if len(words) < least:
        return np.zeros((0, 3), np.int64)
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    found = []
    for lo, hi in stretches(ids, least, times):
        part = runs_of(ids[lo:hi], least, times)
        part[:, 0] += lo
        found.append(part)
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def find(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then
    period) and ``collapsed``, the words outside the repeats of runs joined by one
    space, of every row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def judge(batches):
        for batch in batches:
            ids = batch.column(0)
            texts = batch.column(1).cast(pa.binary())
            first, n_words, found, kept, held = 0, [], [], [], 0
            for i in range(len(texts)):
                words = (texts[i].as_py() or b"").split()  # of bytes: at ASCII white space
                runs = all_runs(words, least, times)
                if len(runs):
                    gone = dropped(runs, len(words))
                    words_left = [w for w, x in zip(words, gone.tolist()) if not x]
                else:
                    words_left = words
                n_words.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs.tolist()])
                kept.append(b" ".join(words_left))
                held += len(kept[-1])
                if held > _BATCH or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [ids[first : i + 1], pa.array(n_words, pa.int64()), pa.array(found, kind),
                         pa.array(kept, pa.binary()).cast(pa.string())], names)
                    first, n_words, found, kept, held = i + 1, [], [], [], 0

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, schema)


# -- the query -------------------------------------------------------------------

_SPACE = r"[\x20\x09-\x0D]+"


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the words of every tenth document, by the
    CRC-32 ``h`` of its id, made periodic from a word ``a`` on: with ``g = h // 10``
    and ``n`` words, ``a = g % n`` and the period is ``1 + (n - a) // (3 + g % 8)``.
    A null id has no such period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("_g"))
    rows = rows.select("*", F.when(F.col("_g").isNotNull(), words).alias("_w"))
    rows = rows.select("*", F.size("_w").alias("_n"))
    rows = rows.select("*", F.when(F.col("_n") > 0, (F.col("_g") % F.col("_n")).cast("int")).alias("_a"))
    rows = rows.select("*", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int").alias("_p"))
    repeated = F.expr("array_join(transform(sequence(0, _n - 1), i -> _w[if(i < _a, i, _a + (i - _a) % _p)]), ' ')")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """The contract's digest of the runs of every row: their number, the longest,
    and hashes of all of them and of the collapsed text."""
    found = find(docs, least, times)
    top = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", "n_words", "runs", "collapsed", top.alias("_top"))
    return rows.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_top.start")).alias("start"), F.col("_top.length").alias("length"), (-F.col("_top.period")).alias("period"),
        F.floor(F.expr("(1000 * _top.length) div (-_top.period)")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
