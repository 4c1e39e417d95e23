"""Best-fit packing of token sequences by non-negative least squares.

Documents become token ids and an end id; longer ones are cut into pieces of
the capacity. From the histogram of piece lengths (as many rows as there are
lengths) a plan is made on the driver:

* patterns: ways to fill the capacity with up to ``depth`` pieces, lengths of all
  sizes rounded up to ``step`` tokens;
* their repeat counts: non-negative least squares of the patterns against the
  histogram, rounded up and held to the pieces there are. The active-set method
  needs one pattern at a time, the one with the largest gain, and a knapsack over
  all of them finds it, so no list of patterns is made. What rounding left over is
  fitted again, ``rounds`` times at most;
* the smallest piece of a pattern is the longest that fits what its others left of
  the capacity by being shorter than their rounded lengths;
* residuals: the pieces that are left go, longest first, to the sequence with
  the least room that still takes them, one of the patterns' or a new one.

Everything in the plan is a run: so many sequences of equal content. A piece is
placed by its length and its rank among the pieces of that length, so tasks look
their pieces up by themselves; the ranks come from ``common.ranked``, so that
one length may have any number of pieces. The plan's size depends on capacity and
step, not on the corpus; it is sent to the tasks up to ``sent`` rows, beyond that
pieces and runs meet in an as-of join by length and rank.

Ids: texts are cut at blanks and line ends, which the tokenizer drops, and each
stretch's ids are kept in a bounded table per worker; they are the ids of the
whole text, as no merge or normalisation goes across white space, or from a letter
or digit to the marks after it.

Defined results: null text is empty, one piece of the end id alone; repeated
rows are packed each; very long texts make many pieces; other columns are
ignored; an empty table packs nothing.
"""

from __future__ import annotations

import gc
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilog.operators.asof import asof_join

from .common import ranked, store

#: Stretches whose ids a worker remembers (some 200 bytes each); longer than
#: _LONG characters never.
_REMEMBERED, _LONG = 1_000_000, 48
#: Texts looked up together, and stretches put into one call of the tokenizer.
_TEXTS, _CALL = 500, 20_000
#: ASCII marks that end a stretch: after a letter or digit they are tokens of their own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_BAR = "|"
#: Common marks at the end of a stretch, after an ASCII letter or digit.
_TAIL = re.compile(r"""([,.;:!?)"'])(?<=[0-9A-Za-z].)([,.;:!?)"']*)(?=[ \n]|\Z)""")
#: Whole stretches of lower-case ASCII letters.
_LOWER = re.compile(r"(?<![^ ])[a-z]+(?![^ ])")
_workers: dict[str, tuple] = {}


def _tokenizer(path: str):
    """Per worker: the tokenizer; its model for words that are lower-case letters
    already, which need no normalising and no pattern, only their bytes as the
    letters that stand for bytes (None where the vocabulary is not in lower case and
    byte-level); the ids of the bar; what is remembered."""
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        plain = whole.model if _is_plain(whole) else None
        _workers[path] = whole, plain, whole.encode(_BAR, add_special_tokens=False).ids, {"": b""}
    return _workers[path]


def _letters(word: str) -> bool:
    """Latin letters alone, whose lower case is as long."""
    return word.isalpha() and max(word) < "\u0250" and len(word.lower()) == len(word)


def _encoded(tokenizer, words: list[str], bar: int) -> dict[str, bytes]:
    """Ids of words that have no bar, many in one text with bars between them."""
    made = {}
    for lo in range(0, len(words), _CALL):
        part = words[lo : lo + _CALL]
        made.update(_cut_at(tokenizer, f" {_BAR} ".join(part), part, bar))
    return made


def _cut_at(tokenizer, text: str, words: list[str], bar: int) -> Iterator[tuple[str, bytes]]:
    ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
    ends = 4 * np.r_[np.flatnonzero(ids == bar), len(ids)]
    starts = np.r_[0, ends[:-1] + 4]
    body = ids.tobytes()
    return zip(words, [body[lo:hi] for lo, hi in zip(starts.tolist(), ends.tolist())])


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones
    for themselves, the others from 256 on."""
    own = [*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # blanks part words
    others = [b for b in range(256) if b not in own]
    return {b: 256 + i + (b > 0x20) for i, b in enumerate(others)}


def _plain_ids(model, words: list[str]) -> dict[str, bytes]:
    """Ids of words of lower-case letters, by the model alone."""
    text = " ".join(words)
    if not text.isascii():
        text = text.encode().decode("latin-1").translate(_byte_letters())
    tokenize = model.tokenize
    return {word: array("I", [t.id for t in tokenize(own)]).tobytes() for word, own in zip(words, text.split(" "))}


def _parted(stretch: str) -> tuple[str, str]:
    """A stretch without its last marks, and these, if their ids are separate."""
    core = stretch.rstrip(_MARKS)
    if not core or "<|" in stretch or ord(core[-1]) >= 0x250 or not core[-1].isalnum() or len(core[-1].lower()) > 1:
        return stretch, ""
    return core, stretch[len(core) :]


def _learn(new: set[str], path: str) -> dict[str, bytes]:
    """Remembers the ids of new stretches; returns those too long for that."""
    whole, plain, bar, known = _tokenizer(path)
    lower = plain is not None and len(bar) == 1
    others, alone = set(), set()
    words = set(_LOWER.findall(" ".join(new))) if lower else set()
    joined: list[tuple[str, str, str]] = []  # stretch, its core in lower case, its marks

    def other(x: str) -> None:
        if x not in known:
            (alone if _BAR in x or len(bar) > 1 else others).add(x)

    for p in new - words:
        core, marks = (p, "") if p.isalpha() else _parted(p)
        if lower and (core.isascii() and core.isalpha() or _letters(core)):
            low = core.lower()
            if low not in known:
                words.add(low)
            if low is not p and low != p:
                joined.append((p, low, marks))
        else:
            other(core)
            if marks:
                joined.append((p, core, marks))
        if marks:
            other(marks)
    made = _plain_ids(plain, list(words)) if words else {}
    if others:
        made.update(_encoded(whole, list(others), bar[0]))
    if alone:
        made.update((x, np.array(e.ids, "<u4").tobytes()) for x, e in zip(
            alone, whole.encode_batch_fast(list(alone), add_special_tokens=False)))
    for p, core, marks in joined:
        made[p] = (made[core] if core in made else known[core]) + (made[marks] if marks in made else known[marks])
    long = {x: made.pop(x) for x in [x for x in made if len(x) > _LONG]}
    known.update(made)
    return long


def _is_plain(tokenizer) -> bool:
    """Whether it is in lower case and byte-level."""
    lower = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AÉ") == "aé"
    shown = tokenizer.pre_tokenizer.pre_tokenize_str("é") if tokenizer.pre_tokenizer is not None else []
    return lower and [x for x, _ in shown] == ["Ã©"] and sys.byteorder == "little" and array("I").itemsize == 4


def _places(items: list, what) -> list[int]:
    """Where ``what`` is in a list."""
    places, at = [], -1
    for _ in range(items.count(what)):
        at = items.index(what, at + 1)
        places.append(at)
    return places


def _found(parts: list[list[str]], known: dict[str, bytes], path: str) -> list[list[bytes]]:
    """The ids of each stretch of each text."""
    found = [list(map(known.get, own)) for own in parts]
    lacking = [(ids, own, _places(ids, None)) for ids, own in zip(found, parts) if None in ids]
    if lacking:
        long = _learn({own[k] for _, own, places in lacking for k in places}, path)
        for ids, own, places in lacking:
            for k in places:
                word = own[k]
                ids[k] = known[word] if word in known else long[word]
    return found


def _ids(texts: list[str], path: str, end: int):
    """The ids of each text as little-endian unsigned 32-bit bytes."""
    known = _tokenizer(path)[3]
    tail = np.array([end], "<u4").tobytes()
    for lo in range(0, len(texts), _TEXTS):
        parts = [_TAIL.sub(r" \1\2", t).replace("\n", " ").split(" ") for t in texts[lo : lo + _TEXTS]]
        if len(known) > _REMEMBERED:
            known.clear()
            known[""] = b""
        # Lists of what lives on, and no cycles: nothing for the collector to find.
        collects = gc.isenabled()
        gc.disable()
        try:
            found = _found(parts, known, path)
        finally:
            if collects:
                gc.enable()
        for ids in found:
            ids.append(tail)
            yield b"".join(ids)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece."""
    width = 4 * capacity

    def cut(batches):
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for name, body in zip(batch.column(0).to_pylist(), _ids([t or "" for t in batch.column(1).to_pylist()], path, end)):
                for n, at in enumerate(range(0, len(body), width)):
                    part = body[at : at + width]
                    doc.append(name), piece.append(n), start.append(at // 4), length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema + (", ids array<long>" if with_ids else ""))


# -- the plan ------------------------------------------------------------------


@lru_cache(maxsize=4)
def _shifts(units: int) -> np.ndarray:
    """For each total and part, the total without the part."""
    left = np.arange(units + 1)[:, None] - np.arange(units + 1)
    return np.where(left < 0, units + 1, left)


def best_pattern(gains: np.ndarray, depth: int) -> np.ndarray:
    """Of all ways to write ``len(gains) - 1`` units as up to ``depth`` parts the one
    with the largest sum of ``gains`` of its parts, as parts, largest first; none
    (empty) if every way has a part that is barred by a gain of minus infinity."""
    units = len(gains) - 1
    shift = _shifts(units)
    each = np.r_[-np.inf, gains[1:]]
    best = np.full(units + 2, -np.inf)  # the last one is out of reach
    best[0] = 0
    tops, picks = [best], []
    for _ in range(depth):
        sums = tops[-1][shift] + each
        pick = sums.argmax(axis=1)
        picks.append(pick)
        tops.append(np.r_[sums[np.arange(units + 1), pick], -np.inf])
    k = int(np.argmax([t[units] for t in tops]))
    if not np.isfinite(tops[k][units]) or k == 0:
        return np.zeros(0, np.int64)
    parts, left = [], units
    for pick in reversed(picks[:k]):
        parts.append(int(pick[left]))
        left -= parts[-1]
    return np.array(sorted(parts, reverse=True), np.int64)


def least_squares(counts: np.ndarray, depth: int, steps: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and their repeat counts, not below 0, with the least squares of
    what they leave of ``counts`` (pieces by length in units), by an active set
    (Lawson and Hanson) whose columns are found as they are needed, ``steps`` at most."""
    ways: list[np.ndarray] = []
    a = np.zeros((len(counts), 0))
    x = np.zeros(0)
    # A length that is not there has no part in any pattern.
    barred = counts <= 0
    for _ in range(steps):
        rest = counts - a @ x
        way = best_pattern(np.where(barred, -np.inf, rest), depth)
        if not len(way) or rest[way].sum() <= 1e-6 * max(1.0, counts.max()):
            break
        column = np.bincount(way, minlength=len(counts)).astype(float)
        if any(np.array_equal(way, w) for w in ways):
            break  # no gain that numbers can tell
        ways.append(way)
        a, x = np.column_stack([a, column]), np.r_[x, 0.0]
        while True:
            square = a.T @ a
            square.flat[:: len(x) + 1] += 1e-9
            trial = np.linalg.solve(square, a.T @ counts)
            if trial.min() > 0:
                x = trial
                break
            low = trial <= 0
            share = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x = x + share * (trial - x)
            keep = x > 1e-12
            ways = [w for w, k in zip(ways, keep) if k]
            a, x = a[:, keep], x[keep]
            if not len(x):
                break
    return list(zip(ways, x.tolist()))


class _Plan:
    """Runs of sequences with equal content: (base, count, filled)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.placed: list[tuple[int, int, int, int, int]] = []  # length, rank, count, base, offset
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.next = 0
        self.fitted = 0  # pieces that patterns have placed

    def put(self, length: int, count: int, base: int, offset: int) -> None:
        self.placed.append((length, int(self.used[length]), count, base, offset))
        self.used[length] += count
        self.left[length] -= count

    def leave(self, base: int, count: int, filled: int) -> None:
        if count and filled < self.capacity:
            self.open.setdefault(self.capacity - filled, []).append((base, count))

    def bins(self, step: int) -> np.ndarray:
        """Pieces left by length in units, rounded up."""
        padded = np.r_[self.left[1:], np.zeros(-self.capacity % step, np.int64)]
        return np.r_[0, padded.reshape(-1, step).sum(axis=1)]

    def pattern(self, parts: np.ndarray, count: int, step: int) -> None:
        """``count`` sequences of one pattern, the longest of each bin first; the
        smallest part takes the longest piece that fits, also from a bin above."""
        runs = [(self.next, count, 0)]
        self.next += count
        for place, part in enumerate(parts.tolist()):
            after = []
            for base, n, filled in runs:
                top = self.capacity - filled if place == len(parts) - 1 else part * step
                low = (part - 1) * step + 1
                for length in (low + np.flatnonzero(self.left[low : top + 1])[::-1]).tolist():
                    take = int(min(n, self.left[length]))
                    if take:
                        self.put(length, take, base, filled)
                        self.fitted += take
                        after.append((base, take, filled + length))
                        base, n = base + take, n - take
                    if not n:
                        break
                if n:
                    after.append((base, n, filled))
            runs = after
        for base, n, filled in runs:
            self.leave(base, n, filled)

    def residuals(self) -> None:
        room = np.zeros(self.capacity + 1, bool)
        for space in self.open:
            room[space] = True
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                spaces = np.flatnonzero(room[length:])
                if not len(spaces):
                    each = self.capacity // length
                    for n, count in ((each, int(self.left[length]) // each), (int(self.left[length]) % each, 1)):
                        if n and count:
                            for k in range(n):
                                self.put(length, count, self.next, k * length)
                            self.leave(self.next, count, n * length)
                            room[self.capacity - n * length] |= n * length < self.capacity
                            self.next += count
                    break
                space = length + int(spaces[0])
                base, count = self.open[space].pop()
                take = int(min(count, self.left[length]))
                filled = self.capacity - space
                self.put(length, take, base, filled)
                self.leave(base, take, filled + length)
                if filled + length < self.capacity:
                    room[space - length] = True
                self.leave(base + take, count - take, filled)
                if not self.open[space]:
                    room[space] = False


def fit(histogram: dict[int, int], capacity: int = 4096, step: int = 16, depth: int = 8, rounds: int = 4, steps: int = 400) -> _Plan:
    """The plan for pieces of these lengths, see above."""
    work = _Plan(histogram, capacity)
    for _ in range(rounds):
        before = work.fitted
        found = least_squares(work.bins(step).astype(float), depth, steps)
        for way, repeats in sorted(found, key=lambda f: -f[1]):
            part, need = np.unique(way, return_counts=True)
            count = int(min(np.ceil(repeats - 1e-6), (work.bins(step)[part] // need).min()))
            if count > 0:
                work.pattern(way, count, step)
        if work.fitted == before:
            break
    work.residuals()
    return work


def plan(histogram: dict[int, int], capacity: int = 4096, **how) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset), sorted."""
    return np.array(sorted(fit(histogram, capacity, **how).placed), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = 4096, sent: int = 200_000, **how) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset."""
    rows = store(cut, "pieces")
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    placed = plan(histogram, capacity, **how)
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    numbered = ranked(rows, [F.col("length")], order, "_rank", "_of").select(*rows.columns, "_rank")
    if len(placed) > sent:
        return _joined(numbered, placed, rows.columns)
    plan_sent = rows.sparkSession.sparkContext.broadcast(placed)
    length_at, rank_at = rows.columns.index("length"), len(rows.columns)

    def place(batches):
        placed = plan_sent.value
        key = (placed[:, 0] << 48) + placed[:, 1]
        for batch in batches:
            rank = batch.column(rank_at).to_numpy()
            at = np.searchsorted(key, (batch.column(length_at).to_numpy() << 48) + rank, "right") - 1
            sequence = placed[at, 3] + rank - placed[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:rank_at], pa.array(sequence), pa.array(placed[at, 4])],
                [*batch.schema.names[:rank_at], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def _joined(numbered: DataFrame, placed: np.ndarray, columns: list[str]) -> DataFrame:
    """Every piece with the last run of its length that begins at or before its rank."""
    names = ["length", "_first", "_count", "_base", "offset"]
    runs = numbered.sparkSession.createDataFrame(pa.table({n: placed[:, i] for i, n in enumerate(names)}))
    found = asof_join(numbered, runs, ["length"], "_rank", "_first", ["_first", "_base", "offset"])
    return found.select(*columns, (F.col("_base") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, with_ids: bool = False, **how) -> DataFrame:
    return pack(pieces(docs, path, capacity, end, with_ids), capacity, **how)
