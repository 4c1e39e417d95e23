"""Repeated byte strings across documents: prefix doubling over sampled positions.

Each byte covered by a string of ``length`` bytes that also starts in a document
with a smaller doc_id is removed. Strings are judged on the input; matches never
cross documents.

Prefix doubling ranks positions by their first 16 bytes, then by pairs of ranks
at growing offsets, and lets positions go whose rank is unique. To rank every
position of the corpus a round would move some 12 bytes per byte of text; so the
first round is run on a sample that misses no string: among the 16-byte prefixes
inside a string of ``length`` bytes the one with the smallest hash (the leftmost
of equals) is its anchor, which depends on the string alone. Equal strings have
equal anchors at equal places, and an anchor serves some 17 strings.

1. Anchors are counted by their 16-byte rank; ranks of one document leave.
2. Anchors that stay bring the bytes of the strings they serve. Spark brings
   equal ranks together, sorted by document; there positions get the rank of
   their first 32 bytes from the pair (rank, rank 16 bytes on), unique ones
   leave, and the rest the rank of ``length`` bytes from the pair at offset
   ``length - 32``. A position whose rank was seen in an earlier document goes.
3. Ranks that occur more often than ``hot`` go another way: their strings are
   aggregated by the final rank with partial minima and joined back, so that no
   task has to hold a group without a bound.

Exact copies are found first by a digest of the text and take no part in 1 to 3.
Ranks are 64-bit hashes; the first is cut to 48 bits, where a clash only lets a
position stay longer.

Defined results: null text is empty; null doc_id: nothing is removed and it is
no source; repeated rows of one doc_id are not sources for each other; texts
shorter than ``length`` bytes stay whole; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import _A, _B, _C, chunks, may_contain, membership, mix, store, text_bytes

_GRAM = 16


def _names16(data: np.ndarray) -> np.ndarray:
    """A 64-bit name of the 16 bytes at every place of ``data``."""
    n = len(data) - _GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.ascontiguousarray(data)
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(padded) - 7, 8), (1, 1))
    words = np.ascontiguousarray(words).view("<u8").ravel()
    return mix(words[:n] * _A ^ (words[8 : 8 + n] + _C) * _B)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix((left * _B) ^ (right + _A) * _C)


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Of a chunk: names, and for each anchor its row, its place and the first
    and last string it serves."""
    names = _names16(data)
    width = length - _GRAM + 1
    strings = len(data) - length + 1
    if strings <= 0:
        return names, *(np.zeros(0, np.int64),) * 4
    low = ((names & np.uint64(0xFFFFFFFF)) << np.uint64(32)) | np.arange(len(names), dtype=np.uint64)
    out, done, step, span, rest = None, 0, low, 1, width
    while rest:  # sliding minimum of any width by powers of two
        if rest & 1:
            if out is None:
                out, done = step, span
            else:
                m = len(low) - done - span + 1
                out = np.minimum(out[:m], step[done : done + m])
                done += span
        rest >>= 1
        if rest:
            step = np.minimum(step[:-span], step[span:])
            span *= 2
    owner = (out & np.uint64(0xFFFFFFFF)).astype(np.int64)[:strings]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(row[:strings] == row[length - 1 :])
    if not len(start):
        return names, *(np.zeros(0, np.int64),) * 4
    own, of = owner[start], row[start]
    new = np.r_[True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return names, of[first], own[first], start[first], start[last]


def _gram(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(16)).astype(np.int64)


def _chunked(batch, column):
    data, offsets = text_bytes(batch.column(column))
    for lo, hi in chunks(offsets):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _repeated(texts: DataFrame, length: int) -> DataFrame:
    """(gram, rows): anchor ranks of two documents or more."""

    def count(batches):
        for batch in batches:
            for _, _, data, at in _chunked(batch, 0):
                names, row, place, _, _ = _anchors(data, at, length)
                gram = _gram(names[place])
                order = np.lexsort((gram, row))
                row, gram = row[order], gram[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])][: len(row)])
                times = np.diff(np.r_[new, len(row)])
                yield pa.RecordBatch.from_arrays([pa.array(gram[new]), pa.array(times.astype(np.int64))], ["gram", "times"])

    seen = texts.select("text").mapInArrow(count, "gram long, times long")
    return seen.groupBy("gram").agg(F.count("*").alias("docs"), F.sum("times").alias("rows")).where("docs > 1")


def _contexts(texts: DataFrame, length: int, sieve: np.ndarray | None, but: np.ndarray | None, only_hot: bool) -> DataFrame:
    """(gram, doc_id, key, at, bytes) of the anchors that pass the filter: the
    bytes span all strings the anchor serves, ``at`` is where they begin."""
    sent = texts.sparkSession.sparkContext.broadcast((sieve, but))

    def rows(batches):
        sieve, but = sent.value
        for batch in batches:
            for lo, hi, data, at in _chunked(batch, 2):
                names, row, place, first, last = _anchors(data, at, length)
                gram = _gram(names[place])
                keep = np.ones(len(gram), bool) if sieve is None else may_contain(gram, sieve)
                if but is not None:
                    keep &= may_contain(gram, but) == only_hot
                gram, row, first, last = gram[keep], row[keep], first[keep], last[keep]
                size = last - first + length
                ends = np.cumsum(size)
                total = int(ends[-1]) if len(ends) else 0
                take = np.repeat(first - (ends - size), size) + np.arange(total)
                body = data[take]
                span = pa.Array.from_buffers(
                    pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
                which = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), batch.column(0).take(which), batch.column(1).take(which),
                     pa.array((first - at[row]).astype(np.int32)), span], ["gram", "doc_id", "key", "at", "bytes"])

    return texts.mapInArrow(rows, "gram long, doc_id long, key long, at int, bytes binary")


def _strings(body: pa.Array, length: int):
    """Row, place in the row and place in all bytes of every string; the bytes."""
    data, at = text_bytes(body)
    times = np.diff(at) - length + 1
    row = np.repeat(np.arange(len(times)), times)
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return data, row, within, at[row] + within


def _runs(doc, key, at, row, within, removed, length):
    """Byte runs (s, e) of neighbouring removed strings of one anchor."""
    hit = np.flatnonzero(removed)
    row, within = row[hit], within[hit]
    new = np.r_[True, (row[1:] != row[:-1]) | (within[1:] != within[:-1] + 1)][: len(row)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(row)][: len(first)] - 1
    own = row[first]
    which = pa.array(own)
    s = at[own] + within[first]
    return pa.RecordBatch.from_arrays(
        [doc.take(which), key.take(which), pa.array(s.astype(np.int32)),
         pa.array((at[own] + within[last] + length).astype(np.int32))] if len(own) else
        [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())],
        ["doc_id", "key", "s", "e"])


def _doubled(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, s, e): removed runs, for ranks with a bound on their rows."""

    def groups(table: pa.Table) -> pa.RecordBatch:
        doc, key = table.column(1).combine_chunks(), table.column(2).combine_chunks()
        at = table.column(3).to_numpy().astype(np.int64)
        data, row, within, place = _strings(table.column(4), length)
        names = _names16(data)
        ids = doc.to_numpy()[row]
        # Offset 16: the rank of 32 bytes; unique ones leave.
        half = _pair(names[place], names[place + _GRAM])
        _, inverse, times = np.unique(half, return_inverse=True, return_counts=True)
        stay = np.flatnonzero(times[inverse] > 1)
        # Offset length - 32: the rank of the whole string.
        step = place[stay] + length - 2 * _GRAM
        full = _pair(half[stay], _pair(names[step], names[step + _GRAM]))
        _, first, inverse = np.unique(full, return_index=True, return_inverse=True)
        removed = np.zeros(len(row), bool)
        # Rows come by rank and document, so the first of equals is the earliest.
        removed[stay] = ids[stay] > ids[stay][first][inverse]
        return _runs(doc, key, at, row, within, removed, length)

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            size += batch.num_rows
            gram = batch.column(0).to_numpy()
            if gram[0] == gram[-1] and gram[0] == waiting[0].column(0)[0].as_py():
                continue
            cut = int(np.searchsorted(gram, gram[-1], "left"))  # the last rank may go on
            whole = pa.Table.from_batches([*waiting[:-1], batch.slice(0, cut)])
            waiting = [batch.slice(cut)]
            if whole.num_rows:
                yield groups(whole)
        if waiting:
            yield groups(pa.Table.from_batches(waiting))

    together = rows.repartition("gram").sortWithinPartitions("gram", "doc_id")
    return together.mapInArrow(run, "doc_id long, key long, s int, e int")


def _hot_runs(rows: DataFrame, length: int) -> DataFrame:
    """The same for ranks without a bound: by partial minima and a join."""

    def strings(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, row, within, place = _strings(batch.column(4), length)
            names = _names16(data)
            step = place + length - 2 * _GRAM
            full = _pair(_pair(names[place], names[place + _GRAM]), _pair(names[step], names[step + _GRAM]))
            at = batch.column(3).to_numpy()[row] + within
            which = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.view(np.int64)), batch.column(1).take(which), batch.column(2).take(which), pa.array(at.astype(np.int32))],
                ["string", "doc_id", "key", "s"])

    every = rows.mapInArrow(strings, "string long, doc_id long, key long, s int")
    first = every.groupBy("string").agg(F.min("doc_id").alias("_first"))
    return every.join(first, "string").where("doc_id > _first").select(
        "doc_id", "key", "s", (F.col("s") + length).alias("e"))


def repeats(docs: DataFrame, length: int = 50, hot: int = 200_000, max_bits: int = 1 << 29, small: int = 2_000_000) -> DataFrame:
    """(doc_id, key, spans): the removed byte runs of documents that have any.

    ``hot``: rows of one rank that a task may hold; ``max_bits``: the size of the
    filter of repeated ranks, beyond it they are joined; ``small``: ids of exact
    copies that are broadcast at most, beyond it they are joined.
    """
    if length < 2 * _GRAM:
        raise ValueError(f"length must be at least {2 * _GRAM}")
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), "text")
    heads = store(texts.select(
        "doc_id", "key", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size")), "heads")
    long = heads.where(f"size >= {length}")
    first = long.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n"))
    copies = store(long.join(first.where("_n > 1"), "digest").where("doc_id > _first").select(
        "doc_id", "key", F.lit(0).alias("s"), F.col("size").cast("int").alias("e")).distinct(), "copies")
    gone = copies.select("doc_id", "key")
    if copies.count() <= small:  # 16 bytes each
        gone = F.broadcast(gone)
    texts = texts.where(F.octet_length("text") >= length).join(gone, ["doc_id", "key"], "left_anti")

    again = store(_repeated(texts, length), "repeated")
    grams, most = again.agg(F.count("*"), F.max("rows")).first()
    sieve = membership(again.select("gram"), grams, max_bits)

    def rows(but, only_hot):
        found = _contexts(texts, length, sieve, but, only_hot)
        return found if sieve is not None else found.join(again.select("gram"), "gram", "left_semi")

    if (most or 0) > hot:
        many = again.where(F.col("rows") > hot)
        but = membership(many.select("gram"), many.count(), max_bits)
        if but is None:
            raise ValueError("raise max_bits or hot: the frequent ranks do not fit the filter")
        found = _doubled(rows(but, False), length).union(_hot_runs(rows(but, True), length))
    else:
        found = _doubled(rows(None, False), length)
    return found.union(copies).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def _joined(docs: DataFrame, length: int, how: dict) -> DataFrame:
    found = repeats(docs, length, **how).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    on = (docs["doc_id"] == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_key"))
    return docs.join(found, on, "left").select(*[docs[c] for c in docs.columns], "_spans")


def report(docs: DataFrame, length: int = 50, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the spans of each row."""

    def rows(batches):
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                body = (text or "").encode()
                runs = _merged(spans)
                kept, at = hashlib.sha256(), 0
                for s, e in runs:
                    kept.update(body[at:s])
                    at = e
                kept.update(body[at:])
                out.append((doc, len(body), sum(e - s for s, e in runs), len(runs), kept.hexdigest(),
                            [{"s": s, "e": e} for s, e in runs]))
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return _joined(docs.select("doc_id", "text"), length, how).mapInArrow(
        rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:int,e:int>>")


def remove_repeats(docs: DataFrame, length: int = 50, **how) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``, ``n_chars`` set
    anew where there is one. A character goes if all its bytes do, so the text
    stays valid. No row is dropped; a text that goes whole becomes empty."""
    names = docs.columns

    def cut(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(names.index("text")).to_pylist(), batch.column(len(names)).to_pylist()):
                if spans:
                    body, kept, at = text.encode(), [], 0
                    for s, e in _merged(spans):
                        while s < e and body[s] & 0xC0 == 0x80:
                            s += 1
                        while e > s and e < len(body) and body[e] & 0xC0 == 0x80:
                            e -= 1
                        kept.append(body[at:s])
                        at = e
                    text = b"".join([*kept, body[at:]]).decode()
                texts.append(text)
            columns = dict(zip(names, batch.columns))
            columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    out = _joined(docs, length, how).mapInArrow(cut, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
