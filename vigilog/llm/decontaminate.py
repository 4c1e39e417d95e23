"""Benchmark passages in documents: a prefix-filtered join with exact windows.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z
lower-cased. An item's windows are its runs of ``window`` words; an item of
fewer words is one window of its own size. A window occurs in a document if its
words follow each other there, so all its shingles (``shingle`` words, fewer in
shorter windows) have to occur: the overlap needed is the whole set, and the
prefix is its one rarest shingle, as counted over all documents. Documents are
joined on that shingle; where it stands must leave room for the window's words
before and after it (position and length bounds); then all words are compared.
Every word inside an occurrence is hit.

Windows are sent to the tasks in blocks of at most ``max_windows`` (about 150
bytes each), one pass over the documents for each block; a benchmark that fits
one block needs no shuffle at all.

Defined results: null text or text without words: 0 words, no hits, clean;
items without words have no windows, a null item_id reads as the text "null";
repeated rows are judged alike; an empty benchmark hits nothing; other columns
are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import ALNUM, chunks, shingles, signed, store, text_bytes, word_hashes

RESULT = "_overlap"
_FIELDS = "n_words long, n_hit long, items array<string>, starts array<int>, ends array<int>"


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, words): the distinct windows of each item, as word hashes."""

    def cut(batches):
        for batch in batches:
            items, rows = [], []
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                words, first = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
                for row in range(lo, hi):
                    own = words[first[row - lo] : first[row - lo + 1]].view(np.int64)
                    for at in range(max(1, len(own) - window + 1) if len(own) else 0):
                        items.append(batch.column(0)[row].as_py())
                        rows.append(own[at : at + window])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(rows, pa.list_(pa.int64()))], ["item", "words"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return items.mapInArrow(cut, "item string, words array<long>").distinct()


class _Block:
    """Windows of one block, their shingles and, once counted, their prefixes."""

    def __init__(self, rows: list, window: int, shingle: int):
        self.names = sorted({r.item for r in rows})
        number = {name: i for i, name in enumerate(self.names)}
        self.item = np.array([number[r.item] for r in rows], np.int64)
        self.size = np.array([len(r.words) for r in rows], np.int64)
        self.words = np.zeros((len(rows), window), np.uint64)
        for i, r in enumerate(rows):
            self.words[i, : len(r.words)] = np.array(r.words, np.int64).view(np.uint64)
        # Shingles of each window, by the size of shingle that it uses.
        self.grams: dict[int, tuple] = {}
        used = np.minimum(self.size, shingle)
        for k in np.unique(used):
            which = np.flatnonzero(used == k)
            owner, offset, gram = [], [], []
            for i in which:
                found, _ = shingles(self.words[i, : self.size[i]], np.array([0, self.size[i]]), int(k))
                owner.append(np.full(len(found), i)), offset.append(np.arange(len(found))), gram.append(found)
            self.grams[int(k)] = tuple(map(np.concatenate, (owner, offset, gram)))
        self.tokens = {k: np.unique(g[2]) for k, g in self.grams.items()}
        self.prefix: dict[int, tuple] = {}

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Keeps the rarest shingle of each window; ties by its hash."""
        for k, (owner, offset, gram) in self.grams.items():
            seen = counts[k][np.searchsorted(self.tokens[k], gram)]
            by = np.lexsort((offset, gram, seen, owner))
            lead = by[np.r_[True, owner[by][1:] != owner[by][:-1]]]
            lead = lead[np.argsort(gram[lead], kind="stable")]
            token, first = np.unique(gram[lead], return_index=True)
            self.prefix[k] = token, np.r_[first, len(lead)], owner[lead], offset[lead]
        self.grams, self.tokens = {}, {}

    def hits(self, words: np.ndarray, first: np.ndarray):
        """(row, start, window) of each occurrence in a chunk of documents."""
        rows, starts, ids = [], [], []
        for k, (token, lead, owner, offset) in self.prefix.items():
            gram, run_first = shingles(words, first, k)
            if not len(gram) or not len(token):
                continue
            at = np.searchsorted(token, gram)
            at[at == len(token)] = 0
            place = np.flatnonzero(token[at] == gram)
            at = at[place]
            row = np.searchsorted(run_first, place, "right") - 1
            pos = place - run_first[row] + first[row]
            times = lead[at + 1] - lead[at]
            pick = np.repeat(lead[at] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
            row, start, which = np.repeat(row, times), np.repeat(pos, times) - offset[pick], owner[pick]
            fits = (start >= first[row]) & (start + self.size[which] <= first[row + 1])
            row, start, which = row[fits], start[fits], which[fits]
            same = np.ones(len(row), bool)
            for j in range(self.words.shape[1]):
                longer = j < self.size[which]
                same &= ~longer | (words[np.minimum(start + j, len(words) - 1)] == self.words[which, j])
            rows.append(row[same]), starts.append(start[same]), ids.append(which[same])
        if not rows:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(rows), np.concatenate(starts), np.concatenate(ids)


def _text_chunks(batch, column: int):
    data, offsets = text_bytes(batch.column(column))
    for lo, hi in chunks(offsets):
        words, first = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
        yield hi - lo, words, first


def _count(docs: DataFrame, block: _Block) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(block.tokens)

    def count(batches):
        tokens = sent.value
        total = {k: np.zeros(len(t), np.int64) for k, t in tokens.items()}
        for batch in batches:
            for _, words, first in _text_chunks(batch, 0):
                for k, known in tokens.items():
                    gram, _ = shingles(words, first, k)
                    at = np.searchsorted(known, gram)
                    at[at == len(known)] = 0
                    total[k] += np.bincount(at[known[at] == gram], minlength=len(known))
        for k, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(counts[some])], ["k", "at", "n"])

    found = docs.select("text").mapInArrow(count, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
    out = {k: np.zeros(len(t), np.int64) for k, t in block.tokens.items()}
    for k, at, n in found.collect():  # a row for each shingle of the block at most
        out[k][at] = n
    return out


def _scan(docs: DataFrame, block: _Block) -> DataFrame:
    """``docs`` with the struct ``RESULT`` for the windows of this block."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    column = docs.columns.index("text")
    fields = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                        ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def scan(batches):
        block = sent.value
        for batch in batches:
            out = []
            for rows, words, first in _text_chunks(batch, column):
                row, start, which = block.hits(words, first)
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + block.size[which], -1)
                covered = np.cumsum(depth[:-1]) > 0
                items = np.unique(np.stack([row, block.item[which]]), axis=1)
                lo = np.searchsorted(items[0], np.arange(rows + 1))
                for i in range(rows):
                    own = {"n_words": int(first[i + 1] - first[i]), "n_hit": 0, "items": [], "starts": [], "ends": []}
                    if lo[i] < lo[i + 1]:
                        part = np.r_[False, covered[first[i] : first[i + 1]], False].astype(np.int8)
                        edge = np.diff(part)
                        own["n_hit"] = int(part.sum())
                        own["items"] = [block.names[x] for x in items[1, lo[i] : lo[i + 1]]]
                        own["starts"], own["ends"] = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    out.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, fields)], [*batch.schema.names, RESULT])

    schema = T.StructType([*docs.schema.fields, T.StructField(RESULT, T._parse_datatype_string(_FIELDS))])
    return docs.mapInArrow(scan, schema)


def overlap(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3, max_windows: int = 200_000,
) -> DataFrame:
    """``docs`` with the struct column ``_overlap``: n_words, n_hit, the items
    found and the hit runs of words (starts, ends)."""
    windows = store(_windows(benchmark, window), "windows")
    parts = max(1, -(-windows.count() // max_windows))
    block_of = F.pmod(F.xxhash64("words"), F.lit(parts))
    done = []
    for part in range(parts):
        block = _Block(windows.where(block_of == part).collect(), window, shingle)
        block.order(_count(docs, block))
        if parts == 1:
            return _scan(docs, block)
        key = _scan(docs.select("doc_id", "text"), block)
        done.append(store(key.where(f"{RESULT}.n_hit > 0").select("doc_id", _text_key().alias("_key"), RESULT), "hits"))
    return _merged(docs, done, _scan(docs, _Block([], window, shingle)))


def _text_key() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _merged(docs: DataFrame, done: list[DataFrame], plain: DataFrame) -> DataFrame:
    """The hits of all blocks put together for each row."""
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    runs = every.distinct().select("doc_id", "_key", F.explode(F.arrays_zip(f"{RESULT}.starts", f"{RESULT}.ends")).alias("r"))
    runs = runs.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_set("r")).alias("runs"))
    # Overlapping and touching runs, in order, become one.
    runs = runs.select("doc_id", "_key", F.expr(
        f"""aggregate(transform(runs, x -> struct(x.starts AS s, x.ends AS e)), cast(array() AS array<struct<s:int,e:int>>),
        (acc, x) -> if(size(acc) > 0 AND x.s <= try_element_at(acc, -1).e,
          concat(slice(acc, 1, size(acc) - 1), array(struct(try_element_at(acc, -1).s AS s, greatest(try_element_at(acc, -1).e, x.e) AS e))),
          concat(acc, array(x))))""").alias("runs"))
    items = every.select("doc_id", "_key", F.explode(f"{RESULT}.items").alias("i")).groupBy("doc_id", "_key").agg(
        F.array_sort(F.collect_set("i")).alias("names"))
    found = runs.join(items, ["doc_id", "_key"])
    rows = plain.withColumn("_key", _text_key()).alias("d").join(
        found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d._key = f._key"), "left")
    result = F.struct(
        F.col(f"d.{RESULT}.n_words").alias("n_words"),
        F.expr("coalesce(aggregate(f.runs, 0L, (a, x) -> a + x.e - x.s), 0L)").alias("n_hit"),
        F.expr("coalesce(f.names, cast(array() AS array<string>))").alias("items"),
        F.expr("coalesce(transform(f.runs, x -> x.s), cast(array() AS array<int>))").alias("starts"),
        F.expr("coalesce(transform(f.runs, x -> x.e), cast(array() AS array<int>))").alias("ends"))
    return rows.select(*[F.col(f"d.`{c}`") for c in docs.columns], result.alias(RESULT))


def contaminated(percent: int = 5) -> Column:
    """Hit at all, and at least ``percent`` of the words are."""
    return F.expr(f"{RESULT}.n_hit > 0 AND 100 * {RESULT}.n_hit >= {percent} * {RESULT}.n_words")


def report(docs: DataFrame, benchmark: DataFrame, percent: int = 5, **how) -> DataFrame:
    """One row for each document: counts, items and the verdict."""
    found = overlap(docs.select("doc_id", "text"), benchmark, **how)
    names = F.array_sort(F.array_distinct(F.col(f"{RESULT}.items")))
    return found.select(
        "doc_id", f"{RESULT}.n_words", f"{RESULT}.n_hit", F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), contaminated(percent).alias("contaminated"),
        names.alias("items"), f"{RESULT}.starts", f"{RESULT}.ends")


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = 5, **how) -> DataFrame:
    """The documents that are not contaminated, all columns as they were."""
    return overlap(docs, benchmark, **how).where(~contaminated(percent)).select(*[f"`{c}`" for c in docs.columns])
