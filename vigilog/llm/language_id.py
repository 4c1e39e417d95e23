"""Language identification by words first, character n-grams for unseen words.

Training counts the words (runs of Unicode letters with their marks, lower case)
of all training documents by language, and the n-grams of the different words,
word ends marked, of 5 letters down to 1. All counts are kept, rare ones too.

A document's score for a language is the sum over its words of the word's log
frequency there; a word that training has not seen takes the mean log frequency of
its known 5-grams, or of its 4-grams if it has none of those, and so on down. The
language with the highest sum wins, ties by name; ``score`` is its share of the
sum over languages of likelihoods. Source and id are no inputs.

Words are counted in the tasks and summed by Spark. Every different word of the
corpus gets its log frequencies once, by joins, unseen ones by rounds over the
n-gram sizes. The most frequent words, ``cells`` numbers at most, are sent to the
tasks that score documents; the others, few of which occur in any one place, leave
the tasks as (document, word) and are joined with the table of words. So what is
broadcast has a bound and the result does not depend on it. Documents are never
shuffled. Words and n-grams are told apart by 64-bit hashes.

Defined results: null text or text without a letter: ``und``, score 0; without
training documents every document is ``und``; training rows of null text or
language teach nothing; repeated rows count each; texts of any length are cut
between words into pieces of about a million characters; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import _A, _C, _base_powers, mix, store

SIZES = (5, 4, 3, 2, 1)
#: Characters looked at together.
_PIECE = 1 << 20
#: Different words that a task counts before it hands them on.
_TABLE = 400_000

_BREAK = regex.compile(r"[^\p{L}\p{M}]")
#: Code points from which on there are no letters but for the planes named here.
_PLANES = [(0, 0x33480), (0xE0100, 0xE01F0)]


# -- words of text -----------------------------------------------------------------


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 1 for a letter, 2 for a mark; and a 64-bit value."""
    kind = np.zeros(0x110000, np.uint8)
    for lo, hi in _PLANES:
        kind[lo:hi] = [{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(lo, hi)]
    return kind, mix(np.arange(1, 0x110001, dtype=np.uint64) * _A)


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, inverse = _base_powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_tables()[1][codes] * powers[: len(codes)], out=sums[1:])
    out = (sums[ends] - sums[starts]) * inverse[starts]
    out += (ends - starts).astype(np.uint64) * _C
    return mix(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and lower-case texts, about ``_PIECE`` characters at a time; longer
    texts are cut between words."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        rest = text.lower() if text else ""
        while rest:
            cut = _BREAK.search(rest, _PIECE) if len(rest) > _PIECE else None
            part, rest = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
            if held + len(part) > _PIECE and held:
                yield rows, parts
                rows, parts, held = [], [], 0
            rows.append(row), parts.append(part)
            held += len(part)
    if rows:
        yield rows, parts


def words_in(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]]:
    """Of all words of ``texts``, piece by piece: row, hash, start and end in the
    piece's text, which comes last."""
    for rows, parts in _pieces(texts):
        whole = "\n".join(parts)
        codes = _codes(whole)
        kind = _tables()[0][codes]
        inside = kind > 0
        edge = np.diff(np.r_[0, inside, 0])
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if (kind[starts] == 2).any():  # a word begins at its first letter
            letters = np.r_[np.flatnonzero(kind == 1), len(kind)]
            starts = letters[np.searchsorted(letters, starts)]
            real = starts < ends
            starts, ends = starts[real], ends[real]
        begin = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        row = np.array(rows)[np.searchsorted(begin, starts, "right") - 1]
        yield row, _hashes(codes, starts, ends), starts, ends, whole


def grams_of(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, hash) of the n-grams of words with marked ends; a 1-gram
    has no marks. Characters of words are letters, so marks are told from them."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = "^" + "$^".join(words) + "$" if size > 1 else "".join(words)
    lengths = np.array([len(w) for w in words]) + (2 if size > 1 else 0)
    word = np.repeat(np.arange(len(words)), lengths)
    codes = _codes(whole)
    starts = np.arange(len(codes) - size + 1)
    starts = starts[word[starts] == word[starts + size - 1]] if len(starts) else starts
    return word[starts], _hashes(codes, starts, starts + size)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# -- counts ------------------------------------------------------------------------


def _word_counts(docs: DataFrame, teaches: Column) -> DataFrame:
    """(hash, word, lang, n) over all documents; ``lang`` is null where the document
    does not teach."""

    def count(batches):
        places: dict[tuple[int, str | None], int] = {}
        hashes, words, langs, counts = [], [], [], []

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(words, pa.string()),
                 pa.array(langs, pa.string()), pa.array(counts, pa.int64())], ["hash", "word", "lang", "n"])
            for x in (places, hashes, words, langs, counts):
                x.clear()
            return out

        for batch in batches:
            tags = batch.column(0).to_pylist()
            names = list(dict.fromkeys(tags))
            number = {name: i for i, name in enumerate(names)}
            code = np.array([number[t] for t in tags], np.int64)
            for row, own, starts, ends, whole in words_in(batch.column(1).to_pylist()):
                lang = code[row]
                for k in np.unique(lang).tolist():
                    mine = np.flatnonzero(lang == k)
                    found, first, n = np.unique(own[mine], return_index=True, return_counts=True)
                    at = mine[first]
                    name = names[k]
                    for h, s, e, c in zip(found.tolist(), starts[at].tolist(), ends[at].tolist(), n.tolist()):
                        place = places.setdefault((h, name), len(hashes))
                        if place == len(hashes):
                            hashes.append(h), words.append(whole[s:e]), langs.append(name), counts.append(c)
                        else:
                            counts[place] += c
                if len(hashes) > _TABLE:
                    yield flush()
        yield flush()

    rows = docs.select(F.when(teaches, F.col("lang")).alias("lang"), "text").where("text is not null")
    counts = rows.mapInArrow(count, "hash long, word string, lang string, n long")
    return counts.groupBy("hash", "word", "lang").agg(F.sum("n").alias("n"))


def _gram_rows(words: DataFrame, keep: list[str], sizes: tuple[int, ...]) -> DataFrame:
    """``words`` (word first, then ``keep``) as (keep, size, gram)."""
    names = [*keep, "size", "gram"]

    def spell(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            for size in sizes:
                word, gram = grams_of(words, size)
                rows = batch.select(keep).take(pa.array(word))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.full(len(gram), size, np.int32)), _signed(gram)], names)

    schema = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in keep)
    return words.select("word", *keep).mapInArrow(spell, f"{schema}, size int, gram long")


def _by_language(langs: list[str]) -> list[Column]:
    return [F.sum(F.when(F.col("lang") == lang, F.col("n"))).alias(f"c{i}") for i, lang in enumerate(langs)]


def _logs(langs: list[str], totals: Column, counts: str = "c") -> Column:
    """Log frequencies of the counts c0, c1, ... given the ``totals``; what a
    language has not seen gets half a count."""
    return F.array(*[F.log(F.coalesce(F.col(f"{counts}{i}").cast("double"), F.lit(0.5)) / totals[i]) for i in range(len(langs))])


# -- the model ---------------------------------------------------------------------


class Model:
    """``vectors`` (hash, n, v): each different word's number in the corpus and its
    log frequencies by language, in the order of ``langs``."""

    def __init__(self, langs: list[str], vectors: DataFrame | None):
        self.langs, self.vectors = langs, vectors


def train(docs: DataFrame, teaches: Column) -> Model:
    """Log frequencies of all words of ``docs`` (text, lang), learned from the rows
    for which ``teaches`` holds."""
    counts = store(_word_counts(docs, teaches & F.col("lang").isNotNull()), "words")
    taught = counts.where("lang is not null")
    totals = {r.lang: r.n for r in taught.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    langs = sorted(totals)
    if not langs:
        return Model([], None)
    total = F.array(*[F.lit(float(totals[x])) for x in langs])
    words = store(counts.groupBy("hash", "word").agg(F.sum("n").alias("n"), *_by_language(langs)), "vocabulary")
    seen = F.coalesce(*[F.col(f"c{i}") for i in range(len(langs))]).isNotNull()
    known = words.where(seen).select("hash", "n", _logs(langs, total).alias("v"))
    unseen = words.where(~seen).select("word", "hash", "n")

    # A gram counts once for each different word of a language that has it.
    grams = _gram_rows(taught.select("word", "lang"), ["lang"], SIZES).groupBy("lang", "size", "gram").agg(F.count("*").alias("n"))
    grams = store(grams, "grams")
    of_size = {(r.size, r.lang): r.n for r in grams.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    found = [known]
    todo = unseen
    for size in SIZES:
        sums = F.array(*[F.lit(float(of_size.get((size, x), 1))) for x in langs])
        table = grams.where(F.col("size") == size).groupBy("gram").agg(*_by_language(langs))
        table = table.select("gram", *[x.alias(f"v{i}") for i, x in enumerate(_each(_logs(langs, sums), langs))])
        hits = _gram_rows(todo, ["hash", "n"], (size,)).join(table, "gram").groupBy("hash", "n").agg(
            *[F.avg(f"v{i}").alias(f"v{i}") for i in range(len(langs))])
        hits = store(hits.select("hash", "n", F.array(*[f"v{i}" for i in range(len(langs))]).alias("v")), "unseen")
        found.append(hits)
        todo = store(todo.join(hits.select("hash"), "hash", "left_anti"), "todo")
    # Words without any known letter say nothing.
    found.append(todo.select("hash", "n", F.array(*[F.lit(0.0)] * len(langs)).alias("v")))
    vectors = found[0]
    for more in found[1:]:
        vectors = vectors.unionByName(more)
    return Model(langs, store(vectors, "vectors"))


def _each(values: Column, langs: list[str]) -> list[Column]:
    return [values[i] for i in range(len(langs))]


class _Lookup:
    """Rows of a table by 64-bit keys, mostly by one look at a slot."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(math.ceil(math.log2(max(len(keys), 1)))) + 2)
        self.levels = []
        rest = np.arange(len(keys))
        for level in range(3):
            slots = np.full(1 << self.bits, -1, np.int32)
            at = self._slot(keys[rest], level)
            _, first = np.unique(at, return_index=True)
            slots[at[first]] = rest[first]
            rest = np.delete(rest, first)
            self.levels.append(slots)
        self.rest = rest[np.argsort(keys[rest])]

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys >> np.uint64(20 * level)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it is not there."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        todo = np.arange(len(keys))
        for level, slots in enumerate(self.levels):
            own = keys[todo]
            at = slots[self._slot(own, level)]
            hit = (at >= 0) & (self.keys[at] == own)
            out[todo[hit]] = at[hit]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            sorted_keys = self.keys[self.rest]
            at = np.minimum(np.searchsorted(sorted_keys, keys[todo]), len(sorted_keys) - 1)
            hit = sorted_keys[at] == keys[todo]
            out[todo[hit]] = self.rest[at[hit]]
        return out


def _frequent(model: Model, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log frequencies of the words that occur most, ``cells`` numbers at
    most: all those with at least a power of two of occurrences."""
    most = cells // (len(model.langs) + 1)
    power = F.floor(F.log2("n")).alias("p")
    steps = {r.p: r.k for r in model.vectors.groupBy(power).agg(F.count("*").alias("k")).collect()}  # 63 rows at most
    least, total = None, 0
    for p in sorted(steps, reverse=True):
        total += steps[p]
        if total > most:
            break
        least = p
    if least is None:
        return np.zeros(0, np.uint64), np.zeros((0, len(model.langs)))
    rows = model.vectors.where(power >= least).select("hash", "v").toArrow()
    keys = rows["hash"].to_numpy().view(np.uint64)
    return keys, rows["v"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)


def predict(docs: DataFrame, model: Model, cells: int = 1_000_000) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; ``cells`` is how many numbers are
    sent to the tasks and does not change results."""
    ids = F.col("doc_id").cast("long").alias("doc_id")
    if not model.langs:
        return docs.select(ids, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    langs = model.langs
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(model, cells))

    def rows(batches):
        keys, table = sent.value
        look = _Lookup(keys)
        for batch in batches:
            n = batch.num_rows
            sums, words = np.zeros((n, len(langs))), np.zeros(n, np.int64)
            rare_row, rare = [], []
            for row, own, *_ in words_in(batch.column(1).to_pylist()):
                words += np.bincount(row, minlength=n)
                at = look(own)
                known = at >= 0
                for k in range(len(langs)):
                    sums[:, k] += np.bincount(row[known], table[at[known], k], minlength=n)
                rare_row.append(row[~known]), rare.append(own[~known])
            of = np.concatenate(rare_row) if rare else np.zeros(0, np.int64)
            bounds = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(list(sums), pa.list_(pa.float64())),
                 pa.ListArray.from_arrays(pa.array(bounds), _signed(np.concatenate(rare) if rare else np.zeros(0, np.uint64)))],
                ["doc_id", "words", "sums", "rare"])

    parts = docs.select(ids, "text").mapInArrow(rows, "doc_id long, words long, sums array<double>, rare array<long>")
    parts = store(parts.withColumn("_row", F.monotonically_increasing_id()), "sums")
    # A word that is not sent is rare, so none of these keys is hot.
    rare = parts.select("_row", F.explode("rare").alias("hash")).join(model.vectors.select("hash", "v"), "hash")
    more = rare.groupBy("_row").agg(*[F.sum(F.col("v")[i]).alias(f"m{i}") for i in range(len(langs))])
    whole = parts.join(more, "_row", "left")
    sums = F.array(*[F.col("sums")[i] + F.coalesce(f"m{i}", F.lit(0.0)) for i in range(len(langs))])
    whole = whole.select("doc_id", "words", sums.alias("sums")).withColumn("best", F.array_max("sums"))
    place = F.array_position("sums", F.col("best"))
    share = 1 / F.aggregate("sums", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("best")))
    none = F.col("words") == 0
    return whole.select(
        "doc_id", F.when(none, "und").otherwise(F.array(*map(F.lit, langs))[(place - 1).cast("int")]).alias("lang_pred"),
        F.when(none, 0.0).otherwise(share).alias("score"))


def held_out(of: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id reads as empty text."""
    return F.crc32(F.coalesce(F.col(of).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, cells: int = 1_000_000) -> DataFrame:
    """Learns from the documents that are not held out and judges every one."""
    rows = docs.select("doc_id", "text", "lang")
    found = predict(rows, train(rows, ~held_out()), cells)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
