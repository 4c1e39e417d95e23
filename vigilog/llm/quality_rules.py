"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Words are runs of everything but ASCII white space. Base counts go over the
whole text; a document fails if it has fewer than ``min_words`` words, or if
words inside repeated windows of eight words are more than
``max_repeat_percent`` of all.

The rest are judged by ``log p(trusted) - log p(corpus)`` of their words and word
pairs, hashed into ``cells`` cells, per n-gram, so length does not count. Both are
multinomials: the corpus' over all documents, the trusted target's over labelled
documents of quality 1 that are not toxic. The corpus' counts are scaled to the
target's total and ``smooth`` is added to both, so that a cell of which too little
is expected says nothing, whatever the size of the corpus. Of the trusted the ``max_trusted`` with the lowest hash of their id are taken, so that
their ids (8 bytes each) can be broadcast. A document stays if its ratio is at
least ``threshold``; nothing is drawn at random.

A few bad words do not move the ratio of a long text, so it is judged by its worst
stretch too: of ``stretch`` words from each ``stretch / 2``-th on, the weights of
words below ``strong`` are summed, over ``stretch``; the lowest sum has to be at
least ``low``. Words that stand near each other are so judged alike in a text of
any length.

Everything is DataFrame functions. A document's n-grams are counted where it is
read, the shuffle has at most ``cells`` rows a task, and the weights (8 bytes a
cell) come back as a scalar subquery; documents are never shuffled.

Defined results: null text has no words and fails the base; windows are compared
by 64-bit hashes; without trusted documents every ratio is 0; repeated rows are
judged alike and labels repeated for an id count once; a null id is not trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.functions.fields import once

from .common import store

_SPACE = " \t\n\x0b\f\r"
RESULT = "_quality"
#: Words of a window; its hash is made by doubling: pairs, fours, eights.
_WINDOW = 8


def _words(text: Column) -> Column:
    """Plain replacements and a split at one character, which need no pattern."""
    for space in _SPACE[1:]:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _split(docs: DataFrame) -> DataFrame:
    """The words of each text, their hashes and those of word pairs."""
    out = docs.withColumn("_words", _words(F.coalesce("text", F.lit(""))))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    return out.withColumn("_pairs", _joined("_hashes", 1))


def _joined(hashes: str, step: int) -> Column:
    """The hashes at i and i + step as one, for all i that have both."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda x, y: F.xxhash64(x, y))


def _cells(cells: int) -> Column:
    """The cells of all words and word pairs, from the first bits of their
    hashes; those of pairs come second."""
    shift = 65 - cells.bit_length() + 1
    return F.concat(
        F.transform("_hashes", lambda h: F.shiftrightunsigned(h, shift)),
        F.transform("_pairs", lambda h: F.shiftrightunsigned(h, shift) + F.lit(cells // 2)))


def weights(docs: DataFrame, trusted: DataFrame, cells: int, smooth: float) -> DataFrame:
    """(cell, weight): the log ratio of each cell that the corpus has."""
    flagged = docs.select("doc_id", "text").join(
        F.broadcast(trusted.withColumn("_trusted", F.lit(1))), "doc_id", "left")
    grams = _split(flagged).select(F.coalesce("_trusted", F.lit(0)).alias("_trusted"), F.explode(_cells(cells)).alias("cell"))
    counts = store(grams.groupBy("cell").agg(F.count("*").alias("raw"), F.sum("_trusted").alias("own")), "cells")
    raw, own = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("own"), F.lit(0))).first()
    if not own:
        return counts.select("cell", F.lit(0.0).alias("weight"))
    expected = F.lit(own / raw) * F.col("raw")  # of the corpus, at the target's size
    return counts.select("cell", F.log((F.col("own") + smooth) / (expected + smooth)).alias("weight"))


def _repeated(windows: Column) -> Column:
    """Words covered by windows whose hash is there twice or more."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(
        # The starts of repeated windows, then the words up to the next start.
        F.transform(F.array(ordered), lambda o: F.sort_array(F.transform(
            F.filter(o, lambda x, k: (F.get(o, k - 1)["h"] == x["h"]) | (F.get(o, k + 1)["h"] == x["h"])),
            lambda x: x["i"]))),
        F.lit(0),
        lambda total, starts: total + F.aggregate(
            F.transform(starts, lambda s, k: F.least(F.lit(_WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(_WINDOW)))),
            F.lit(0), lambda a, x: a + x))


def _lowest(word_weights: Column, stretch: int, strong: float) -> Column:
    """The lowest of the stretches' sums of strongly negative weights, over ``stretch``."""
    return F.get(
        F.transform(F.array(word_weights), lambda every: F.array_min(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(every) - 1, F.lit(0)), F.lit(max(1, stretch // 2))),
            lambda start: F.aggregate(
                F.slice(every, start + 1, stretch), F.lit(0.0), lambda a, w: a + F.when(w < strong, w).otherwise(0.0))))),
        F.lit(0)) / stretch


def judged(
    docs: DataFrame, labels: DataFrame, min_words: int = 20, max_repeat_percent: int = 30,
    cells: int = 1 << 17, smooth: float = 10.0, max_trusted: int = 20_000, threshold: float = -0.1,
    stretch: int = 64, strong: float = -1.0, low: float = -0.075,
) -> DataFrame:
    """``docs`` with the struct ``_quality``: the counts, ratio, lowest stretch and verdicts."""
    trusted = (
        labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    )
    rows = weights(docs, trusted, cells, smooth)
    weight = _table(rows, cells).scalar()

    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(F.struct(*columns).alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    out = _split(out).withColumn("_fours", _joined("_pairs", 2))
    # Where no four words come again, no window does.
    single = F.size(F.array_distinct("_fours")) == F.size("_fours")
    out = out.withColumn("_windows", F.when(single, F.array().cast("array<bigint>")).otherwise(_joined("_fours", 4)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0)
    out = out.select("_row", "text", "_words", "_windows", _cells(cells).alias("_cells"), lines.alias("_lines"))
    out = out.select(
        "_row", "_cells",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0))
        .otherwise(_repeated(F.col("_windows"))).cast("long").alias("n_repeat_words"))
    # The optimizer puts the subquery into the sums, so the weights are no part of any
    # row; it does so only for a column used once, so there is one for each.
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    total = F.aggregate("_cells", F.lit(0.0), lambda a, c: a + F.get("_weight", c))
    n = F.shiftright(F.size("_cells") + 1, 1)  # the words; the rest are their pairs
    words = F.transform(F.slice("_cells", F.lit(1), n), lambda c: F.get("_weight_of_word", c))
    out = out.withColumns({"_weight": weight, "_weight_of_word": weight}).select(
        "_row", *base, (total / F.greatest(F.size("_cells"), F.lit(1))).alias("_ratio"),
        _lowest(words, stretch, strong).alias("_lowest"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = ~F.col("base_failed") & (F.col("_ratio") >= threshold) & (F.col("_lowest") >= low)
    result = F.struct(*names, good.alias("kept"), F.col("_ratio").alias("ratio"), F.col("_lowest").alias("lowest"))
    # Generated, so that a filter on the verdict is not copied below the steps above.
    return out.select("_row", once(result).alias(RESULT)).select("_row.*", RESULT)


def _table(rows: DataFrame, cells: int) -> DataFrame:
    """One row: the weights as an array by cell (8 bytes a cell, whatever the input)."""
    every = rows.sparkSession.range(cells).select(F.col("id").alias("cell"))
    filled = every.join(rows, "cell", "left").select("cell", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "weight"))), lambda x: x["weight"]).alias("w"))


def report(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    found = judged(docs.select("doc_id", "text"), labels, **how)
    return found.select("doc_id", f"{RESULT}.*")


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that are kept, all columns as they were."""
    return judged(docs, labels, **how).where(f"{RESULT}.kept").select(*[f"`{c}`" for c in docs.columns])
