"""Hard negatives by rotated one-bit codes with residual intervals.

Vectors are whole numbers; a row's score is its inner product with an anchor.
Every vector is coded in ``levels`` steps. A step rotates what is left of the
vector by a fixed orthogonal matrix and keeps the signs, one bit for each
component, with the alignment of the rest and its code vector; the code vector's
share is taken off, and the next step codes the rest of it. Bits, alignments and
the length of the last rest are stored.

An anchor is rotated alike and cut to ``planes`` bits a component, so its product
with a code vector is a sum of popcounts of bit planes. The products by alignment
give the estimate of the score; it is off by at most the sum of

* what the cut of the anchor may add, which is computed,
* the anchor's length times the length of the last rest (Cauchy and Schwarz),

which makes an interval that surely holds the score. The k-th largest lower bound
among rows that surely qualify is reached by k rows, so rows whose upper bound is
less than that, or whose interval misses the band of scores asked for, are let go.
The others are scored in whole numbers. So results are exact, whatever the codes.

Two passes bring every anchor to every block of rows: the first finds its
positives (rows of its label), the second, for each positive, the rows of other
labels within the band. Blocks are dealt by id, so labels and equal vectors of any
number spread; anchors stream through a block in batches; a block gives at most
``k`` rows for an anchor and positive, ranked over blocks afterwards. Nothing is
broadcast.

Defined results: rows whose id, label or vector is null, whose vector is empty or
has a null or non-finite component, or whose squared length as whole numbers is
2**56 or more (scores would leave a long) take no part; of several rows of one id
the one with the least label, then vector, takes part; vectors of different length
never meet; equal scores are ranked by id; an anchor without positives, or a
positive without rows in its band, gives no rows; other columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import store

#: Anchors that meet a block together.
_ANCHORS = 64
_LIMIT = float(1 << 56)


# -- codes -----------------------------------------------------------------------


@lru_cache(maxsize=64)
def rotation(dim: int, level: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng((dim, level)).standard_normal((dim, dim)))[0]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as 64-bit words."""
    n, dim = bits.shape
    wide = np.zeros((n, -(-dim // 64) * 64), np.uint8)
    wide[:, :dim] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def encode(vectors: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (rows, levels, words) of the codes, the alignment of each level's rest
    with its code vector times its length, and the length of the last rest."""
    rest = vectors.astype(np.float64)
    dim = rest.shape[1]
    words, aligned = [], []
    for level in range(levels):
        turned = rest @ rotation(dim, level)
        bits = turned > 0
        share = np.abs(turned).sum(axis=1) / np.sqrt(dim)
        code = np.where(bits, 1.0, -1.0) / np.sqrt(dim)
        rest = rest - share[:, None] * (code @ rotation(dim, level).T)
        words.append(_packed(bits))
        aligned.append(share)
    return np.stack(words, axis=1), np.stack(aligned, axis=1), np.sqrt((rest * rest).sum(axis=1))


def intervals(anchors: np.ndarray, words: np.ndarray, aligned: np.ndarray, rest: np.ndarray, planes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (anchors, rows) that surely hold the scores."""
    anchors = anchors.astype(np.float64)
    dim = anchors.shape[1]
    length = np.sqrt((anchors * anchors).sum(axis=1))
    middle = np.zeros((len(anchors), len(words)))
    error = length[:, None] * rest
    for level in range(aligned.shape[1]):
        turned = anchors @ rotation(dim, level)
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / ((1 << planes) - 1), 1e-300)
        whole = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        cut = np.abs(turned - low[:, None] - whole * step[:, None]).sum(axis=1) / np.sqrt(dim)
        inside = np.zeros((len(anchors), len(words)), np.int64)
        ones = np.zeros(len(words), np.int64)
        for w in range(words.shape[2]):
            ones += np.bitwise_count(words[:, level, w])
        for plane in range(planes):
            bits = _packed((whole >> plane) & 1)
            for w in range(words.shape[2]):
                inside += np.bitwise_count(bits[:, w, None] & words[None, :, level, w]).astype(np.int64) << plane
        # Of the cut components throughout, so that each one's cut counts once.
        product = low[:, None] * (2 * ones - dim) + step[:, None] * (2 * inside - whole.sum(axis=1)[:, None])
        middle += product / np.sqrt(dim) * aligned[:, level]
        error += cut[:, None] * aligned[:, level]
    # Rounding in the sums above, generously.
    error += 1e-9 * (length[:, None] * (rest + aligned.sum(axis=1)) + 1)
    return middle - error, middle + error


# -- blocks ----------------------------------------------------------------------


def _top(ok: np.ndarray, sure: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Where a row may be among the first ``k`` of the rows that qualify: it may
    itself (``ok``), and no ``k`` rows that surely do are surely better."""
    bound = np.where(sure, low, -np.inf)
    if bound.shape[1] > k:
        bound = np.partition(bound, bound.shape[1] - k, axis=1)[:, -k]
    else:
        bound = np.full(len(bound), -np.inf)
    return ok & (high >= bound[:, None])


def _first(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each ``row``, higher scores first, then ids."""
    order = np.lexsort((ids, -score, row))
    first = np.searchsorted(row[order], row[order])
    return order[np.arange(len(order)) - first < k]


def _scores(anchors: np.ndarray, vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of anchor ``a[i]`` with row ``b[i]`` in whole numbers."""
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), 1 << 16):
        out[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", anchors[a[lo : lo + (1 << 16)]], vectors[b[lo : lo + (1 << 16)]])
    return out


class Block:
    """Rows of a block with their codes."""

    def __init__(self, batches: list[pa.RecordBatch], levels: int):
        columns = pa.Table.from_batches(batches).combine_chunks()
        self.ids = columns["vec_id"].to_numpy()
        self.labels = columns["label"].to_numpy()
        self.vectors = _matrix(columns["v"], np.int64)
        self.words = _matrix(columns["words"], np.int64).view(np.uint64).reshape(len(self.ids), levels, -1)
        self.aligned = _matrix(columns["aligned"], np.float64)
        self.rest = columns["rest"].to_numpy()

    def bounds(self, anchors: np.ndarray, planes: int):
        return intervals(anchors, self.words, self.aligned, self.rest, planes)


def _matrix(column, kind) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _positives(block: Block, asked: pa.RecordBatch, k: int, planes: int, band):
    ids, labels, vectors = asked["vec_id"].to_numpy(), asked["label"].to_numpy(), _matrix(asked["v"], np.int64)
    low, high = block.bounds(vectors, planes)
    ok = (block.labels[None, :] == labels[:, None]) & (block.ids[None, :] != ids[:, None])
    a, b = np.nonzero(_top(ok, ok, low, high, k))
    score = _scores(vectors, block.vectors, a, b)
    best = _first(a, score, block.ids[b], k)
    a, b, score = a[best], b[best], score[best]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[a]), pa.array(block.ids[b]), pa.array(score)], ["anchor_id", "vec_id", "score"])


def _negatives(block: Block, asked: pa.RecordBatch, k: int, planes: int, band):
    """``band``: percent of a positive's score, least and most."""
    ids, labels, vectors = asked["vec_id"].to_numpy(), asked["label"].to_numpy(), _matrix(asked["v"], np.int64)
    low, high = block.bounds(vectors, planes)
    other = block.labels[None, :] != labels[:, None]
    lists = asked["positives"]
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    each = lists.flatten()
    positive_id, positive_score = (each.field(n).to_numpy() for n in ("vec_id", "score"))
    out = []
    for turn in range(int(np.diff(at).max(initial=0))):
        rows = np.flatnonzero(np.diff(at) > turn)
        which = at[rows] + turn
        least, most = (positive_score[which][:, None] * np.int64(x) for x in band)
        ok = other[rows] & (100 * high[rows] >= least) & (100 * low[rows] <= most)
        sure = other[rows] & (100 * low[rows] >= least) & (100 * high[rows] <= most)
        a, b = np.nonzero(_top(ok, sure, low[rows], high[rows], k))
        score = _scores(vectors, block.vectors, rows[a], b)
        within = (100 * score >= least[a, 0]) & (100 * score <= most[a, 0])
        a, b, score = a[within], b[within], score[within]
        best = _first(a, score, block.ids[b], k)
        a, b, score = a[best], b[best], score[best]
        out.append((ids[rows[a]], positive_id[which[a]], positive_score[which[a]], block.ids[b], score))
    columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def _meet(coded: DataFrame, anchors: DataFrame, blocks: int, judge, schema: str, k: int, levels: int, planes: int, band=None) -> DataFrame:
    """Rows that ``judge`` gives for every block and batch of ``anchors``, which
    carry the block they go to."""

    def run(batches):
        number, parts, block = None, [], None
        for batch in batches:
            at = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (asks[1:] != asks[:-1]), True])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if at[lo] != number:
                    number, parts, block = at[lo], [], None
                own = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    parts.append(own)
                elif parts:
                    block = block or Block(parts, levels)
                    for x in range(0, len(own), _ANCHORS):
                        yield judge(block, own.slice(x, _ANCHORS), k, planes, band)

    rows = coded.select("block", F.lit(False).alias("asks"), "vec_id", "label", "v", "words", "aligned", "rest")
    rows = rows.unionByName(anchors.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    # A number of partitions of its own: a block is much work for few bytes.
    dealt = rows.repartition(int(min(max(3 * blocks, 1), 50_000)), "block").sortWithinPartitions("block", "asks")
    return dealt.mapInArrow(run, schema)


def encoded(rows: DataFrame, levels: int) -> DataFrame:
    """``rows`` (block, vec_id, label, v) with words, aligned and rest."""

    def run(batches):
        for batch in batches:
            sizes = pa.compute.list_value_length(batch["v"]).to_numpy()
            for dim in np.unique(sizes):
                own = batch.filter(pa.array(sizes == dim))
                words, aligned, rest = encode(_matrix(own["v"], np.int64), levels)
                columns = [pa.array(list(words.reshape(len(own), -1).view(np.int64)), pa.list_(pa.int64())),
                           pa.array(list(aligned), pa.list_(pa.float64())), pa.array(rest)]
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], [*own.schema.names, "words", "aligned", "rest"])

    schema = "block long, vec_id long, label long, v array<long>, words array<long>, aligned array<double>, rest double"
    return rows.select("block", "vec_id", "label", "v").mapInArrow(run, schema)


# -- mining ----------------------------------------------------------------------


def whole_vectors(vectors: DataFrame, scale: float = 256, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v array<long>) of the rows that take part, one for each id;
    components are ``floor(scale * x)``."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~odd)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(scale * x)))
    length = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = rows.where(length < _LIMIT)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_r")).select("vec_id", "_r.label", "_r.v")


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90),
    block_rows: int = 8192, levels: int = 6, planes: int = 6,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score, for the anchors among ``rows`` (vec_id, label, v): of each of
    its first ``positives`` rows of its label, the first ``negatives`` rows of other
    labels that score between the percents ``band`` of it."""
    rows = store(rows, "whole")
    sizes = rows.groupBy(F.size("v").alias("_dim")).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_n"))
    blocks = sizes.agg(F.sum("_n")).first()[0] or 0
    sized = rows.withColumn("_dim", F.size("v")).join(sizes, "_dim")
    key = F.xxhash64("_dim", "_block").alias("block")
    coded = sized.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.col("_n")).cast("int"))
    coded = store(encoded(coded.select(key, "vec_id", "label", "v"), levels), "coded")
    asked = sized.where(is_anchor).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    asked = asked.select(key, "vec_id", "label", "v")
    near = _meet(coded, asked, blocks, _positives, "anchor_id long, vec_id long, score long", positives, levels, planes)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= positives)
    # At most ``positives`` for each anchor.
    lists = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("_place", "vec_id", "score"))).alias("positives"))
    lists = store(lists, "positives")
    again = asked.join(lists, asked["vec_id"] == lists["anchor_id"]).drop("anchor_id")
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _meet(coded, again, blocks, _negatives, schema, negatives, levels, planes, band)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
