"""Near duplicates by word shingles: a Jaccard self-join over adaptive prefixes.

A document is the set of its distinct shingles of ``size`` words (ASCII white
space parts words, A-Z are lower-cased); with fewer words the whole sequence is
its one shingle. Two documents link when ``100 * |x & y| >= percent * |x | y|``.

Shingles have one global order: the rare first, by a sketch that counts every
shingle of every document in hashed cells. If x and y link, the first
``|x| - o + m`` shingles of x and ``|y| - o + m`` of y share at least ``m``, where
``o`` is the overlap they need. Each document chooses its own ``m`` (``need``): a
longer prefix costs more rows to join, but asks for more shared shingles before
a pair is verified; the cheapest estimate from the counts of its own shingles
wins. A pair is a candidate if it shares the smaller of its two ``need``s within
prefixes, sizes and positions permitting, and is then verified on whole sets.

Copies and hot groups: documents of equal sets are one representative. Before
pairs are formed, each shingle's documents are compared with one pivot; links
found join components. Only pairs across components remain to be looked at, and
they start from the rows outside the largest component of a shingle, so a group
of thousands of near copies does not become all its pairs. No link between
different components is lost, so the components are exact.

Defined results: null, empty or word-less text: no shingles, linked with
nothing; null doc_id: as such, component null; repeated rows: one result row
each, rows of one doc_id share a component; columns beyond doc_id and text are
ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import (
    NOT_SPACE, chunks, components, may_contain, membership, mix, shingles, store, text_bytes, word_hashes,
)

#: Cells of the counting sketch: its size does not depend on the data.
SKETCH_BITS = 20
_BLOCK_BITS = 12


def _sets(text: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, offsets = text_bytes(text)
    for lo, hi in chunks(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        words, first = word_hashes(data[offsets[lo] : offsets[hi]], at, NOT_SPACE)
        runs, run_first = shingles(words, first, size)
        counts = np.diff(first)
        for row in range(hi - lo):
            if counts[row] >= size:
                found = np.sort(runs[run_first[row] : run_first[row + 1]])
                keep = np.empty(len(found), bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif counts[row]:
                whole = np.zeros(1, np.uint64)
                for word in words[first[row] : first[row + 1]]:
                    whole = mix(whole * np.uint64(3) + word)
                yield mix(whole + np.uint64(counts[row]))
            else:
                yield np.zeros(0, np.uint64)


def _node(found: np.ndarray) -> int:
    """One 64-bit name for a set of hashes."""
    sums = np.array([np.bitwise_xor.reduce(found), found.sum(), mix(found).sum(), len(found)], np.uint64)
    return int(mix(mix(mix(sums[:1] + sums[3]) + sums[1]) + sums[2]).view(np.int64)[0])


def _sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of the shingles of all documents, by hashed cell."""
    cells, block = 1 << SKETCH_BITS, 1 << _BLOCK_BITS

    def count(batches):
        total = np.zeros(cells, np.int64)
        found, held = [], 0
        for batch in batches:
            for own in _sets(batch.column(0), size):
                found.append((own >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                held += len(own)
                if held > cells // 2:
                    total += np.bincount(np.concatenate(found), minlength=cells)
                    found, held = [], 0
        if found:
            total += np.bincount(np.concatenate(found), minlength=cells)
        parts = total.astype(np.int32).reshape(-1, block)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64)
                total[key] = total[key] + more if key in total else more
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    blocks = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros(cells, np.int64)
    for key, counts in blocks.collect():  # 8 bytes a cell, whatever the input
        out[key * block : (key + 1) * block] = np.frombuffer(counts, np.int64)
    return out


def _document_rows(docs: DataFrame, size: int, percent: int, max_need: int, verify_cost: float) -> DataFrame:
    """doc_id, n, node (a hash of the set), need, short and prefix of each row."""
    counts = _sketch(docs, size)
    noise = float(np.median(counts))
    # Half-octave classes keep the order equal for every task and small to send.
    classes = np.floor(2 * np.log2(1 + np.maximum(counts, 0))).astype(np.uint8)
    level = np.maximum(1.0, 2.0 ** (np.arange(256) / 2.0) - 2 * noise - 8)
    sent = docs.sparkSession.sparkContext.broadcast((classes, level))

    def rows(batches):
        classes, level = sent.value
        for batch in batches:
            n, node, need, short, prefix = [], [], [], [], []
            for found in _sets(batch.column(1), size):
                total = len(found)
                n.append(total)
                if not total:
                    node.append(None), need.append(0), short.append(0), prefix.append([])
                    continue
                node.append(_node(found))
                rank = classes[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(rank, kind="stable")  # ties by hash, as found is sorted
                base = total - -(-percent * total // 100)
                most = max(1, min(max_need, total - base))
                ahead = np.cumsum(level[rank[order[: base + most]]])
                tries = np.arange(1, most + 1)
                cost = ahead[base + tries - 1] * (1 + verify_cost / tries)
                best = int(np.argmin(cost)) + 1
                need.append(best)
                # With a partner at least as large, 2 * percent / (100 + percent) of it must be shared.
                short.append(total - -(-2 * percent * total // (100 + percent)) + best)
                prefix.append(found[order[: base + best]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(need, pa.int32()),
                 pa.array(short, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "n", "node", "need", "short", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id long, n int, node long, need int, short int, prefix array<long>")


def _wanted_sets(docs: DataFrame, known: DataFrame, pairs: DataFrame, size: int, small: int) -> DataFrame:
    """(doc, shingles) of the sets in ``pairs``, hashed from their texts anew."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    ids = store(known.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "ids")
    if ids.count() <= small:  # 8 bytes each: else the texts are shuffled to them
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")

    def sets(batches):
        for batch in batches:
            found = [x for x in _sets(batch.column(1), size) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(x) for x in found], pa.int64()),
                 pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["doc", "shingles"])

    return store(texts.mapInArrow(sets, "doc long, shingles array<long>"), "sets")


def _posts(reps: DataFrame, max_bits: int) -> DataFrame:
    """(doc, n, need, short, pos, before, token): prefixes, for tokens of two sets
    or more; ``before`` counts those in front."""
    tokens = reps.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    shared = store(tokens.where("c > 1").select("token"), "shared")
    sieve = membership(shared, shared.count(), max_bits)
    columns = ["doc", "n", "need", "short"]
    if sieve is None:
        own = reps.select(*columns, F.posexplode("prefix").alias("pos", "token")).join(shared, "token")
        front = Window.partitionBy("doc").orderBy("pos")  # as long as the prefix
        return store(own.withColumn("before", F.row_number().over(front) - 1), "posts")
    sent = reps.sparkSession.sparkContext.broadcast(sieve)

    def rows(batches):
        sieve = sent.value
        for batch in batches:
            prefix = batch.column(4)
            sizes = np.diff(prefix.offsets.to_numpy())
            tokens = prefix.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = may_contain(tokens, sieve) if len(tokens) else np.zeros(0, bool)
            row = row[keep]
            before = np.arange(len(row)) - np.searchsorted(row, row)
            which = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(which) for i in range(4)), pa.array(pos[keep].astype(np.int32)),
                 pa.array(before.astype(np.int32)), pa.array(tokens[keep])],
                [*columns, "pos", "before", "token"])

    return store(reps.select(*columns, "prefix").mapInArrow(
        rows, "doc long, n int, need int, short int, pos int, before int, token long"), "posts")


def _verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, size: int, percent: int, small: int) -> DataFrame:
    """The pairs (x, y) that link, on whole sets, as (a, b)."""
    pairs = store(pairs, "pairs")
    sets = _wanted_sets(docs, known, pairs, size, small)
    left = sets.select(F.col("doc").alias("x"), F.col("shingles").alias("xs"))
    right = sets.select(F.col("doc").alias("y"), F.col("shingles").alias("ys"))
    full = pairs.join(left, "x").join(right, "y").withColumn("both", F.size(F.array_intersect("xs", "ys")))
    linked = full.where(100 * F.col("both") >= percent * (F.size("xs") + F.size("ys") - F.col("both")))
    return store(linked.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")


_SIDES = ["doc", "n", "need", "short", "pos", "before"]


def _candidates(met: DataFrame, percent: int, counted: bool = True) -> DataFrame:
    """(x, y) of the joined rows a_*, b_* that the bounds and counts let pass."""
    first = "(a_n < b_n or (a_n = b_n and a_doc < b_doc))"
    for c in _SIDES:
        met = met.withColumns({f"x_{c}": F.expr(f"if({first}, a_{c}, b_{c})"), f"y_{c}": F.expr(f"if({first}, b_{c}, a_{c})")})
    needed = f"ceil({percent} * (x_n + y_n) / {100 + percent}.0D - 1e-9)"
    met = met.where(
        f"x_pos < x_short and 100 * x_n >= {percent} * y_n"
        # Common shingles in front are among those that any two sets share.
        f" and least(x_before, y_before) + 1 + least(x_n - x_pos - 1, y_n - y_pos - 1) >= {needed}")
    pairs = met.groupBy(F.col("x_doc").alias("x"), F.col("y_doc").alias("y")).agg(
        F.count("*").alias("met"), F.first(F.least("x_need", "y_need")).alias("need"))
    return (pairs.where("met >= need") if counted else pairs).select("x", "y")


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select("token", *more, *[F.col(c).alias(f"{name}_{c}") for c in [*_SIDES, "comp"]])


def _to_pivots(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs of each row with one pivot of its token, of another component: the
    set with the least in front of the token, which edits have changed least."""
    order = ["pos", "n", "doc"]
    pivots = posts.groupBy("token").agg(
        F.min(F.struct(*order, *[c for c in [*_SIDES, "comp"] if c not in order])).alias("p"),
        F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    met = _side(posts, "a").join(pivots, "token").where("a_comp != p.comp")
    sides = [*[f"a_{c}" for c in _SIDES], *[F.col(f"p.{c}").alias(f"b_{c}") for c in _SIDES]]
    # A pair meets here for some of its tokens only, so they are not counted.
    return _candidates(met.select(*sides), percent, counted=False)


def _across(posts: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs of documents of different components."""
    spread = posts.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    live = posts.join(spread.select("token", "main"), "token")
    # A pair of two minor rows meets twice, one with the main component once.
    met = _side(live.where("comp != main"), "a").join(_side(live, "b", "main"), "token").where(
        "a_comp != b_comp and (b_comp = main or a_doc < b_doc)")
    return _candidates(met, percent)


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, max_need: int = 4, verify_cost: float = 8.0,
    star_rounds: int = 1, small: int = 2_000_000, max_bits: int = 1 << 29,
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    ``max_need`` bounds the prefix extension, ``verify_cost`` is the price of a
    candidate against that of a joined row, ``star_rounds`` the rounds of pivots,
    ``small`` the ids that are broadcast at most (16 bytes each) and ``max_bits``
    the size of the filter of shared tokens; beyond either they are joined.
    """
    rows = store(_document_rows(docs, size, percent, max_need, verify_cost), "prefixes")
    known = rows.where("n > 0 and doc_id is not null")
    # Rows of equal sets are one node; its prefix depends on the set alone.
    first = known.groupBy("node").agg(F.min("doc_id").alias("_rep"), F.count("*").alias("_c")).where("_c > 1")
    copies = store(known.select("doc_id", "node").join(first, "node").where("doc_id > _rep").select("doc_id", "node").distinct(), "copies")
    gone = F.broadcast(copies) if copies.count() <= small else copies
    reps = known.join(gone, ["doc_id", "node"], "left_anti").withColumnRenamed("node", "doc")
    posts = _posts(reps, max_bits)

    links, labels = None, posts.select("doc").distinct().withColumn("comp", F.col("doc"))
    for _ in range(star_rounds):
        found = _verified(_to_pivots(posts.join(labels, "doc"), percent), docs, known, size, percent, small)
        links = found if links is None else links.union(found)
        reached = components(links).select(F.col("id").alias("doc"), "component")
        labels = store(posts.select("doc").distinct().join(reached, "doc", "left").select(
            "doc", F.coalesce("component", "doc").alias("comp")), "labels")
    found = _verified(_across(posts.join(labels, "doc"), percent), docs, known, size, percent, small)
    links = found if links is None else links.union(found)

    reached = known.select("doc_id", "node").join(
        components(links).select(F.col("id").alias("node"), "component"), "node", "left")
    reached = reached.withColumn("component", F.coalesce("component", "node"))
    named = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    nodes = reached.select("node", "component").distinct().join(named, "component").select("node", "component_id")
    return rows.join(nodes, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
