"""Shared pieces: stored tables, hashed words of Arrow text, ranks, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from vigilog.session import scratch

#: Bytes of text that are looked at together; a longer text is a chunk of its own.
CHUNK = 1 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared folder and read from there: later
    stages, and tasks that run again after a lost executor, see the same rows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -- text of Arrow batches -----------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _A)


_powers: list[np.ndarray] = []


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        made = []
        for base in (int(_B), pow(int(_B), -1, 1 << 64)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            made.append(np.cumprod(powers, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


def byte_class(keep) -> np.ndarray:
    return np.array([bool(keep(i)) for i in range(256)])


#: Words of everything but ASCII white space.
NOT_SPACE = byte_class(lambda i: not (i == 0x20 or 0x09 <= i <= 0x0D))
#: Words of ASCII letters and digits and of all beyond ASCII.
ALNUM = byte_class(lambda i: 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80)
#: A-Z as a-z, the rest as it is.
LOWER = np.array([i + 32 if 0x41 <= i <= 0x5A else i for i in range(256)], np.uint8)


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of a chunk, and for each row the
    place of its first word (one entry more than rows). ``offsets`` start at 0."""
    folded = LOWER[data]
    inside = is_word[folded]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    powers, inverse = _base_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[folded] * powers[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    hashes += (ends - starts).astype(np.uint64) * _C
    return mix(hashes), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words within a row, and each row's first run."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ words[k : k + n]) * _A
        h ^= h >> np.uint64(29)
    row = np.searchsorted(first, np.arange(len(words)), "right")
    ok = row[:n] == row[size - 1 :]
    runs = np.maximum(np.diff(first) - size + 1, 0)
    return mix(h[ok]), np.concatenate([[0], np.cumsum(runs)])


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


# -- membership filters --------------------------------------------------------

_BLOCK = 1 << 17  # bits of a filter block


def _cells(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The filter block of each key and its four bits there."""
    h = mix(keys.astype(np.uint64) * _A + _B)
    other = mix(h + _C)
    bits = [((other >> np.uint64(s)) & np.uint64(_BLOCK - 1)).astype(np.int64) for s in (0, 15, 30, 45)]
    return (h % np.uint64(blocks)).astype(np.int64), bits


def membership(keys: DataFrame, count: int, max_bits: int) -> np.ndarray | None:
    """A Bloom filter of the one long column of ``keys``, made block by block in
    the tasks; None if 12 bits a key take more than ``max_bits``."""
    blocks = max(1, -(-count * 12 // _BLOCK))
    if blocks * _BLOCK > max_bits:
        return None

    def block_of(batches):
        for batch in batches:
            gram = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_cells(gram, blocks)[0].astype(np.int32)), batch.column(0)], ["block", "item"])

    def build(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bits = _cells(batch.column(1).to_numpy(), blocks)
            for b in np.unique(block):
                own = made.setdefault(int(b), np.zeros(_BLOCK, bool))
                for bit in bits:
                    own[bit[block == b]] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(made), pa.int32()), pa.array([np.packbits(x).tobytes() for x in made.values()], pa.binary())], ["block", "bits"])

    rows = keys.mapInArrow(block_of, "block int, item long").repartition("block").mapInArrow(build, "block int, bits binary")
    out = np.zeros((blocks, _BLOCK // 8), np.uint8)
    for block, bits in rows.collect():  # max_bits / 8 bytes at most
        out[block] = np.frombuffer(bits, np.uint8)
    return out


def may_contain(keys: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    block, bits = _cells(keys, len(sieve))
    out = np.ones(len(keys), bool)
    for bit in bits:
        out &= (sieve[block, bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0
    return out


# -- ranks and components ------------------------------------------------------


def ranked(df: DataFrame, by: list[Column], order: list[Column], rank: str, total: str) -> DataFrame:
    """``df`` with each row's place (from 0) among the rows of its stratum and
    the stratum's size.

    Range-partitioned by stratum and order, so a stratum that holds a third of
    all rows spreads over tasks. What is joined back is one row per stratum and
    task that it reaches. ``df`` should be a stored table (it is sampled).
    """
    keys = [f"_k{i}" for i in range(len(by))]
    keyed = df.withColumns({k: F.coalesce(c.cast("string"), F.lit("\x00null")) for k, c in zip(keys, by)})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    ordered = store(ordered.withColumn("_seq", F.monotonically_increasing_id()), "ranked")
    ordered = ordered.withColumn("_task", F.shiftright("_seq", 33))
    runs = ordered.groupBy("_task", *keys).agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    stratum = Window.partitionBy(*keys)
    runs = runs.select(
        "_task", *keys, "_first",
        (F.sum("_n").over(stratum.orderBy("_task")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(stratum).alias(total),
    )
    return (
        ordered.join(runs, ["_task", *keys])
        .withColumn(rank, F.col("_before") + F.col("_seq") - F.col("_first"))
        .drop("_task", "_seq", "_first", "_before", *keys)
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for the nodes of ``edges`` (a, b): the smallest node that
    each reaches. Alternates large-star and small-star steps; a hub's edges are
    never gathered, only its smallest neighbour is, by a pre-aggregated minimum.
    """
    edges = store(edges.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds if edges.take(1) else 0):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = store(small.where("a != b").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        if seen is not None:
            raise RuntimeError("components have not settled")
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
