"""Shards that all carry the corpus' mixture: proportional stratified interleaving.

Rows are shuffled within their source by a seeded digest of their id and ranked
there; a row's fractional rank is ``(rank + 0.5) / rows of its source``. In the
order of fractional ranks every stretch has the sources in proportion, so the
order is cut into shards whose row counts differ by one at most (law ``rows``).

Both rankings are range partitioned (see ``common.ranked``): a source of any
size spreads over the tasks. Texts are not moved, only ids and sizes.

Defined results: null text: size 1, digest of the empty text; null source is a
stratum; a null id is ranked as the empty text; repeated rows follow each other
in any order and each gets its own slot; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import ranked, store


def interleave(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard of every row."""
    slim = docs.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_draw"),
    )
    ties = [F.col(c) for c in ("_draw", "doc_id", "size", "text_crc32")]
    within = ranked(store(slim, "rows"), [F.col("source")], ties, "_rank", "_of")
    placed = store(within.withColumn("_share", (F.col("_rank") + 0.5) / F.col("_of")).drop("_rank", "_of"), "shares")
    placed = ranked(placed, [], [F.col("_share"), *ties[:1], F.col("source"), *ties[1:]], "_at", "_all")
    shard = F.expr(f"(_at * {shards}) div _all")
    return placed.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        F.expr(f"_at - (((_at * {shards}) div _all) * _all + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
