"""As-of joins: the last state of another table at or before a row's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.operators.ordered import with_last


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_us: str, right_us: str,
    columns: list[str], strict: bool = False,
) -> DataFrame:
    """``left`` with the ``columns`` of the last row of ``right`` of equal keys at or
    before its time (``strict``: before it); null if there is none.

    Both tables are ranged together by (keys, time), so one key may hold any share
    of either; a range carries on the last state of the one before it. Null keys
    equal each other; rows of one time in ``right`` should be folded before, as
    which of them counts is open. Rows of ``left`` are kept as often as they are
    there, those without a time have no state.
    """
    # At one time a state is in place before what asks for it, unless strict.
    asks, states = (0, 1) if strict else (1, 0)
    own = [c for c in left.columns if c not in keys]
    empty = F.lit(None)
    value = F.struct(*columns)
    kind = right.select(value.alias("v")).schema["v"].dataType
    row = F.struct(*own) if own else F.struct(F.lit(0).alias("_none"))
    row_kind = left.select(row.alias("r")).schema["r"].dataType
    asked = left.select(
        *keys, F.col(left_us).cast("bigint").alias("_us"), F.lit(asks).alias("_side"),
        empty.cast(kind).alias("_state"), row.alias("_row"))
    given = right.filter(F.col(right_us).isNotNull()).select(
        *keys, F.col(right_us).cast("bigint").alias("_us"), F.lit(states).alias("_side"),
        value.alias("_state"), empty.cast(row_kind).alias("_row"))
    joined = with_last(asked.unionByName(given), keys, ["_us", "_side"], "_state", "_last")
    found = joined.filter(F.col("_side") == asks)
    out = found.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in own], *[F.col(f"_last.{c}").alias(c) for c in columns])
    return out.select(*left.columns, *columns)
