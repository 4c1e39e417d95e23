"""Field access, time and id expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def once(value: Column) -> Column:
    """``value`` as a generated column.

    The optimizer copies a plain expression into every filter above it, where
    costly ones (decoding JSON) would run again for each mention. It does not
    copy generated columns, and still pushes down filters on other columns.
    """
    return F.explode(F.array(value))


def has_key(variant: Column, path: str) -> Column:
    """True when the key is there, also with a JSON null as its value."""
    return F.try_variant_get(variant, path, "variant").isNotNull()


def get_or(variant: Column, path: str, kind: str, default) -> Column:
    """Value at ``path``, or ``default`` when it is absent or null."""
    return F.coalesce(F.try_variant_get(variant, path, kind), F.lit(default))


def not_a_number(variant: Column, path: str) -> Column:
    """True for text, a list or an object at ``path``; null when it is absent."""
    shape = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return F.substring(shape, 1, 3).isin("STR", "OBJ", "ARR")


def utc_timestamp(text: Column) -> Column:
    """ISO-8601 text to a timestamp; text without a zone is UTC."""
    zoned = F.when(text.rlike(r"T.*(Z|[+-]\d\d:?\d\d)$"), text).otherwise(
        F.concat(text, F.lit("Z"))
    )
    return zoned.try_cast("timestamp")


def iso_millis(ts: Column) -> Column:
    """UTC text with milliseconds, whatever the session's zone."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def floor_to(us: Column, size_us: int) -> Column:
    """Start of the slot of ``size_us`` microseconds that holds ``us``."""
    return us - F.pmod(us, F.lit(size_us).cast("bigint"))


def joined(*parts: Column) -> Column:
    r"""The parts as one text that no other parts give: ``|`` between them, a
    backslash before ``|`` and backslashes within them, ``\0`` for null."""
    escaped = []
    for part in parts:
        text = F.replace(part.cast("string"), F.lit("\\"), F.lit("\\\\"))
        text = F.replace(text, F.lit("|"), F.lit("\\|"))
        escaped.append(F.coalesce(text, F.lit("\\0")))
    return F.concat_ws("|", *escaped)


def digest(*parts: Column) -> Column:
    """A repeatable id: the same input row always gets the same one, and rows of
    different parts get different ones."""
    return F.md5(joined(*parts))


def signal_id(signal_type: Column, event_id: Column) -> Column:
    return digest(signal_type, event_id)


def incident_id(signal: Column) -> Column:
    return digest(F.lit("inc"), signal)


def number_text(value: Column) -> Column:
    """A number as JSON would show it: whole numbers without a fraction."""
    whole = value.try_cast("bigint")  # null beyond its range
    return F.when(value == whole, whole.cast("string")).otherwise(value.cast("string"))


def text_map(**entries: Column) -> Column:
    parts = []
    for key, value in entries.items():
        parts += [F.lit(key), value.cast("string")]
    return F.create_map(*parts)
