"""Text lines to canonical log rows, with a reason for every refused line."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vigilog import schema
from vigilog.functions import fields


def parse_json_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Decode one JSON object per line, once, into typed columns.

    ``lines`` has the text column and optionally ``source_file``. Every line
    comes out; ``reject_reason`` is null for the usable ones, else ``empty``,
    ``malformed``, ``not_object``, ``missing_field``, ``no_metadata`` or
    ``bad_type``.
    """
    if "source_file" not in lines.columns:
        lines = lines.withColumn("source_file", F.lit(None).cast("string"))
    event_type = ", ".join(f"{n}: string" for n in schema.TEXT_FIELDS)
    meta_type = ", ".join(f"{n}: {kind}" for n, kind in schema.METADATA_FIELDS.items())
    text, event = F.col(value), F.col("_v")
    decoded = lines.select(
        text.alias("_raw"),
        F.col("source_file").alias("ingestion_source_file"),
        # Inside a list with an end mark, text after the object is an error;
        # by itself the decoder would not look at it.
        fields.once(F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]")))).alias("_v"),
    ).select(
        "*",
        # A struct reads all its fields in one walk; a field that does not
        # convert is null by itself.
        fields.once(F.struct(
            F.try_variant_get(event, "$[0]", f"struct<{event_type}>").alias("event"),
            F.try_variant_get(event, "$[0].metadata", f"struct<{meta_type}>").alias("meta"),
        )).alias("_t"),
    )
    return decoded.select(
        *[F.col(f"_t.event.{n}").alias(n) for n in schema.TEXT_FIELDS if n != "timestamp"],
        F.col("_t.event.timestamp").alias("timestamp_text"),
        fields.utc_timestamp(F.col("_t.event.timestamp")).alias("timestamp"),
        *[F.col(f"_t.meta.{n}").alias(n) for n in schema.METADATA_FIELDS],
        F.try_variant_get(event, "$[0].metadata", "variant").alias("metadata"),
        F.current_timestamp().alias("ingested_at"),
        "ingestion_source_file",
        "_raw",
        _reject_reason().alias("reject_reason"),
    )


def _reject_reason() -> Column:
    """Null for a good line. Presence of a key only needs a second look when
    its value is null, and only an object has typed fields at all."""
    event = F.col("_v")
    absent = reduce(
        lambda a, b: a | b,
        [F.col(f"_t.event.{n}").isNull() & ~fields.has_key(event, f"$[0].{n}")
         for n in schema.REQUIRED_FIELDS],
    )
    ended = F.try_variant_get(event, "$[1]", "string") == "0"
    http = F.col("_t.event.event_type") == "http.request"
    latency_text = F.try_variant_get(event, "$[0].metadata.latency_ms", "string")
    return (
        F.when(event.isNull() | ~F.coalesce(ended, F.lit(False)),
               F.when(F.col("_raw").rlike(r"^\s*$"), "empty").otherwise("malformed"))
        .when(F.col("_t.event").isNull(), "not_object")
        .when(absent, "missing_field")
        .when(F.col("_t.meta").isNull(), "no_metadata")
        .when(http & fields.not_a_number(event, "$[0].metadata.status"), "bad_type")
        .when(fields.not_a_number(event, "$[0].metadata.latency_ms")
              & F.coalesce(latency_text != "", F.lit(True)), "bad_type")
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject_reason is null").drop("reject_reason", "_raw")


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject_reason is not null").select(
        F.col("_raw").alias("value"),
        F.col("ingestion_source_file").alias("source_file"),
        F.col("reject_reason").alias("reason"),
    )


def enforce_contract(logs: DataFrame) -> DataFrame:
    """Strict typing: rows whose time or level breaks the contract get a reason.

    Optional: the plain chain keeps such rows.
    """
    return logs.withColumn(
        "reject_reason",
        F.when(F.col("timestamp").isNull(), "bad_timestamp").when(
            ~F.col("log_level").isin(schema.LOG_LEVELS), "bad_level"
        ),
    )


@dataclass(frozen=True)
class LinePattern:
    """One free-text format: a regular expression and its groups by column."""

    name: str
    regex: str
    groups: dict[str, int]
    constants: dict[str, str]


# "2024-01-01T00:00:00.000Z ERROR api-gateway [http.request] text key=value ..."
SERVICE_LINE = LinePattern(
    "service_line",
    r"^(\d{4}-\d\d-\d\dT\S+)\s+([A-Z]+)\s+(\S+)\s+\[([^\]]+)\]\s+(.*)$",
    {"timestamp": 1, "log_level": 2, "service_name": 3, "event_type": 4, "message": 5},
    {},
)

# '10.0.0.1 - - [2024-01-01T00:00:00.000Z] "GET /path" 500 123.4'
ACCESS_LINE = LinePattern(
    "access_line",
    r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+ (\S+)[^"]*)" (\d{3}) ([\d.]+)$',
    {"client_ip": 1, "timestamp": 2, "message": 3, "path": 4, "status": 5, "latency_ms": 6},
    {"service_name": "api-gateway", "event_type": "http.request"},
)


def parse_text_lines(
    lines: DataFrame,
    patterns: tuple[LinePattern, ...] = (SERVICE_LINE, ACCESS_LINE),
    value: str = "value",
) -> DataFrame:
    """Free-text lines to the same columns: the first matching format wins.

    ``pattern`` names it and is null for a line no format matches. Fields a
    format does not name are looked up as ``key=value`` in the text.
    """
    # One text per line, "name SEP group 1 SEP group 2 ...", and one list of
    # its key=value pairs: each pattern runs once per line.
    text, sep = F.col(value), "\u0001"

    def taken(p: LinePattern) -> Column:
        groups = sep.join(f"${i + 1}" for i in range(max(p.groups.values())))
        return F.concat(F.lit(p.name + sep), F.regexp_replace(text, p.regex, groups))

    chosen = reduce(
        lambda c, p: c.when(text.rlike(p.regex), taken(p)),
        patterns[1:],
        F.when(text.rlike(patterns[0].regex), taken(patterns[0])),
    )
    matched = lines.select(
        text.alias("value"), fields.once(F.struct(
            F.split(chosen, sep).alias("parts"),
            F.regexp_extract_all(text, F.lit(r"\b(\w+=\S+)"), F.lit(1)).alias("pairs"),
        )).alias("m"),
    ).select("value", F.col("m.parts")[0].alias("pattern"), "m.parts", "m.pairs")

    def column(name: str) -> Column:
        start = f"{name}="
        pair = F.get(F.filter("pairs", lambda p: p.startswith(start)), F.lit(0))
        found = F.lit(None).cast("string")
        for p in reversed(patterns):
            if name in p.groups:
                part = F.get("parts", F.lit(p.groups[name]))
            elif name in p.constants:
                part = F.lit(p.constants[name])
            else:
                part = F.substring(pair, len(start) + 1, 1 << 30)
            found = F.when(F.col("pattern") == p.name, part).otherwise(found)
        return F.when(found != "", found)

    return typed_fields(matched.select(
        "value", "pattern", *[column(n).alias(n) for n in (*schema.TEXT_FIELDS, *schema.METADATA_FIELDS)]))


def typed_fields(found: DataFrame) -> DataFrame:
    """Lines with the texts of their fields to log rows: typed, with a level and an id."""
    out = found.select(
        "value", "pattern", *schema.TEXT_FIELDS,
        *[F.col(n).try_cast(kind).alias(n) for n, kind in schema.METADATA_FIELDS.items()])
    level = (
        F.when(F.col("log_level").isNotNull(), F.col("log_level"))
        .when(F.col("pattern").isNull(), F.lit(None))
        .when(F.col("status") >= 500, "ERROR")
        .otherwise("INFO")
    )
    return (
        out.withColumn("timestamp", fields.utc_timestamp(F.col("timestamp")))
        .withColumn("log_level", level)
        .withColumn("event_id", F.coalesce("event_id", F.md5("value")))
    )
