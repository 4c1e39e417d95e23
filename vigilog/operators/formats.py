"""Free-text formats from a table, many of them at once.

A table of formats has ``name``, ``priority`` (the lowest that matches wins, ties by
name), ``regex``, ``groups`` (column to group number) and ``constants`` (column to text).
Expressions are those of Python's ``re`` with ASCII classes.

Trying every expression on every line costs lines times formats. Each expression has
texts that any match must contain, which follow from its syntax. An Aho-Corasick
automaton over these finds all of them in one walk along the line, and only formats
whose texts are there are tried, in order of priority. A format without such a text is
always tried. So the result is that of trying all of them.

The table is configuration: it is read to the driver in blocks of ``block`` formats and
sent with the tasks, a block at a time; the lines no format of a block matched go to the
next block, in the same task. Lines are never shuffled.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vigilog import schema
from vigilog.operators import parse

with warnings.catch_warnings():
    warnings.simplefilter("ignore", DeprecationWarning)
    from re import _constants as _re, _parser

FORMAT_DDL = "name string, priority int, regex string, groups map<string,int>, constants map<string,string>"
COLUMNS = (*schema.TEXT_FIELDS, *schema.METADATA_FIELDS)
_PAIR = re.compile(r"\b(\w+)=(\S+)", re.ASCII)


def required_texts(regex: str) -> list[str]:
    """Texts that every match of the expression contains; may be none."""
    tree = _parser.parse(regex, re.ASCII)
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        return []
    runs: list[list[str]] = [[]]

    def walk(items) -> None:
        for kind, value in items:
            if kind is _re.LITERAL:
                runs[-1].append(chr(value))
            elif kind is _re.SUBPATTERN and not value[1] & re.IGNORECASE:
                walk(value[3])
            elif kind is _re.ATOMIC_GROUP:
                walk(value)
            elif kind in (_re.MAX_REPEAT, _re.MIN_REPEAT, _re.POSSESSIVE_REPEAT):
                least, _, inner = value
                if least:
                    # Its first turn follows what is before it; its last ends what is after.
                    walk(inner)
                runs.append([])
            elif kind is not _re.AT and not (kind is _re.ASSERT or kind is _re.ASSERT_NOT):
                runs.append([])

    walk(tree)
    return sorted({"".join(r) for r in runs if r}, key=lambda t: (-len(t), t))


class Formats:
    """Compiled formats; ``first`` finds the one that a line is in."""

    def __init__(self, rows: list[tuple]):
        # (name, priority, regex, pairs of groups, pairs of constants)
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        self.formats = [(name, re.compile(regex, re.ASCII), groups, constants) for name, _, regex, groups, constants in rows]
        needed = [required_texts(r[2]) for r in rows]
        shared = Counter(t for texts in needed for t in texts)
        self.always = [i for i, texts in enumerate(needed) if not texts]
        self.rest: list[frozenset[str]] = [frozenset()] * len(rows)
        keys: dict[str, list[int]] = {}
        for i, texts in enumerate(needed):
            if texts:
                # Looked up by the text that the fewest formats need.
                key = min(texts, key=lambda t: (shared[t], -len(t), t))
                keys.setdefault(key, []).append(i)
                self.rest[i] = frozenset(t for t in texts if t != key and len(t) > 1)
        self.automaton = ahocorasick.Automaton()
        for text in {*keys, *(t for rest in self.rest for t in rest)}:
            self.automaton.add_word(text, (text, keys.get(text, [])))
        if len(self.automaton):
            self.automaton.make_automaton()

    def candidates(self, line: str) -> list[int]:
        """The formats whose texts are all in the line, by priority."""
        found = dict(hit for _, hit in self.automaton.iter(line)) if len(self.automaton) else {}
        out = [i for at in found.values() for i in at if self.rest[i] <= found.keys()]
        return sorted(out + self.always)

    def first(self, line: str) -> tuple | None:
        for i in self.candidates(line):
            name, expression, groups, constants = self.formats[i]
            match = expression.search(line)
            if match:
                return name, match, groups, constants
        return None


def problems(rows: list[tuple]) -> dict[int, str]:
    """What is wrong with rows of a format table, by their place in the list."""
    out, names = {}, Counter(r[0] for r in rows)
    for i, (name, priority, regex, groups, constants) in enumerate(rows):
        if name is None or priority is None or regex is None:
            out[i] = "name, priority or regex missing"
        elif names[name] > 1:
            out[i] = "name used twice"
        else:
            try:
                n = re.compile(regex, re.ASCII).groups
            except (re.error, ValueError, OverflowError, RecursionError) as error:
                out[i] = f"regex: {error}"
                continue
            unknown = sorted({c for c, _ in (*groups, *constants)} - {*COLUMNS})
            if unknown:
                out[i] = f"unknown column {unknown[0]}"
            elif any(g is None or not 0 <= g <= n for _, g in groups):
                out[i] = "no such group"
    return out


def _rows(formats: DataFrame) -> list[tuple]:
    chosen = formats.select("name", "priority", "regex", "groups", "constants")
    return [(r.name, r.priority, r.regex, tuple(sorted((r.groups or {}).items())), tuple(sorted((r.constants or {}).items())))
            for r in chosen.toLocalIterator()]


def rejected_formats(formats: DataFrame) -> list[tuple[str, str]]:
    """Name and problem of the formats that cannot be used."""
    rows = _rows(formats)
    return [(rows[i][0], problem) for i, problem in problems(rows).items()]


def read_formats(formats: DataFrame, block: int = 5_000) -> list[tuple]:
    """The table on the driver, in blocks by priority. One that cannot be used is an
    error that names it."""
    rows = _rows(formats)
    wrong = problems(rows)
    if wrong:
        raise ValueError("invalid formats: " + ", ".join(f"{rows[i][0]}: {p}" for i, p in list(wrong.items())[:5]))
    rows.sort(key=lambda r: (r[1], r[0]))
    return [tuple(rows[i:i + block]) for i in range(0, len(rows), block)]


@lru_cache(maxsize=8)
def _compiled(block: tuple) -> Formats:
    """Once for each Python worker, not for each task."""
    return Formats(list(block))


_NAMES = frozenset(("pattern", *COLUMNS))
_FOUND = StructType([StructField(n, StringType()) for n in ("value", "pattern", *COLUMNS)])
_ARROW = pa.schema([(n, pa.string()) for n in _FOUND.names])


def _taken(line: str, found: tuple) -> dict[str, str | None]:
    """The columns of a line in a format; what the format does not name is looked
    up as ``key=value``, the first of a key counts, and empty texts as none."""
    name, match, groups, constants = found
    out: dict[str, str | None] = {}
    if "=" in line:
        for key, value in _PAIR.findall(line):
            out.setdefault(key, value)
    out.update(constants)
    for column, group in groups:
        out[column] = match.group(group)
    out["pattern"] = name
    return out


def _matcher(block: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = _compiled(block)
        for batch in batches:
            lines, patterns = batch.column("value").to_pylist(), batch.column("pattern").to_pylist()
            # Only columns that a line has a text for are unpacked.
            columns = {"pattern": patterns}
            for i, (line, known) in enumerate(zip(lines, patterns)):
                found = formats.first(line) if line is not None and known is None else None
                if found:
                    for column, text in _taken(line, found).items():
                        if text and column in _NAMES:
                            if column not in columns:
                                columns[column] = batch.column(column).to_pylist()
                            columns[column][i] = text
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[n], pa.string()) if n in columns else batch.column(n) for n in _FOUND.names],
                schema=_ARROW)

    return run


def parse_by_formats(lines: DataFrame, formats: DataFrame, value: str = "value", block: int = 5_000) -> DataFrame:
    """As ``parse.parse_text_lines``, with the formats of a table; batch or stream.

    ``pattern`` is null for a line that is null or in no format, and so are its fields.
    """
    none = F.lit(None).cast("string")
    out = lines.select(F.col(value).alias("value"), *[none.alias(n) for n in _FOUND.names[1:]])
    for rows in read_formats(formats, block):
        out = out.mapInArrow(_matcher(rows), _FOUND)
    return parse.typed_fields(out)
