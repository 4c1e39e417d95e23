"""Many free-text formats from a table."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from vigilog.operators import formats, parse


def row(name, priority, regex, groups=None, constants=None):
    return (name, priority, regex, groups, constants)


def compiled(rows):
    return formats.Formats([(n, p, x, tuple((g or {}).items()), tuple((c or {}).items())) for n, p, x, g, c in rows])


@pytest.mark.parametrize("regex, texts", [
    (r"^abc$", ["abc"]),
    (r"ab(c|d)ef", ["ab", "ef"]),
    (r"ab(?:cd)+ef", ["abcd", "ef"]),
    (r"ab(?:cd)*ef", ["ab", "ef"]),
    (r"ab(?:cd)?ef", ["ab", "ef"]),
    (r"\[http\.(\w+)\] x", ["[http.", "] x"]),
    (r"a(?=zz)b", ["ab"]),
    (r"(?!zz)a", ["a"]),
    (r"(?i)abc", []),
    (r"(?i:abc)de", ["de"]),
    (r"foo|bar", []),
    (r"(foo|fob)", ["fo"]),
    (r"(a)(b)\1c", ["ab", "c"]),
    (r"\d+|x*", []),
    (r"[.]x{2,}y", [".x", "y"]),
    (r"(?>ab)c", ["abc"]),
    (r"", []),
])
def test_required_texts(regex, texts):
    assert sorted(formats.required_texts(regex)) == sorted(texts)


_PIECES = st.sampled_from(
    ["a", "b", "ab", "(?:a|b)", "a+", "(?:ab)+", "b*", "(?:ba)?", ".", r"\d", "1", "[ab]", "(?=a)", "(?:a(?:b|1)){2}", "^", "$",
     "(?i:A)", "ab{2}", r"\b"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(_PIECES, min_size=1, max_size=5).map("".join), min_size=1, max_size=8),
       st.lists(st.text("ab1 A\n", max_size=12), max_size=8))
def test_the_index_loses_no_match(regexes, lines):
    table = compiled([row(f"f{i}", i % 3, x) for i, x in enumerate(regexes)])
    for line in lines:
        want = next((n for _, n, x in sorted((i % 3, f"f{i}", x) for i, x in enumerate(regexes)) if re.search(x, line, re.ASCII)),
                    None)
        found = table.first(line)
        assert (found[0] if found else None) == want


def test_few_expressions_run_however_many_there_are():
    rng = random.Random(1)
    some = [row(f"f{i}", 1, rf"^(\S+) \[svc{i}\.(?:start|stop)\] unit-{i}: (.*)$") for i in range(5)]
    many = [row(f"f{i}", 1, rf"^(\S+) \[svc{i}\.(?:start|stop)\] unit-{i}: (.*)$") for i in range(2000)]
    lines = [f"t [svc{i}.start] unit-{i}: x" for i in (rng.randrange(2000) for _ in range(500))]
    tried = [len(compiled(many).candidates(x)) for x in lines[:20]]
    # Where one number begins with another, both are candidates.
    assert max(tried) <= 4
    assert max(len(compiled(some).candidates(x)) for x in lines) <= 1
    table = compiled(many)
    assert all(table.first(x)[0] == "f" + x.split("unit-")[1].split(":")[0] for x in lines)


def parsed(spark, lines, rows, **more):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return formats.parse_by_formats(df, spark.createDataFrame(rows, formats.FORMAT_DDL), **more)


def test_same_as_the_built_in_formats(spark):
    lines = [
        "2026-03-01T10:00:00.000Z ERROR billing [db.query] took long latency_ms=12.5 host=n1 host=n2",
        '10.9.8.7 - - [2026-03-01T10:00:01.000Z] "GET /a/b?x=1" 503 17.25',
        '10.9.8.7 - - [2026-03-01T10:00:01.000Z] "GET /a" 204 nothing', "", None, "no format status=500",
    ]
    built_in = (parse.SERVICE_LINE, parse.ACCESS_LINE)
    rows = [row(p.name, i, p.regex, p.groups, p.constants) for i, p in enumerate(built_in)]
    got = parsed(spark, lines, rows)
    want = parse.parse_text_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert got.columns == want.columns
    # The fields of a line in no format are null in both.
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_priority_then_name_also_over_blocks(spark):
    rows = [row("general", 9, r"^(.*)$", {"message": 1}), row("b", 1, r"^x (\w+)", {"host": 1}, {"event_type": "t"}),
            row("a", 1, r"^x (\w+) y", {"host": 1}), row("maybe", 2, r"^z(\d)?", {"status": 1})]
    lines = ["x 1 y", "x 1", "else", "z", "z5", ""]
    want = [("", "general"), ("else", "general"), ("x 1", "b"), ("x 1 y", "a"), ("z", "maybe"), ("z5", "maybe")]
    for block in (1, 2, 100):
        got = parsed(spark, lines, rows, block=block).collect()
        assert sorted((r.value, r.pattern) for r in got) == want
        by = {r.value: r for r in got}
        assert by["z"].status is None and by["z5"].status == 5.0 and by["x 1"].event_type == "t"
        assert by[""].message is None and by["else"].message == "else"


def test_very_long_line_and_repeated_rows(spark):
    long = "x" * 2_000_000 + " end=1"
    got = parsed(spark, [long, long], [row("long", 1, r"x end=(\d)$", {"status": 1})]).collect()
    assert [(r.pattern, r.status) for r in got] == [("long", 1.0)] * 2


def test_no_formats_and_no_lines(spark):
    assert [r.pattern for r in parsed(spark, ["a"], []).collect()] == [None]
    assert parsed(spark, [], [row("a", 1, "a")]).count() == 0


def test_unusable_formats_are_told(spark):
    rows = [row("a", 1, "(x"), row("b", 1, "x", {"host": 1}), row("c", 1, "(x)", {"nowhere": 1}), row("d", None, "x"),
            row("e", 1, "x"), row("e", 2, "y"), row("f", 1, "(?u)x"), row("fine", 1, "(x)", {"host": 1}, {"reason": "r"})]
    table = spark.createDataFrame(rows, formats.FORMAT_DDL)
    wrong = formats.rejected_formats(table)
    assert [n for n, _ in wrong] == ["a", "b", "c", "d", "e", "e", "f"]
    assert dict(wrong)["b"] == "no such group" and dict(wrong)["c"] == "unknown column nowhere"
    with pytest.raises(ValueError, match="invalid formats: a"):
        formats.read_formats(table)


def test_on_a_stream(spark, tmp_path):
    from vigilog.streaming import pipeline

    spark.createDataFrame([("x 1",), ("y",)], "value string").write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([row("x", 1, r"x (\d)", {"status": 1})], formats.FORMAT_DDL)
    pipeline.append(formats.parse_by_formats(lines, table), str(tmp_path), "out").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.value, r.pattern, r.status) for r in got) == [("x 1", "x", 1.0), ("y", None, None)]
