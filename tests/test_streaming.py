import json
import os
import random

import pytest
from pyspark.sql import functions as F

from vigilog.operators import rules
from vigilog.sources import tables
from vigilog.sources.log_tail import LogTailReader, last_line_end
from vigilog.streaming import incremental, pipeline, stateful
from helpers import LOG_DDL, at


def spread(make_logs, path, rows, files, lateness_s, rng):
    """Rows as ``files`` Parquet files in time order, shuffled within lateness."""
    late = sorted(rows, key=lambda r: r["timestamp"].timestamp() + rng.random() * lateness_s)
    size = -(-len(late) // files)
    for i in range(files):
        part = make_logs(late[i * size:(i + 1) * size])
        part.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, one_by_one=True):
    reader = spark.readStream.schema(LOG_DDL)
    if one_by_one:
        reader = reader.option("maxFilesPerTrigger", 1)
    return reader.parquet(path)


def logins(rng, n, span):
    times = [rng.random() * span for _ in range(n)]
    return [
        {"event_id": f"l{i:04d}", "event_type": "auth.login_failed", "service_name": "auth-service",
         "client_ip": rng.choice(["1.1.1.1"] * 4 + ["2.2.2.2", "3.3.3.3"]),
         "status": None, "timestamp": at(t)}
        for i, t in enumerate(times)
    ]


def errors(rng, n, span):
    return [{**row, "event_type": "http.request", "status": 500.0} for row in logins(rng, n, span)]


# An event long after all others moves the watermark past them.
END = {"event_id": "zz", "timestamp": at(999_999), "client_ip": "9.9.9.9", "status": 500.0}


def ids(df):
    return sorted(r.signal_id for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_keyed_state_equals_batch(spark, make_logs, tmp_path, seed):
    rng = random.Random(seed)
    rows = logins(rng, 150, 900) + [{**END, "event_type": "auth.login_failed"}]
    spread(make_logs, str(tmp_path / "in"), rows, 4, 50, rng)
    rule = rules.brute_force_rule(4, 60)
    found = stateful.window_signals(stream(spark, str(tmp_path / "in")), rule, "60 seconds")
    root = str(tmp_path / "out")
    pipeline.append(found, root, "signals").awaitTermination()
    got = spark.read.parquet(f"{root}/signals")
    want = rules.window_signals(make_logs(rows), rule)
    assert ids(got) == ids(want) and got.count() > 3
    assert {r.metadata["ip"] for r in got.collect()} <= {"1.1.1.1", "2.2.2.2", "3.3.3.3"}


def test_end_mark_gives_out_what_is_in_state(spark, make_logs, tmp_path):
    rng = random.Random(5)
    rows = logins(rng, 120, 900)
    path, marks, root = (str(tmp_path / x) for x in ("in", "marks", "out"))
    spread(make_logs, path, rows, 3, 0, rng)
    rule = rules.brute_force_rule(4, 60)

    def run():
        logs = pipeline.with_end_marks(stream(spark, path), marks)
        pipeline.append(stateful.window_signals(logs, rule, "10 minutes"), root, "signals").awaitTermination()
        return ids(spark.read.parquet(f"{root}/signals"))

    want = ids(rules.window_signals(make_logs(rows), rule))
    assert len(run()) < len(want)
    pipeline.end_mark(spark, stream(spark, path).schema, marks, event_type=rule.event_type, client_ip="end", timestamp=pipeline.END)
    assert run() == want


def test_detect_counts_rules_without_a_key_in_steps(spark, make_logs, tmp_path):
    rng = random.Random(6)
    rows = errors(rng, 150, 900)
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    spread(make_logs, path, rows, 3, 0, rng)
    rule = rules.error_spike_rule(5, 30)
    for query in pipeline.detect(stream(spark, path), root, "10 minutes", [rule]):
        query.awaitTermination()
    own = f"{root}/windows_{rule.signal_type.lower()}"
    want = ids(rules.window_signals(make_logs(rows), rule))
    early, late = (ids(df) for df in (incremental.read_signals(spark, own), incremental.remaining_signals(spark, own, rule)))
    assert sorted(early + late) == want and late


@pytest.mark.parametrize("seed, key", [(1, ()), (2, ("client_ip",))])
def test_incremental_equals_batch(spark, make_logs, tmp_path, seed, key):
    rng = random.Random(seed)
    rows = errors(rng, 200, 900) + [{**END, "event_type": "http.request"}]
    spread(make_logs, str(tmp_path / "in"), rows, 5, 50, rng)
    rule = rules.error_spike_rule(5, 30, key)
    root = str(tmp_path / "out")
    logs = stream(spark, str(tmp_path / "in"))
    incremental.window_signals(logs, rule, root, 60_000_000).awaitTermination()
    want = rules.window_signals(make_logs(rows), rule)
    assert ids(incremental.read_signals(spark, root)) == ids(want) and want.count() > 3


def test_incremental_goes_on_after_restart(spark, make_logs, tmp_path):
    """Two runs over one checkpoint, with the window open across the stop."""
    rule = rules.error_spike_rule(5, 30)
    path, root = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        incremental.window_signals(stream(spark, path), rule, root, 0).awaitTermination()
        return sorted(r.event_id for r in incremental.read_signals(spark, root).collect())

    def rows(numbers):
        return make_logs([
            {"event_id": f"e{i:02d}", "event_type": "http.request", "status": 500.0,
             "timestamp": at(i)} for i in numbers]).coalesce(1)

    rows(range(3)).write.parquet(path)
    assert run() == []
    rows(range(3, 12)).write.mode("append").parquet(path)
    assert run() == ["e04", "e09"]
    assert run() == ["e04", "e09"]
    # e02 again is behind the horizon: kept apart, not counted.
    rows([2, 12, 13, 14]).write.mode("append").parquet(path)
    assert run() == ["e04", "e09", "e14"]
    late = spark.read.parquet(f"{root}/late")
    assert [r.event_id for r in late.collect()] == ["e02"]


def test_micro_batch_can_be_repeated(spark, make_logs):
    """The same batch over the same open rows gives the same result."""
    rule = rules.error_spike_rule(3, 30)
    rows = rules.rule_matches(make_logs([
        {"event_type": "http.request", "status": 500.0, "timestamp": at(i)} for i in range(7)]), rule)
    one = incremental.step(rows, None, None, rule, 0)
    two = incremental.step(rows, None, None, rule, 0)
    assert [sorted(map(str, d.collect())) for d in one[:3]] == [
        sorted(map(str, d.collect())) for d in two[:3]]
    # Rows after the last firing stay open: one of seven.
    assert one[1].count() == 1 and one[3] == two[3]


def test_stage_tables_survive_restart(spark, tmp_path):
    """Lines in two portions; every line ends in one table exactly once."""
    logs, root = tmp_path / "logs", str(tmp_path / "tables")
    logs.mkdir()

    def write(name, numbers):
        lines = [json.dumps({
            "event_id": f"e{i}", "timestamp": f"2026-03-08T16:10:{i:02d}.000Z",
            "service_name": "db-monitor", "log_level": "INFO", "event_type": "db.query",
            "metadata": {"latency_ms": 3000 + i}}) for i in numbers]
        (logs / name).write_text("\n".join([*lines, "broken {", ""]) + "\n")

    def run():
        pipeline.ingest(tables.stream_log_files(spark, str(logs)), root).awaitTermination()
        for query in pipeline.process_raw(pipeline.follow(spark, root, "raw_logs"), root):
            query.awaitTermination()
        logs_ = pipeline.follow(spark, root, "processed_logs")
        for query in pipeline.detect(logs_, root, "1 minute", windowed=[]):
            query.awaitTermination()
        pipeline.open_incidents(pipeline.follow(spark, root, "signals_events"), root).awaitTermination()
        pipeline.plan_responses(
            pipeline.follow(spark, root, "incidents"), tables.playbooks(spark), root
        ).awaitTermination()
        return [spark.read.parquet(f"{root}/{t}").count() for t in (
            "raw_logs", "processed_logs", "dead_letters", "signals_events", "incidents", "responses")]

    write("a.log", range(3))
    assert run() == [5, 3, 2, 2, 2, 2]
    write("b.log", range(3, 5))
    assert run() == [9, 5, 4, 4, 4, 4]
    responses = spark.read.parquet(f"{root}/responses")
    assert {r.action for r in responses.collect()} == {"restart_database"}
    assert responses.select("incident_id").distinct().count() == 4


def test_rule_table_on_a_stream(spark, make_logs, tmp_path):
    """The versioned rules join a stream as a static table."""
    from vigilog import schema
    from vigilog.operators import rulebook

    table = spark.createDataFrame(
        [("r", 1, at(0), "db.query", "latency_ms", ">", 10.0, "S", "LOW", None, None, None, None)],
        schema.RULE_SCHEMA)
    make_logs([{"event_type": "db.query", "latency_ms": float(v)} for v in range(20)]).write.parquet(
        str(tmp_path / "in"))
    found = rulebook.evaluate(stream(spark, str(tmp_path / "in"), False), table)
    pipeline.append(found, str(tmp_path / "out"), "s").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/s")).count() == 9


def test_progress_rows(spark, make_logs, tmp_path):
    from vigilog.operators import audit

    make_logs([{"event_type": "x"}]).write.parquet(str(tmp_path / "in"))
    query = pipeline.append(stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), "t")
    query.awaitTermination()
    rows = audit.progress_rows(query)
    assert sum(r["input_rows"] for r in rows) == 1


# --- growing files ----------------------------------------------------------------


def tail(spark, directory, out):
    query = pipeline.append(tables.tail_log_files(spark, str(directory)), str(out), "lines")
    query.awaitTermination()
    return sorted((r.source_file, r.value) for r in spark.read.parquet(f"{out}/lines").collect())


def test_growing_files(spark, tmp_path):
    directory, out = tmp_path / "logs", tmp_path / "out"
    directory.mkdir()
    (directory / "a.log").write_bytes(b"one\ntwo\nhal")
    (directory / "ignored.txt").write_bytes(b"no\n")
    assert tail(spark, directory, out) == [("a.log", "one"), ("a.log", "two")]
    with open(directory / "a.log", "ab") as file:
        file.write(b"f\r\n\nthree\n")
    (directory / "b.log").write_bytes(b"b1\n")
    want = [("a.log", t) for t in ("", "half", "one", "three", "two")] + [("b.log", "b1")]
    assert tail(spark, directory, out) == want
    assert tail(spark, directory, out) == want


def test_replaced_file_is_read_from_its_start(spark, tmp_path):
    directory, out = tmp_path / "logs", tmp_path / "out"
    directory.mkdir()
    (directory / "a.log").write_bytes(b"first long line\nsecond\n")
    tail(spark, directory, out)
    (directory / "a.log").write_bytes(b"new\n")
    assert ("a.log", "new") in tail(spark, directory, out)


def lines_of(reader, start, end):
    return [v for span in reader.partitions(start, end) for batch in reader.read(span) for v in batch.column(0).to_pylist()]


def test_rotation(tmp_path):
    reader = LogTailReader({"path": str(tmp_path)})
    log = tmp_path / "a.log"
    log.write_bytes(b"one\n")
    first = reader.latestOffset()
    assert lines_of(reader, reader.initialOffset(), first) == ["one"]
    # Replaced by a longer file; both of the old number and of the new are told apart.
    log.rename(tmp_path / "a.log.1")
    log.write_bytes(b"a much longer first line\nsecond\n")
    second = reader.latestOffset()
    assert lines_of(reader, first, second) == ["a much longer first line", "second"]
    # Renamed, or gone, between planning and reading.
    with open(log, "ab") as file:
        file.write(b"third\n")
    third = reader.latestOffset()
    log.rename(tmp_path / "a.log.2")
    assert lines_of(reader, second, third) == ["third"]
    (tmp_path / "a.log.2").unlink()
    assert lines_of(reader, second, third) == []
    # A new reader after a restart goes on from the stored offset.
    assert json.loads(LogTailReader({"path": str(tmp_path)}).latestOffset()["files"]) == {}


@pytest.mark.parametrize("split", [1, 2, 5, 7, 1000])
def test_pieces_cover_each_line_once(tmp_path, split):
    text = b"a\n\nbbb\ncc\r\nddddddddd\ne\ntail without end"
    (tmp_path / "x.log").write_bytes(text)
    reader = LogTailReader({"path": str(tmp_path), "splitBytes": str(split)})
    spans = reader.partitions(reader.initialOffset(), reader.latestOffset())
    lines = [value for span in spans for batch in reader.read(span) for value in batch.column(0).to_pylist()]
    assert lines == ["a", "", "bbb", "cc", "ddddddddd", "e"]


def test_last_line_end_in_small_blocks(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"aaaa\nbbbbbbbb")
    assert last_line_end(str(path), 0, 13, block=3) == 5
    assert last_line_end(str(path), 5, 13, block=3) == 5
    assert os.path.getsize(path) == 13


def test_closed_windows_only(spark, make_logs, tmp_path):
    rows = [{"event_type": "x", "log_level": "ERROR", "timestamp": at(s)} for s in (0, 10, 70, 300)]
    make_logs(rows).write.parquet(str(tmp_path / "in"))
    rates = pipeline.error_rates(stream(spark, str(tmp_path / "in"), False), "1 minute", "0 seconds")
    pipeline.append(rates, str(tmp_path / "out"), "rates").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/rates")).agg(F.sum("events"), F.count("*")).first()
    assert tuple(got) == (3, 2)
