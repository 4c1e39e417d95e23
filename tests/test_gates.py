"""Gates on a stream against the batch gates and a plain walk."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from helpers import at
from vigilog.operators import respond
from vigilog.streaming import gates, pipeline

SHAPE = "incident_id string, service string, action string, error string, status string, created_at timestamp, executed_at timestamp"
MINUTE = 60_000_000
HOW = dict(cooldown_us=2 * MINUTE, retry_limit=4, retry_window_us=10 * MINUTE, failure_limit=3)


def responses(rng, n, span=3600):
    rows = []
    for i in range(n):
        service, action = rng.choice([("db", "restart")] * 4 + [("web", "restart"), ("web", "block")])
        second = rng.choice([rng.randint(0, span), rng.randint(0, span) // 60 * 60])
        rows.append((f"i{i:04d}", service, action, rng.choice(["slow", "down"]), rng.choice(["failed", "success"]), second,
                     second + rng.choice([0, 7, 300])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r[:5], at(r[5]), at(r[6])) for r in rows], SHAPE)


def plainly(rows, cooldown_us, retry_limit, retry_window_us, failure_limit, protected=(), after_allowed=False):
    """(incident, attempts, in_cooldown, suppressed, decision)"""
    out = []
    for key in {r[1:3] for r in rows}:
        own = sorted((r for r in rows if r[1:3] == key), key=lambda r: (r[5], r[0]))
        last = None
        for r in own:
            us = r[5] * 1_000_000
            n = sum(us - retry_window_us <= o[5] * 1_000_000 <= us for o in own)
            held = last is not None and us - last < cooldown_us
            if not held or not after_allowed:
                last = us
            failed = sorted(o[6] for o in own if o[4] == "failed" and o[3] == r[3])
            known = len(failed) >= failure_limit and r[5] > failed[failure_limit - 1]
            decision = ("protected" if key[0] in protected else "retry_limit" if n > retry_limit
                        else "cooldown" if held else "allowed")
            out.append((r[0], n, held, known, decision))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("incident_id", "attempts", "in_cooldown", "suppressed", "decision").collect())


def to_the_end(spark, rows, root, **how):
    marks, out = f"{root}/marks", f"{root}/out"

    def run():
        pipeline.append(gates.gated(pipeline.with_end_marks(rows, marks), "5 minutes", **how), out, "gated").awaitTermination()

    run()
    pipeline.end_mark(spark, rows.schema, marks, service="end", action="end", kind=0, incident_id="end", at=pipeline.END)
    run()
    return spark.read.parquet(f"{out}/gated")


def stream_of(spark, path, df, files, rng, lateness=200):
    rows = sorted(df.collect(), key=lambda r: r["at"].timestamp() + rng.random() * lateness)
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("after", ["attempt", "allowed"])
def test_batch_equals_a_plain_walk(spark, after):
    rows = responses(random.Random(3), 150)
    df = frame(spark, rows)
    protected = spark.createDataFrame([("web",)], "service string")
    found = respond.gated(df, df, protected=protected, cooldown_after=after, **HOW)
    assert got(found) == plainly(rows, **HOW, protected=("web",), after_allowed=after == "allowed")


@pytest.mark.parametrize("after, seed", [("attempt", 4), ("allowed", 5)])
def test_stream_equals_batch(spark, tmp_path, after, seed):
    rng = random.Random(seed)
    rows = responses(rng, 160)
    df = frame(spark, rows)
    protected = spark.createDataFrame([("web",)], "service string")
    stream = stream_of(spark, str(tmp_path / "in"), gates.attempts_and_outcomes(df, df), 4, rng)
    found = got(to_the_end(spark, stream, str(tmp_path), protected=protected, cooldown_after=after, **HOW))
    assert found == plainly(rows, **HOW, protected=("web",), after_allowed=after == "allowed")
    assert {r[4] for r in found} == {"protected", "retry_limit", "cooldown", "allowed"} and {r[3] for r in found} == {True, False}


def test_late_rows_are_given_out_and_do_not_count(spark, tmp_path):
    shape = gates.attempts_and_outcomes(frame(spark, responses(random.Random(1), 1)), frame(spark, [])).schema
    batches = [
        [("db", "restart", 0, "a", "slow", at(0)), ("x", "y", 0, "far", "slow", at(5000))],
        [("db", "restart", 0, "b", "slow", at(5001))],
        [("db", "restart", 0, "c", "slow", at(10)), ("db", "restart", 1, "c", "slow", at(11)), ("db", "restart", 0, "d", "slow", at(5500))],
    ]
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)
    found = to_the_end(spark, stream, str(tmp_path), **{**HOW, "failure_limit": 1})
    assert sorted((r.incident_id, r.decision) for r in found.collect() if r.service == "db") == [
        ("a", "allowed"), ("b", "allowed"), ("c", "late"), ("c", "late_outcome"), ("d", "allowed")]
    assert {r.attempts for r in found.collect() if r.incident_id in "bd"} == {1, 2}
    assert not any(r.suppressed for r in found.collect() if r.incident_id == "d")


def test_empty_tables(spark):
    none = frame(spark, [])
    assert respond.gated(none, none, **HOW).collect() == []


class Kept:
    """A value, a list or a map in the state of one key, its calls counted."""

    def __init__(self, calls):
        self.calls, self.rows = calls, {}

    def __getattribute__(self, name):
        if name not in ("calls", "rows"):
            self.calls.append(name)
        return super().__getattribute__(name)

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows["value"]

    def update(self, row):
        self.rows["value"] = row

    def appendList(self, rows):
        self.rows["value"] = [*self.rows.get("value", []), *rows]

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, row):
        self.rows[key] = row

    def removeKey(self, key):
        del self.rows[key]

    def keys(self):
        return iter([*self.rows])

    def iterator(self):
        return iter([*self.rows.items()])

    def clear(self):
        self.rows.clear()

    put = update


class Key:
    """One service and action, without Spark."""

    def __init__(self, after_allowed, cooldown_us, retry_limit, retry_window_us, failure_limit):
        self.calls, self.wakes, self.limit = [], set(), retry_limit
        self.gates = gates.Gates(cooldown_us, retry_window_us, failure_limit, after_allowed)
        state = lambda *_: Kept(self.calls)
        self.gates.init(SimpleNamespace(
            getValueState=state, getListState=state, getMapState=state, registerTimer=lambda ms: (self.calls.append("timer"), self.wakes.add(ms))))

    def take(self, rows, watermark_ms, size=10_000):
        """The rows given out for ``rows``, (kind, us, incident, error), and a new watermark."""
        frame = pd.DataFrame(rows, columns=["kind", "us", "incident_id", "error"])
        frames = iter([frame[lo : lo + size] for lo in range(0, len(frame), size)])
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark_ms)
        out = [*self.gates.handleInputRows(("db", "restart"), frames, now)] if rows else []
        due = sorted(ms for ms in self.wakes if ms <= watermark_ms)
        self.wakes -= set(due)
        for ms in due:
            out += self.gates.handleExpiredTimer(("db", "restart"), now, SimpleNamespace(getExpiryTimeInMs=lambda: ms))
        return pd.concat(out) if out else pd.DataFrame(columns=gates._COLUMNS)


def test_work_for_a_key_grows_with_its_rows():
    """A full retry window and many failures: calls to the state neither grow with the
    attempts of a window nor with the outcomes."""
    n, rng = 30_000, random.Random(7)
    rows = [(0, i * 1000, f"i{i:06d}", "slow") for i in range(n)] + [(1, i * 10_000 + 500, f"i{i:06d}", "slow") for i in range(n // 10)]
    rng.shuffle(rows)
    key = Key(False, 1500, 3, 50 * MINUTE, 100)
    assert not len(key.take(rows, 0))
    found = key.take([], 10**9).sort_values("us")
    assert len(key.calls) < 200
    assert found["attempts"].tolist() == [*range(1, n + 1)]
    assert found["in_cooldown"].tolist() == [False] + [True] * (n - 1)
    assert found["suppressed"].tolist() == (np.arange(n) * 1000 > 99 * 10_000 + 500).tolist()
    assert key.gates.waiting.exists() is False


@pytest.mark.parametrize("after_allowed", [False, True])
def test_runs_are_judged_in_time_order(monkeypatch, after_allowed):
    """Many small runs, with the watermark in the middle of them, against a plain walk."""
    monkeypatch.setattr(gates, "_RUN", 7)
    monkeypatch.setattr(gates, "_HELD", 20)
    rng = random.Random(11)
    rows = [("i%04d" % i, "db", "restart", *r[3:]) for i, r in enumerate(responses(rng, 300))]
    stream = [(0, r[5] * 1_000_000, r[0], r[3]) for r in rows] + [(1, r[6] * 1_000_000, r[0], r[3]) for r in rows if r[4] == "failed"]
    stream.sort(key=lambda r: r[1] + rng.random() * 300_000_000)
    key, found, passed = Key(after_allowed, **HOW), [], 0
    for lo in range(0, len(stream), 60):
        part = stream[lo : lo + 60]
        found.append(key.take(part, passed, size=9))
        passed = max(passed, max(r[1] for r in part) // 1000 - 300_000)
        found.append(key.take([], passed))
    found = pd.concat([part for part in (*found, key.take([], 10**9)) if len(part)])
    assert found["late"].isna().all()
    expected = plainly(rows, **HOW, after_allowed=after_allowed)
    assert sorted(zip(*(found[c] for c in ("incident_id", "attempts", "in_cooldown", "suppressed")))) == [r[:4] for r in expected]
    # Nothing is kept for ever but the failures.
    assert not (key.gates.waiting.exists() or key.gates.recent.exists())
