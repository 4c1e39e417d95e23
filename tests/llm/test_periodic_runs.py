import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from vigilog.llm import periodic_runs


def brute(words, least=6, times=4):
    """All runs by trying every period."""
    n, wide = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                if not any(s <= i and e >= j + q for s, e, p in wide if p < q):
                    wide.append((i, j + q, q))
            i = max(j, i + 1)
    return sorted((s, e - s, q) for s, e, q in wide)


def periodic(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = periodic((text or "").encode().split(), doc_id)
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    body = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(words), len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(body).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.integers(1, 9), st.sampled_from([(6, 4), (2, 2), (7, 3)]))
def test_runs_equal_brute_force(words, copies, limits):
    words = words[:7] + words[7:12] * copies + words[12:]
    assert [tuple(r) for r in periodic_runs.all_runs(words, *limits).tolist()] == brute(words, *limits)


def test_tree_finds_common_extensions():
    import numpy as np

    words = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1])
    tree = periodic_runs.Extensions(words)
    for a in range(len(words)):
        for b in range(len(words)):
            if a != b:
                n = 0
                while max(a, b) + n < len(words) and words[a + n] == words[b + n]:
                    n += 1
                assert tree.common(np.array([a]), np.array([b])).tolist() == [n]
    order = sorted(range(len(words)), key=lambda i: words[i:].tolist())
    assert np.argsort(tree.rank[: len(words)]).tolist() == order


def test_report_equals_brute_force(spark, make_docs):
    rng = random.Random(5)
    texts = []
    for i in range(120):
        line = " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
        texts.append((i * 7, "\n".join([line] * rng.randrange(1, 12)) + " " + " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))))
    docs = make_docs(texts)
    got = periodic_runs.report(periodic_runs.with_periods(docs)).collect()
    assert sorted(map(tuple, got)) == sorted(digest(*t) for t in texts)


def test_odd_input(spark):
    rows = [(10, None), (11, ""), (12, " \t\n"), (13, "x " * 30), (13, "x " * 30), (None, "y y y y y y y"),
            (14, "\u00a0 " * 6)]
    docs = spark.createDataFrame([(a, b, "r", "c") for a, b in rows], "doc_id long, text string, runs string, collapsed string")
    got = periodic_runs.report(docs).collect()
    by = {r.doc_id: r for r in got}
    assert by[10].n_runs == 0 and by[10].length is None and by[10].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[13].length == 30 and by[13].collapsed_sha256 == hashlib.sha256(b"x").hexdigest()
    assert by[None].length == 7 and by[14].n_runs == 1 and len(got) == len(rows)
    assert periodic_runs.report(docs.limit(0)).collect() == []
    assert periodic_runs.with_periods(docs).where("doc_id is null").first().text == "y y y y y y y"


def test_ties_go_to_the_smallest_start(spark, make_docs):
    row = periodic_runs.report(make_docs([(1, "a a a a a a b c c c c c c")])).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 0, 6, 1, 6000)


def test_very_long_text(spark, make_docs):
    """Beyond a chunk of 1 MiB: one long period, one short, and words in between."""
    words = [f"w{i % 9000}" for i in range(60_000)] + [f"u{i}" for i in range(90_000)] + ["z"] * 50_000
    row = periodic_runs.find(make_docs([(1, " ".join(words))])).first()
    assert [tuple(r) for r in row.runs] == [(0, 60_000, 9000), (150_000, 50_000, 1)]
    assert row.collapsed.split() == words[:9000] + words[60_000:150_001]


def test_two_runs_may_overlap():
    words = list("abababababbbbbbb")
    got = periodic_runs.all_runs([w.encode() for w in words], 6, 4).tolist()
    assert [tuple(r) for r in got] == brute(words) and len(got) == 2


@pytest.mark.parametrize("n", [5, 6])
def test_least_length(n):
    assert len(periodic_runs.all_runs([b"a"] * n, 6, 4)) == (n == 6)
