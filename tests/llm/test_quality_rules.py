import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from vigilog.llm.quality_rules import keep_good, report, weights


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    covered = {k for i, g in enumerate(grams) if seen[g] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def ratios(spark, items, trusted, cells, smooth=10.0):
    """The same ratio from counts in Python; Spark only gives the hashes."""
    words = {i: re.findall(r"[^\x20\x09-\x0d]+", t or "") for i, t in items}
    every = sorted({w for ws in words.values() for w in ws})
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = sorted({(h[a], h[b]) for ws in words.values() for a, b in zip(ws, ws[1:])})
    p = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    half = cells // 2
    cell = lambda x: (x % 2**64) * half >> 64  # noqa: E731  the first bits
    grams = {i: [cell(h[w]) for w in ws] + [cell(p[h[a], h[b]]) + half for a, b in zip(ws, ws[1:])] for i, ws in words.items()}
    raw, own = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        own.update(g if i in trusted else ())
    scale = sum(own.values()) / sum(raw.values())
    lr = {c: math.log((own[c] + smooth) / (scale * raw[c] + smooth)) for c in raw}
    return {i: sum(lr[c] for c in g) / max(1, len(g)) for i, g in grams.items()}


def fixture():
    rng = random.Random(2)
    good = [f"w{k}" for k in range(50)]
    items = [(i, " ".join(rng.choices(good, k=rng.randint(15, 60)))) for i in range(30)]
    items += [(100 + i, " ".join(f"{w}###" for w in rng.choices(good, k=40))) for i in range(6)]
    items += [(200, "one two " * 30), (201, None), (202, ""), (203, " \x0b\n"), (204, "a\na\n\n \nb\na \na|<"), (205, "é" * 30)]
    items += [(206, " ".join(good[:12] * 2 + good)), (207, "x\x85y \x1cz " + " ".join(good[:25]))]
    return items


LABELS = "doc_id long, quality int, toxic int"


def test_equals_brute_force(spark, make_docs):
    items = fixture()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] * 2 + [(20, 1, 1), (100, 0, 0), (None, 1, 0), (21, None, 0)], LABELS)
    rows = report(make_docs(items), labels, cells=256).collect()
    want = ratios(spark, items, set(range(20)), 256)
    assert len(rows) == len(items)
    for r in rows:
        text = dict(items)[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text), text
        assert abs(r.ratio - want[r.doc_id]) < 1e-9
        assert r.kept == (not r.base_failed and r.ratio >= -0.1)
    kept = {r.doc_id for r in rows if r.kept}
    assert not kept & set(range(100, 106)) and len(kept & set(range(30))) > 20


def test_native_plan(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    plan = report(make_docs(fixture()), labels, cells=64)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    # The weights are inside the sum and not a column of the rows.
    assert "_weight" not in plan


def test_no_labels_clashes_repeats_and_empty(spark, make_docs):
    none = spark.createDataFrame([], LABELS)
    text = " ".join(f"w{k}" for k in range(25))
    docs = make_docs([(1, text), (1, text), (None, text), (2, "short")])
    for name in ("_row", "kept", "_words", "n_words"):
        docs = docs.withColumn(name, F.lit("x"))
    kept = keep_good(docs, none)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1]
    assert report(make_docs([]), none).count() == 0
    assert weights(make_docs([]), none.select("doc_id"), 64, 1.0).count() == 0


def lowest(weight, words, stretch=64, strong=-1.0):
    sums = [sum(w for w in map(weight.get, words[k : k + stretch]) if w < strong) for k in range(0, max(1, len(words)), stretch // 2)]
    return min(sums) / stretch


def test_few_toxic_words_in_long_clean_prose(spark, make_docs):
    rng = random.Random(5)
    vocabulary, insults = [f"w{k}" for k in range(200)], [f"insult{k}" for k in range(5)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, prose(60)) for i in range(400)]
    items += [(1000 + i, prose(100) + rng.sample(insults, 5) + prose(100)) for i in range(60)]
    # Held out: the same long prose without, with a few together, and with one here and there.
    long = prose(3000)
    apart = list(long)
    apart[200::900] = insults[:4]
    items += [(2000, long), (2001, long[:1490] + insults + long[1495:]), (2002, long[:2995] + insults), (2003, apart)]
    items += [(2004, prose(20)), (2005, prose(15) + insults)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)] + [(1000 + i, 1, 1) for i in range(30)], LABELS)
    rows = {r.doc_id: r for r in report(make_docs([(i, " ".join(ws)) for i, ws in items]), labels).collect()}
    raw, own = Counter(), Counter()
    for i, ws in items:
        raw.update(ws)
        own.update(ws if i < 400 else ())
    grams = lambda keep: sum(max(0, 2 * len(ws) - 1) for i, ws in items if keep(i))
    scale = grams(lambda i: i < 400) / grams(lambda i: True)
    weight = {w: math.log((own[w] + 10) / (scale * raw[w] + 10)) for w in raw}
    for i, ws in items:
        assert abs(rows[i].lowest - lowest(weight, ws)) < 1e-9
    assert all(rows[i].ratio >= -0.1 and not rows[i].base_failed for i in range(2000, 2005))
    assert [rows[i].kept for i in range(2000, 2006)] == [True, False, False, True, True, False]
    assert not any(rows[1000 + i].kept for i in range(60)) and all(rows[i].kept for i in range(400))


def test_weights_stay_one_subquery(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    found = report(make_docs(fixture()), labels, cells=64)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedSubquery" in plan or len(re.findall(r"Subquery subquery#", plan)) <= 1
