import random
import re

from pyspark.sql import functions as F

from vigilog.llm.decontaminate import keep_clean, report


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(items, bench, size=13):
    windows = []
    for i, text in bench:
        w = words(text)
        windows += [(i, tuple(w[k : k + size])) for k in range(max(1, len(w) - size + 1) if w else 0)]
    out = {}
    for d, text in items:
        w = words(text)
        hit, found = set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(i))
        out[d] = (len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["été", "Naïve"]
    bench = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 7, 13, 14, 30])))) for i in range(12)]
    bench += [(50, None), (51, " .;"), (52, bench[-1][1])]
    docs = []
    for d in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            part = words(rng.choice(bench)[1])
            cut = part[: rng.randint(0, len(part))] if rng.random() < 0.4 else part
            at = rng.randint(0, len(text))
            text[at:at] = [x.upper() if rng.random() < 0.3 else x for x in cut]
        docs.append((d, "; ".join(text) if rng.random() < 0.5 else " ".join(text)))
    return docs + [(100, None), (101, ""), (102, "!?")], bench


def compare(spark, make_docs, docs, bench, **how):
    table = spark.createDataFrame(bench, "item_id long, text string")
    rows = report(make_docs(docs), table, **how).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in rows}
    assert len(rows) == len(docs)
    assert got == brute(docs, bench)
    assert all(sum(e - s for s, e in zip(r.starts, r.ends)) == r.n_hit for r in rows)


def test_equals_brute_force(spark, make_docs):
    for seed in (1, 2):
        compare(spark, make_docs, *fixture(seed))


def test_blocks_give_the_same(spark, make_docs):
    docs, bench = fixture(3)
    compare(spark, make_docs, docs, bench, max_windows=20)


def test_repeats_clashes_and_empty(spark, make_docs):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(13)))], "item_id long, text string")
    bad = " ".join(f"w{k}" for k in range(13))
    docs = make_docs([(1, bad), (1, bad), (None, bad), (2, "fine words"), (3, None)])
    docs = docs.withColumn("n_words", F.lit("x")).withColumn("items", F.lit(1))
    assert sorted(r.doc_id for r in keep_clean(docs, bench).collect()) == [2, 3]
    assert keep_clean(docs, bench).columns == docs.columns
    none = bench.limit(0)
    assert report(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert report(docs.limit(0), bench).count() == 0
