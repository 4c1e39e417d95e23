import hashlib
import random

from pyspark.sql import functions as F

from vigilog.llm.suffix_dedup import remove_repeats, report


def brute(items, length):
    rows = [(i, (t or "").encode()) for i, t in items]
    first = {}
    for i, body in rows:
        if i is not None:
            for k in range(len(body) - length + 1):
                s = body[k : k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, body in rows:
        gone = [False] * len(body)
        if i is not None:
            for k in range(len(body) - length + 1):
                if first[body[k : k + length]] < i:
                    gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out.append((i, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs, items, length=50, **how):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in report(docs, length, **how).collect()]
    assert sorted(got, key=str) == brute(items, length)


def fixture(seed, n=50):
    rng = random.Random(seed)
    letters = "abcdé fgh"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randint(8, 40)) for _ in range(8)]
    items = []
    for i in range(n):
        body = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            at = rng.randint(0, len(body))
            body = body[:at] + p[a : rng.randint(a, len(p))] + body[at:]
        items.append((i * 3, body))
    items += [(1000 + k, items[rng.randrange(n)][1]) for k in range(5)]
    items += [(2000, "ab" * 200), (2001, "ab" * 90), (2002, "x" * 49), (2003, "x" * 50), (2004, "x" * 51), (2005, None), (2006, "")]
    rng.shuffle(items)
    return items


def test_equals_brute_force(make_docs):
    for seed in (1, 2):
        items = fixture(seed)
        check(make_docs(items), items)
    check(make_docs(items), items, length=33)


def test_other_ways_give_the_same(make_docs):
    items = fixture(3)
    check(make_docs(items), items, hot=3, small=0)
    check(make_docs(items), items, max_bits=0)


def test_repeats_nulls_clashes_and_empty(make_docs):
    passage = "The same sixty characters of text, in every one of the rows."
    items = [(4, passage), (4, passage), (None, passage), (7, "head " + passage + " tail"), (3, passage + "!"), (9, None)]
    docs = make_docs(items)
    for name in ("key", "spans", "size"):
        docs = docs.withColumn(name, F.lit("x"))
    check(docs, items)
    cut = remove_repeats(docs)
    assert cut.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in cut.collect() if r.text is not None) == [
        (0, passage, 60), (3, passage + "!", 61), (4, "", 0), (4, "", 0), (7, "head  tail", 10)]
    check(make_docs([]), [])


def test_cut_keeps_characters_whole(make_docs):
    body = "é" * 40
    rows = remove_repeats(make_docs([(1, body), (2, "x" + body + "ü")])).collect()
    assert {r.doc_id: r.text for r in rows} == {1: body, 2: "xü"}
