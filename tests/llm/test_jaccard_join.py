import random
import re

from pyspark.sql import functions as F

from vigilog.llm.jaccard_join import near_duplicates


def brute(items, size, percent):
    sets = {}
    for i, text in items:
        words = re.findall(r"[^\x20\x09-\x0d]+", "" if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
        sets[i] = grams or ({tuple(words)} if words else set())
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def texts(seed, groups=12, copies=9, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(1, words))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            edited = list(base)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            out.append((" " if rng.random() < 0.5 else "\n").join(edited))
    return out


def check(make_docs, items, size=3, percent=90, **more):
    got = near_duplicates(make_docs(items), size=size, percent=percent, **more).collect()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert len(got) == len(items)
    assert found == brute(items, size, percent)


def test_equals_brute_force(make_docs):
    for seed in range(2):
        items = list(enumerate(texts(seed)))
        random.Random(seed).shuffle(items)
        check(make_docs, items)
    check(make_docs, items, size=5, percent=80)


def test_other_ways_give_the_same(make_docs):
    items = list(enumerate(texts(7)))
    check(make_docs, items, star_rounds=0, small=0, max_need=1, max_bits=0)


def test_odd_texts(make_docs):
    items = [(5, None), (4, ""), (3, " \n"), (2, "one"), (9, "ONE"), (7, "one two"), (8, "two one"),
             (1, "Émile saw"), (6, "émile saw"), (10, "a b c"), (11, "A\tb\x0bC")]
    check(make_docs, items)


def test_chain_of_near_copies(make_docs):
    # Each text links with the next one only; all are one component.
    words = [f"v{k}" for k in range(260)]
    check(make_docs, [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(30)], size=3, percent=90)


def test_nulls_repeats_and_empty(spark, make_docs):
    docs = make_docs([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d")])
    docs = docs.withColumn("node", F.lit(1)).withColumn("prefix", F.lit("x")).withColumn("component_id", F.lit(0))
    got = near_duplicates(docs, size=3, percent=90).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [
        (-1, 2, -1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert near_duplicates(make_docs([]), size=3, percent=90).count() == 0
