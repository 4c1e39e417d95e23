import random

from pyspark.sql import functions as F

from vigilog.llm.license_scan import TEMPLATES, _hashed, align, fingerprints, scan


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(60):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        pairs = align(a, b, 0, 20)
        assert len(pairs) == longest(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    assert all(abs(j - i - 3) <= 1 for i, j in align([1, 2, 3], [1, 1, 2, 1, 2, 3, 3], 3, 1))


def test_winnowing_takes_one_of_every_window():
    words = _hashed(TEMPLATES["mit-grant"])
    places = sorted(fingerprints(words, 3, 4))
    assert places[0] < 4 and all(b - a <= 4 for a, b in zip(places, places[1:]))
    assert fingerprints(_hashed("one two"), 3, 4).keys() == {0} and fingerprints(_hashed(""), 3, 4) == {}


def test_finds_planted_templates(make_docs):
    rng = random.Random(3)
    items, want = [], {}
    for i, (name, text) in enumerate(sorted(TEMPLATES.items()) * 4):
        filler = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(0, 60)))
        words = text.split()
        if len(words) > 20:  # some words lost, changed or added
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["", "changed", "two words"])
        items.append((i, f"{filler()} {' '.join(words)}\n{filler()}"))
        want[i] = name
    items += [(500 + k, " ".join(f"w{rng.randrange(900)}" for _ in range(200))) for k in range(10)]
    got = {}
    for r in scan(make_docs(items)).collect():
        got.setdefault(r.doc_id, {})[r.template] = r
    assert set(got) == set(want)
    for i, name in want.items():
        assert name in got[i] and got[i][name].coverage >= 0.8, (i, name)
        words = [w for w in items[i][1].lower().replace("/", " ").split()]
        assert all(0 <= s.start < s.end <= 2 * len(words) for s in got[i][name].spans)


def test_every_occurrence_and_its_place(make_docs):
    line = TEMPLATES["mit-line"]
    rows = scan(make_docs([(1, f"a {line} b {line}{line}"), (2, "Released under the MIT Licence")])).collect()
    assert [(r.doc_id, r.template, r.coverage, r.n_matches) for r in rows if r.doc_id == 1] == [(1, "mit-line", 1.0, 3)]
    assert [(s.start, s.end) for s in rows[0].spans] == [(1, 6), (7, 12), (12, 17)]
    assert [r.coverage for r in rows if r.doc_id == 2] == [0.8]


def test_nulls_repeats_clashes_and_empty(make_docs):
    line = TEMPLATES["gpl-3.0-line"].upper()
    docs = make_docs([(1, line), (1, line), (None, line), (2, None), (3, ""), (4, " ;\n")]).withColumn("template", F.lit(1))
    assert sorted((r.doc_id or 0, r.template) for r in scan(docs).collect()) == [(0, "gpl-3.0-line"), (1, "gpl-3.0-line"), (1, "gpl-3.0-line")]
    assert scan(docs, {"none": "", "one": "gnu"}).where("template = 'none'").count() == 0
    assert scan(make_docs([])).count() == 0
