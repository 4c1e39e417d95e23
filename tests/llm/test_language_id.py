import math
import random
import zlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from vigilog.llm.language_id import grams_of, identify, words_in

SOUNDS = {"aa": ["ta", "ri", "mo", "el"], "bb": ["sch", "ung", "ver", "ei"], "cc": ["ção", "lh", "os", "em"]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        word = lambda: "".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 4)))
        rows.append((i, " ".join(word() for _ in range(rng.randint(1, 25))), lang, "s"))
    return rows


def test_held_out_accuracy(make_docs):
    rows = corpus(400)
    got = {r.doc_id: r for r in identify(make_docs(rows)).collect()}
    assert len(got) == 400
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in out}
    assert sum(got[r[0]].lang_pred == r[2] for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_rows_teach_nothing(make_docs):
    rows = corpus(80)
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else g, s) for i, t, g, s in rows]
    pick = lambda items: sorted((r.doc_id, r.lang_pred, r.score) for r in identify(make_docs(items)).collect())
    assert pick(rows) == pick(swapped)


def plain_words(text):
    return regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()) if text else []


def plain_grams(word, size):
    marked = f"^{word}$" if size > 1 else word
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def brute(rows):
    """(id, prediction, score) by dictionaries."""
    teach = [(t, g) for i, t, g, _ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2 and g and t]
    words = {g: Counter() for _, g in teach if any(plain_words(t) for t, h in teach if h == g)}
    for t, g in teach:
        if g in words:
            words[g].update(plain_words(t))
    langs = sorted(words)
    grams = {(g, k): Counter(x for w in words[g] for x in plain_grams(w, k)) for g in langs for k in range(1, 6)}

    def log(table, key, total):
        return math.log((table.get(key) or 0.5) / total)

    def vector(word):
        if any(word in words[g] for g in langs):
            return [log(words[g], word, sum(words[g].values())) for g in langs]
        for k in (5, 4, 3, 2, 1):
            own = [x for x in plain_grams(word, k) if any(x in grams[g, k] for g in langs)]
            if own:
                return [sum(log(grams[g, k], x, sum(grams[g, k].values()) or 1) for x in own) / len(own) for g in langs]
        return [0.0] * len(langs)

    out = []
    for i, t, _, _ in rows:
        own = plain_words(t)
        if not own or not langs:
            out.append((i, "und", 0.0))
            continue
        sums = [sum(x) for x in zip(*map(vector, own))]
        best = max(sums)
        out.append((i, langs[sums.index(best)], 1 / sum(math.exp(x - best) for x in sums)))
    return out


@pytest.mark.parametrize("cells", [0, 60, 1_000_000])
def test_predictions_equal_brute_force(make_docs, cells):
    """Whatever part of the words is sent to the tasks: none, some, all."""
    rng = random.Random(4)
    rows = corpus(60, 3)
    rows += [(100 + i, " ".join("".join(rng.choices("taschriverçqqxz", k=rng.randint(1, 9))) for _ in range(8)), rng.choice(["aa", "bb", None]), "s")
             for i in range(60)]
    rows += [(300, "a\u0301 \u0301b \u0301 İSTANBUL ΣΑΣ x", "cc", "s"), (301, "日本語 テスト", "aa", "s"), (301, "日本語 テスト", "aa", "s")]
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in identify(make_docs(rows), cells).collect())
    want = sorted(brute(rows))
    assert [(i, p) for i, p, _ in got] == [(i, p) for i, p, _ in want]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want], abs=1e-9)


def test_ties_go_to_the_first_name(make_docs):
    rows = [(0, "same words", "b", "s"), (1, "same words", "a", "s"), (2, "same", None, "s"), (4, "zzz", None, "s")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(make_docs(rows)).collect()}
    assert got[2] == ("a", pytest.approx(0.5)) and got[4] == ("a", pytest.approx(0.5))


def test_very_long_texts_are_cut_between_words():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcé\u0301-", k=rng.randint(1, 12))) for _ in range(300_000))
    found = [whole[s:e] for _, _, starts, ends, whole in words_in(["x", text, None, "y" * 3_000_000]) for s, e in zip(starts, ends)]
    assert found == ["x", *plain_words(text), "y" * 3_000_000]


def test_hashes_tell_words_and_grams_apart():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    hashes = {h for _, own, *_ in words_in(words) for h in own.tolist()}
    assert len(hashes) == 600
    place, gram = grams_of(["ab", "b", "ab"], 2)
    assert place.tolist() == [0, 0, 0, 1, 1, 2, 2, 2] and len(set(gram.tolist())) == 4
    assert grams_of(["ab", "b"], 1)[0].tolist() == [0, 0, 1] and len(grams_of(["a"], 5)[1]) == 0


def test_no_letters_nulls_clashes_and_empty(make_docs):
    docs = make_docs([(i, t, "xx", "s") for i, t in enumerate(["fine words", None, "", "123 !?", "²Ⅷ", "ok"])] + [(None, "ok", None, None)])
    docs = docs.withColumn("score", F.lit("x")).withColumn("n", F.lit(1))
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in identify(docs).collect()}
    assert got == {0: ("xx", True), 1: ("und", False), 2: ("und", False), 3: ("und", False), 4: ("und", False),
                   5: ("xx", True), None: ("xx", True)}
    assert {r.lang_pred for r in identify(make_docs([(1, "word", None, "s")])).collect()} == {"und"}
    assert identify(make_docs([])).count() == 0
