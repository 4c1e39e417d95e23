import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.llm import packing

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def token_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def all_patterns(units, depth):
    out = []

    def grow(left, most, parts):
        if left == 0:
            out.append(parts)
        elif len(parts) < depth:
            for part in range(min(left, most), 0, -1):
                grow(left - part, part, (*parts, part))

    grow(units, units, ())
    return out


def test_best_pattern_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(40):
        gains = np.where(rng.random(13) < 0.6, -np.inf, rng.normal(size=13))
        ways = [w for w in all_patterns(12, 4) if all(gains[u] > -np.inf for u in w)]
        found = packing.best_pattern(gains, 4)
        if not ways:
            assert not len(found)
            continue
        assert tuple(found) in ways
        assert gains[found].sum() == pytest.approx(max(sum(gains[u] for u in w) for w in ways))


def test_least_squares_has_no_better_pattern():
    """Against all patterns at once: none of them would lessen the squares."""
    rng = np.random.default_rng(2)
    ways = all_patterns(10, 3)
    a = np.stack([np.bincount(w, minlength=11) for w in ways], 1).astype(float)
    for _ in range(5):
        counts = np.r_[0, rng.integers(1, 60, 10)].astype(float)
        found = packing.least_squares(counts, 3, 500)
        x = np.zeros(len(ways))
        for way, repeats in found:
            x[ways.index(tuple(way))] = repeats
        gain = a.T @ (counts - a @ x)
        assert (x >= 0).all() and (gain < 1e-3).all() and (np.abs(gain[x > 1e-6]) < 1e-3).all()


def lengths(n, seed, mean=6.3):
    rng = random.Random(seed)
    histogram = defaultdict(int)
    for _ in range(n):
        histogram[min(4096, max(1, int(rng.lognormvariate(mean, 1))))] += 1
    return histogram


@pytest.mark.parametrize("n,mean,how", [(20_000, 6.3, {}), (20_000, 7.5, {"step": 32, "depth": 3}), (300, 6.3, {}), (1, 6, {}), (5000, 3, {})])
def test_plan_is_tight_and_whole(n, mean, how):
    histogram = lengths(n, n, mean)
    rows = packing.plan(histogram, **how)
    filled, placed = defaultdict(list), defaultdict(int)
    for length, rank, count, base, offset in rows:
        assert rank == placed[length]
        placed[length] += count
        for k in range(count):
            filled[base + k].append((offset, length))
    assert placed == histogram
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(k * n for k, n in histogram.items())
    assert len(filled) <= -(-total // 4096) * 1.01 + 1


@pytest.mark.parametrize("n", [1000, 30_000])
def test_patterns_place_most_pieces(n):
    histogram = lengths(n, 3)
    work = packing.fit(histogram)
    assert work.fitted - histogram[4096] > 0.8 * (n - histogram[4096])


def test_the_plan_does_not_grow_with_the_corpus():
    one = packing.plan(lengths(30_000, 5))
    many = packing.plan({k: 1000 * n for k, n in lengths(30_000, 5).items()})
    assert len(many) < 2 * len(one)


def test_ids_equal_the_whole_text(make_docs):
    rng = random.Random(4)
    odd = ["don't", "İstanbul", "é", "́x", "Σας", "a b", "x\ty", "<|endoftext|>", "日本語", "1234", "!!!", "ﬁ", " ", "a" * 60]
    texts = [" ".join(rng.choices(odd + ["the", "word"], k=rng.randint(0, 30))) for _ in range(60)]
    texts = [t.replace(" ", rng.choice([" ", "\n", "  ", " \n"]), 5) for t in texts] + ["", " ", None, "\n"]
    rows = packing.pieces(make_docs(list(enumerate(texts))), PATH, capacity=16, with_ids=True).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(got[r.doc_id]) and r.length == len(r.ids) <= 16
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id] += r.ids
    assert dict(got) == {i: token_ids(t) for i, t in enumerate(texts)}


def test_ids_of_every_latin_letter(make_docs):
    """Words of all lower- and upper-case letters below 0x250, alone and mixed."""
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    rng = random.Random(6)
    texts = [" ".join(letters)] + [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(40)) for _ in range(30)]
    assert list(packing._ids(texts, PATH, 1)) == [np.array(token_ids(t), "<u4").tobytes() for t in texts]


def test_forgetting_and_small_calls_change_nothing(monkeypatch):
    texts = ["one two three. four!", "five one, two", "it's e.g. \"so\", (7). <|endoftext|>, <|endoftext|>. été, ñ: A1: x|y. Mc. d'. '.", "", "six " * 30 + "a" * 100 + " b|c"] * 3
    want = [np.array(token_ids(t), "<u4").tobytes() for t in texts]
    assert list(packing._ids(texts, PATH, 1)) == want
    for name, value in (("_REMEMBERED", 4), ("_TEXTS", 2), ("_CALL", 2), ("_LONG", 3)):
        monkeypatch.setattr(packing, name, value)
    packing._workers.clear()
    assert list(packing._ids(texts, PATH, 1)) == want


@pytest.mark.parametrize("sent", [200_000, 0])
def test_pack_places_every_piece_once(make_docs, sent):
    rng = random.Random(5)
    items = [(i, " ".join(["word"] * rng.choice([0, 1, 5, 12, 31, 90]))) for i in range(300)]
    items += [(1, "word"), (1, "word"), (None, None)]
    docs = make_docs(items).withColumn("length", F.lit("x")).withColumn("_rank", F.lit(0))
    rows = packing.pack_documents(docs, PATH, capacity=32, step=4, sent=sent).collect()
    assert len(rows) == sum(-(-len(token_ids(t)) // 32) for _, t in items)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    assert packing.pack_documents(make_docs([]), PATH).count() == 0
