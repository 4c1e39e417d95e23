import math

import numpy as np
from pyspark.sql import functions as F

from vigilog.llm import graph_search

DDL = "vec_id long, embedding array<double>, rank int, score string"


def search(vectors, **how):
    return graph_search.search(vectors, F.col("vec_id") % 100 == 0, **how)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 9, "s") for i, v in rows], DDL)


def brute(rows, k=10):
    out = {}
    for i, q in rows:
        if i % 100 == 0:
            out[i] = sorted((math.dist(q, v), j) for j, v in rows if j != i and len(v) == len(q))[:k]
    return out


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_small_shards_find_all(spark):
    """With a beam as wide as the shards nothing is missed, ties included."""
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-3, 4, (700, 4)).astype(float)) if v.any()]
    got = by_query(search(frame(spark, rows), shard_rows=60, beam=200))
    want = brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for _, j in got[q]] == [j for _, j in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]])


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in table.collect()]
    got = by_query(search(table))
    want = brute(rows)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    exact = dict(rows)
    assert all(abs(d - math.dist(exact[q], exact[j])) < 1e-12 for q in got for d, j in got[q])


def test_recall_of_one_large_graph():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64))
    graph = graph_search.Graph(x)
    q = rng.standard_normal((100, 64))
    found, _ = graph.nearest(q, 10, 96)
    true = np.argsort(((x[None] - q[:, None]) ** 2).sum(2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(true, found)]) >= 0.93


def test_every_vertex_is_reached():
    """Far clusters, lines and near copies: every vertex finds itself."""
    rng = np.random.default_rng(5)
    parts = [rng.standard_normal((200, 3)) * 1e-6 + c for c in ((0, 0, 0), (1e4, 0, 0), (0, 1e4, 1e4))]
    x = np.concatenate([*parts, np.stack([np.arange(300.0), np.zeros(300), np.zeros(300)], 1)])
    x = np.unique(x, axis=0)
    graph = graph_search.Graph(x, degree=6, beam=12)
    reached, front = {graph.start}, [graph.start]
    while front:
        front = [int(b) for a in front for b in graph.out[a] if b >= 0 and int(b) not in reached and not reached.add(int(b))]
    assert len(reached) == len(x)


def test_a_vector_of_very_many_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(1000 + i, [float(i), 3.0]) for i in range(50)]
    got = by_query(search(frame(spark, rows), shard_rows=16, beam=64))
    want = brute(rows)
    assert {q: [j for _, j in x] for q, x in got.items()} == {q: [j for _, j in x] for q, x in want.items()}
    assert [j for _, j in got[300]] == list(range(10)) and [j for _, j in got[0]] == list(range(1, 11))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [5.0, 5.0]), (8, [5.0, 5.0]), (9, [3.0, 3.0]), (9, [1.0, 0.0]),
            (100, [1.0, 2.0, 3.0]), (200, [1.0, 2.0, 4.0]), (300, [0.0, 0.0]), (400, [1e200, -1e200])]
    got = by_query(search(frame(spark, rows)))
    assert [j for _, j in got[0]] == [9, 1, 8, 400] and got[0][0][0] == 0.0
    assert [j for _, j in got[100]] == [200] and [j for _, j in got[200]] == [100]
    assert 300 not in got and len(got[400]) == 4
    empty = search(frame(spark, rows).limit(0))
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert search(frame(spark, [(0, [1.0])])).collect() == []
