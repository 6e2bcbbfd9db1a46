import math
import random

import numpy as np

from strandgraph.llm import ann


def plain(a, b):
    total = 0.0
    for p, q in zip(a.tolist(), b.tolist()):
        total += (p - q) * (p - q)
    return math.sqrt(total)


def test_recall_and_distances(spark):
    r = np.random.default_rng(0)
    centre = r.normal(size=(6, 20))
    x = (centre[r.integers(0, 6, 3000)] + r.normal(size=(3000, 20)) * 0.6).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, score int")
    got = {}
    for row in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        assert all(s == plain(x[q], x[v]) for v, s in got[q]) and [s for _, s in got[q]] == sorted(s for _, s in got[q]) and len(got[q]) == 10
        hit += len({v for v, _ in got[q]} & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.97 * 300


def test_copies_ties_and_odd_rows(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(0, 900)] + [(k, [1.0, 2.0, 4.0 + k]) for k in range(900, 905)]
    rows += [(1000, None), (1001, [0.0, 0.0, 0.0]), (1002, [1.0, None, 2.0]), (1003, [math.nan, 1.0, 1.0]), (1004, [math.inf, 1.0, 1.0]), (1005, []), (1006, [1.0]), (None, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {100 * k for k in range(10)}
    first = list(range(11))
    for q, found in got.items():
        if q < 900:
            assert found == [(n + 1, v, 0.0) for n, v in enumerate([v for v in first if v != q][:10])]
    assert [v for _, v, _ in got[900]][:4] == [901, 902, 903, 904]


def test_vectors_that_share_an_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 3.0]), (0, [0.0, 3.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df).collect())
    far, near = math.sqrt(10), math.sqrt(2)
    assert got == sorted([(0, 1, 7, near), (0, 2, 0, far), (0, 1, 7, 2.0), (0, 2, 0, far)])


def test_plan_does_not_grow_with_the_queries(spark):
    r = np.random.default_rng(6)
    sizes = []
    for n in (100, 5000):
        df = spark.createDataFrame([(k, r.normal(size=4).tolist()) for k in range(n)], "vec_id long, embedding array<double>")
        index, books = ann.build_index(df)
        sizes.append(str(ann.search(index, books, df, 2, block=50)._jdf.queryExecution().optimizedPlan()).count("\n"))
    assert sizes[0] == sizes[1]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(df).collect()] == [(0, 1, 7, math.sqrt(2))]
    assert ann.nearest(df.limit(0)).count() == 0


def test_blocks_of_queries(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(k, r.normal(size=5).tolist()) for k in range(300)], "vec_id long, embedding array<double>")
    index, books = ann.build_index(df)
    q = df.where("vec_id < 50")
    a, b = (sorted(map(tuple, ann.search(index, books, q, 3, block=n).collect())) for n in (7, 2048))
    assert a == b and len(a) == 150


def test_parallel_residuals_shrink():
    r = np.random.default_rng(2)
    x = ann._padded(r.normal(size=(2000, 16)))
    u = ann._unit(x)
    off = []
    for eta in (1.0, 8.0):
        books = ann.train(x, eta)
        codes = ann.encode(x, books, eta)
        y = books[np.arange(books.shape[0]), codes].reshape(len(x), -1)
        off.append(float((((x - y) * u).sum(axis=1) ** 2).mean()))
    assert off[1] < 0.6 * off[0]
