import math
import random
import zlib

import numpy as np

from strandgraph.llm import quality


def corpus(n, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        good = r.random() < 0.7
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(r.randint(5, 60))]
        docs.append((k, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((k, int(good)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(400)
    odd = [(1000, ""), (1001, None), (1002, "x" * 200_000), (None, "a b c."), (0, docs[0][1])]
    frame = spark.createDataFrame([(i, t, 9.0) for i, t in docs + odd], "doc_id long, text string, quality_score double")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None), (0, 0)], "doc_id long, quality int")
    model = quality.train(frame, marks)
    rows = quality.quality_scores(frame, model).select("doc_id", "quality_score").collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r["quality_score"] <= 1 for r in rows)
    want = dict(labels)
    held = [(r["quality_score"] >= 0.3) == want[r["doc_id"]] for r in rows if r["doc_id"] in want and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean(held) > 0.97


def test_learns_only_from_allowed_rows(spark):
    docs, labels = corpus(60)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    ids = [r["doc_id"] for r in quality.learning_rows(marks, 20).collect()]
    assert len(ids) == 20 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    flipped = spark.createDataFrame([(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, q in labels], "doc_id long, quality int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = quality.train(frame, marks), quality.train(frame, flipped)
    x = np.array([quality.statistics(t.encode()) for _, t in docs])
    assert np.array_equal(a.score(x), b.score(x))


def test_no_labels_and_one_label(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_scores(frame, quality.train(frame, none)).collect()
    assert [r["quality_score"] for r in got] == [0.5, 0.5]
    assert quality.quality_scores(frame.limit(0), quality.train(frame.limit(0), none)).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r["quality_score"] > 0.5 for r in quality.quality_scores(frame, quality.train(frame, one)).collect())


def test_trees_are_walked_as_flattened():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, quality.N_FEATURES))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > -0.1)).astype(float)
    m = quality.fit(x, y, trees=20, depth=3)
    for row, s in zip(x[:40], m.score(x[:40])):
        total = m.base
        for f, t, v in zip(m.feature, m.threshold, m.leaf):
            k = 0
            while k < m.feature.shape[1]:
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += v[k - m.feature.shape[1]]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-12
    assert ((m.score(x) > 0.5) == y).mean() > 0.95


def plain_fit(x, y, trees, depth, rate, bins, penalty, least):
    """The same boosting by plain loops over rows, features and cuts: a list of trees, each a dict of node -> (feature, cut) and node -> value."""
    share = (sum(y) + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(x.shape[1])]
    out, grown = [base] * len(y), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-o)) for o in out]
        g, h = [a - b for a, b in zip(p, y)], [max(a * (1 - a), 1e-6) for a in p]
        at, split = [0] * len(y), {}
        for level in range(depth):
            for node in range((1 << level) - 1, (2 << level) - 1):
                rows = [i for i in range(len(y)) if at[i] == node]
                gt, ht = sum(g[i] for i in rows), sum(h[i] for i in rows)
                best = (1e-9, None)
                for j, cs in enumerate(cuts):
                    for c in cs:
                        left = [i for i in rows if x[i, j] <= c]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        if hl < least or ht - hl < least:
                            continue
                        gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                        if gain > best[0] + 1e-12:
                            best = (gain, (j, c))
                split[node] = best[1]
                for i in rows:
                    at[i] = 2 * node + 1 + int(best[1] is not None and x[i, best[1][0]] > best[1][1])
        value = {}
        for leaf in set(at):
            rows = [i for i in range(len(y)) if at[i] == leaf]
            value[leaf] = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + penalty)
        out = [o + value[k] for o, k in zip(out, at)]
        grown.append((split, value))
    return [1 / (1 + math.exp(-o)) for o in out]


def test_fit_against_plain_loops():
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(90, 4)), 2)
    y = (x[:, 1] + 0.5 * x[:, 2] ** 2 + r.normal(size=90) * 0.3 > 0.4).astype(float)
    model = quality.fit(x, y, 6, 3, 0.2, 16, 1.0, 1.0)
    assert np.allclose(model.score(x), plain_fit(x, y, 6, 3, 0.2, 16, 1.0, 1.0), atol=1e-9)
