import random

import pytest

from strandgraph.llm import suffix_dedup


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            count[t[s : s + length]] = count.get(t[s : s + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = [k for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((i, len(t), len(spans), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    return sorted([(r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in suffix_dedup.dedup(df, **k).collect()], key=str)


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = text(12), text(60)
    rows = [(None, None), (1, ""), (2, "aaaa " * 60), (3, base), (3, base), (3, base + " x"), (4, "z" * 300)]
    rows += [(k, text(r.randint(0, 50)) + passage + text(r.randint(0, 50))) for k in range(10, 30)]
    for k in range(30, 50):
        w = base.split(" ")
        w[r.randrange(len(w))] = text(1)
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("crowded", [256, 3])
def test_against_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rows = corpus(crowded)
    assert run(spark, rows, length=40, core=8) == brute(rows, 40)


def test_rows_without_an_id_and_rows_that_share_one(spark):
    r = random.Random(4)
    text = lambda: "".join(r.choice("abcdefgh ") for _ in range(120))
    base = text()
    rows = [(None, base), (None, text()), (None, text() + base[:60]), (5, text()), (5, base[20:] + text()), (5, text()), (5, text()), (None, None), (6, "é" * 50), (7, "é" * 50)]
    assert run(spark, rows, length=40, core=8) == brute(rows, 40)


def test_empty(spark):
    assert run(spark, []) == []


def test_collisions_are_verified():
    import numpy as np

    s = suffix_dedup.Suffixes([b"xabcdef", b"yabcdeg"], np.array([1, 1]), np.array([5, 5]))
    assert list(s.verified(0, 1, 0, 1, 6)) == []
    assert list(s.verified(0, 1, 0, 1, 5)) == [(0, 0, 0)]
