import random
import re

import numpy as np

from strandgraph.llm import shingles


def brute(texts, n=5):
    out = []
    for t in texts:
        low = (t or "").translate({k: k + 32 for k in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    return out


def similar(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def groups(ids, held):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in zip(ids, held):
        for j, y in zip(ids, held):
            if i < j and similar(x, y):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: root(i) for i in ids}


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    some = lambda n: [word() for _ in range(n)]
    passage, hub = some(40), some(90)
    texts = [None, "", "\n ", "One two", "one TWO", "a b c d e", "A b c d e", "À b c d e f g h i", "x" * 9000, "q w e r t y u i o p " * 20]
    for k in range(60):  # near copies of different closeness
        w = some(r.randint(8, 150))
        texts.append(" ".join(w))
        for _ in range(r.randint(0, 2)):
            v = list(w)
            for _ in range(r.randint(1, 1 + len(v) // 25)):
                v[r.randrange(len(v))] = word()
            texts.append(" ".join(v))
    for k in range(50):  # a crowd of near copies, and one with a passage only in common
        v = list(hub)
        v[r.randrange(len(v))] = word()
        texts += [" ".join(v), " ".join([*some(r.randint(5, 60)), *passage, *some(r.randint(0, 9))])]
    return texts


def test_components_against_brute_force_jaccard(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(df).collect()}
    assert got == groups(range(len(texts)), brute(texts))


def test_crowds_alone(spark, monkeypatch):
    monkeypatch.setattr(shingles, "CROWDED", 1)  # all by parts
    monkeypatch.setattr(shingles, "_BLOCK", 7)  # and block by block
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(df).collect()}
    assert got == groups(range(len(texts)), brute(texts))


def test_similar_sets_share_a_part_key():
    r = np.random.default_rng(2)
    for size in [*range(4, 60), 200, 999]:
        for _ in range(30):
            x = r.integers(0, 1 << 63, size, dtype=np.uint64)
            out = int(r.integers(0, size // 5 + 1))
            more = r.integers(0, 1 << 63, max(0, (5 * (size - out)) // 4 - size), dtype=np.uint64)
            y = np.concatenate([x[out:], more])
            assert len(np.intersect1d(shingles.part_keys(np.unique(x)), shingles.part_keys(np.unique(y))))


def test_ranges_of_keys_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingles, "_ENTRIES", 50)  # many ranges; blocks come from many partitions
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(df).collect()}
    assert got == groups(range(len(texts)), brute(texts))


def test_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "p q r s"), (None, None), (5, "p q r s"), (5, "p q r s"), (4, "p q r s")], "doc_id long, text string")
    found = shingles.near_duplicates(df).collect()
    got = sorted(((r["doc_id"], r["component_id"]) for r in found), key=str)
    assert got == sorted([(None, 4), (None, None), (5, 4), (5, 4), (4, 4)], key=str)
    assert sorted(str(r["doc_id"]) for r in found if r["first"]) == ["4", "None"]
    assert shingles.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    r = random.Random(9)
    text = lambda: " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (2, b + " x"), (None, c), (None, a + " y"), (None, text()), (3, c + " z"), (3, text()), (3, text())]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found = shingles.near_duplicates(df).collect()
        first = sorted((str(r["doc_id"]), r["text_key"]) for r in found if r["first"])
        keys = {t: k for (_, t), k in zip(rows, [x["k"] for x in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("xxhash64(text) AS k").collect()])}
        assert first == sorted([("1", keys[a]), ("1", keys[b]), ("None", keys[rows[5][1]]), ("3", keys[c + " z"]), ("3", keys[rows[7][1]]), ("3", keys[rows[8][1]])])
