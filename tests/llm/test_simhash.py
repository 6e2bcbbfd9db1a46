import random
import re

import xxhash

from strandgraph.llm import simhash
from strandgraph.llm.components import connected_components


def brute(texts):
    fps = []
    for t in texts:
        low = (t or "").translate({k: k + 32 for k in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return fps


def groups(ids, fps):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in zip(ids, fps):
        for b, y in zip(ids, fps):
            if (x ^ y).bit_count() <= 2:
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: root(i) for i in ids}


def test_texts(spark):
    texts = ["One two  three\tfour", "one two three four", "", None, "a", "a b", "\n ", "ÀB c d " * 40, "x" * 9000, "q w e r t y u i o p " * 20]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, component_id int")
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    want = brute(texts)
    assert [got[k][0] for k in range(len(texts))] == want
    assert {k: v[1] for k, v in got.items()} == groups(range(len(texts)), want)


def test_links_of_crowded_cells(spark):
    r = random.Random(3)
    near = r.getrandbits(64)
    fps = {near}
    while len(fps) < 300:  # a crowd around one fingerprint, chains, and strangers
        fps.add(r.choice(sorted(fps)) ^ (1 << r.randrange(64)) ^ (r.getrandbits(1) << r.randrange(64)) if len(fps) < 220 else r.getrandbits(64))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, node long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.links(rows)).collect()}
    want = groups(range(len(fps)), fps)
    assert {k: got.get(k, k) for k in want} == want


def test_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "p q r s"), (None, None), (5, "p q r s"), (5, "p q r s"), (4, "p q r s")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4), (None, None), (5, 4), (5, 4), (4, 4)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 201), (201, 200), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(101)}, 200: 200, 201: 200}


def test_no_broadcasts(spark):
    """The driver holds no side of a join, however small its file."""
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdef") for _ in range(r.randint(3, 9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")  # any broadcast fails
    try:
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == groups(range(300), brute(texts))
