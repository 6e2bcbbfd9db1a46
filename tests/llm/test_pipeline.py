"""The stages of the pipeline, each held against brute force on what its predecessor kept."""

import random

import numpy as np

import corpus_pipeline as cp
from strandgraph.llm import quality
from tests.llm.test_lines_and_leaks import brute as line_brute
from tests.llm.test_lines_and_leaks import leaks, left_over, text_key
from tests.llm.test_shingles import brute as shingle_sets
from tests.llm.test_shingles import groups


def tables(spark, path):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(r.randint(6, 14))) + "." for _ in range(n))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(4)]
    docs, labels = [], []
    for k in range(240):
        t = text(r.randint(1, 6))
        junk = k % 5 == 4
        if junk:
            t = " ".join(x.upper() + "!!" for x in t.split())
        elif k % 11 == 0 and docs:
            t = next(d for d in reversed(docs) if not d[1].isupper())[1] + ("" if k % 2 else " extra")
        elif k % 13 == 0:
            t += "\n" + items[k % 4][1]
        docs.append((k, t, r.choice(["en", "de"]), f"src{r.choice([0, 0, 1, 12])}"))
        labels.append((k, int(not junk), 0))
    docs += [(300, None, None, None), (301, "", "en", "src0"), (302, "x" * 50_000, "en", "src3")]
    near = lambda t: " ".join(t.split()[1:]) + " and on"
    long = [d[1] for d in docs if d[1] and len(d[1].split()) > 50 and not d[1].isupper()]
    own = [text(6) for _ in range(4)]
    # Rows that share an id or have none: unlike ones, near copies, leaks, and equal ones.
    docs += [(None, own[0], "en", "src1"), (None, own[1], "en", "src1"), (None, near(long[0]), "en", "src1"), (None, own[2] + " " + items[1][1], "de", "src0")]
    docs += [(1, own[3], "de", "src0"), (1, near(long[1]), "de", "src0"), (1, items[2][1] + " " + text(5), "de", "src0"), (5, "the same text in all of the rows " * 9, "en", "src0"), (5, "the same text in all of the rows " * 9, "en", "src12")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return items


def held(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def order(row):
    return row[0] is None, row[0] or 0, text_key(row[1] or "")


def one_of_each(rows):
    top = groups(range(len(rows)), shingle_sets([t for _, t in rows]))
    members = {}
    for k, row in enumerate(rows):
        members.setdefault(top[k], []).append(row)
    return sorted((min(x, key=order) for x in members.values()), key=str)


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    items = tables(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [held(docs)]
    for n, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/stage{n}")
        docs = spark.read.parquet(f"{sf}/stage{n}")
        assert set(cp.COLUMNS) <= set(docs.columns)
        if n < 4:
            assert set(docs.columns) == set(cp.COLUMNS)
            assert docs.where("n_chars <> length(coalesce(text, ''))").count() == 0
        kept.append(held(docs))
    raw, good, lines, distinct, clean, mixed = kept
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    score = lambda t: model.score(np.array([quality.statistics((t or "").encode())]))[0]
    assert good == [r for r in raw if score(r[1]) >= 0.3] and 150 < len(good) < 210
    left = left_over(good, line_brute(good, 20))
    assert lines == sorted((b for a, b in zip(good, left) if a == b or b[1].strip()), key=str) and lines != good
    assert distinct == one_of_each(lines) and len(distinct) < len(lines)
    bad = [r for r in distinct if leaks([(0, r[1])], items)]
    assert clean == [r for r in distinct if r not in bad] and len(bad) > 3
    assert {None, 1} <= {r[0] for r in clean} and {None, 1} <= {r[0] for r in bad}
    assert set(mixed) <= set(clean)
    total = sum(len((t or "").split()) for _, t in clean)
    took = sum(r["n_tokens"] for r in docs.collect())
    assert 0.5 * total < took <= 0.6 * total + 1


def test_near_dedup_on_whole_rows(spark):
    """Rows of any id, before other stages have taken copies away."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(60)] for _ in range(6)]
    rows = []
    for k in range(60):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 9])):
            w[r.randrange(60)] = word()
        rows.append((r.choice([None, None, 1, 2, k]), " ".join(w)))
    rows += [rows[0], rows[5], (None, None), (None, ""), (9, "")]
    for parts in (1, 4):
        df = spark.createDataFrame([(*x, "en", "s", len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
        got = held(cp.distinct(spark, df, ""))
        assert [(i, t or "") for i, t in got] == [(i, t or "") for i, t in one_of_each(rows)]


def test_run(spark, tmp_path):
    tables(spark, str(tmp_path))
    assert cp.run(spark, str(tmp_path)).count() > 50


def test_near_dedup_by_fingerprints(spark):
    """What the operator of op6 links is one group, also where the shingles alone would leave it apart."""
    from strandgraph.llm import shingles, simhash

    r = random.Random(9)
    unit = [" ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(9)) for _ in range(3)]
    # A passage said over and over decides the fingerprint; what follows it once are many shingles of their own.
    rows = [(k, " ".join([unit[k % 3]] * 200 + ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(12)])) for k in range(9)]
    df = spark.createDataFrame([(*x, "en", "s", len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {x["component_id"] for x in simhash.near_duplicates(df).collect()}
    assert want == {0, 1, 2} and {x["component_id"] for x in shingles.near_duplicates(df).collect()} == set(range(9))
    assert {i for i, _ in held(cp.distinct(spark, df, ""))} == want
