import random
import re
import time

import pytest
import xxhash
from pyspark.sql import functions as F

from strandgraph.llm import decontam, line_dedup


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def text_key(t):
    return xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), 42) >> 63)


def brute(rows, least):
    """(doc_id, text_key, line_no, keep_doc_id, keep_line_no, edits) of each line that goes."""
    seen = sorted({((i is None, i or 0, text_key(t), n), x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if x.strip(" \t\n\v\f\r")})
    first = {}
    for at, x in seen:
        first.setdefault(x, at)
    out = set()
    for at, x in seen:
        before = [p for y, p in first.items() if y != x and min(len(x), len(y)) >= least and near(x, y) and p < first[x]]
        keep = min(before) if before else first[x]
        if at > keep:
            out.add((None if at[0] else at[1], at[2], at[3], None if keep[0] else keep[1], keep[3], int(bool(before))))
    return out


def left_over(rows, gone):
    """The rows without the lines that go, as (doc_id, text)."""
    drop = {x[:3] for x in gone}
    return [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, text_key(t), n) not in drop)) for i, t in rows]


def test_lines_against_brute_force(spark):
    r = random.Random(8)
    base = ["".join(r.choice("ab é") for _ in range(r.randint(18, 40))) for _ in range(12)]

    def line():
        x = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            k = r.randrange(len(x))
            x[k : k + 1] = r.choice([[], ["z"], [x[k], "y"], [x[k], x[k]]])
        return "".join(x)

    rows = [(k, "\n".join(line() for _ in range(r.randint(0, 6)))) for k in range(60)] + [(None, base[0]), (70, None), (71, ""), (72, "\n\n"), (3, "short"), (73, "x" * 90_000), (74, "x" * 89_999)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, line_no string")
    gone = line_dedup.repeated_lines(df)
    got = {tuple(x) for x in gone.collect()}
    assert got == brute(rows, 20) and any(x[4] for x in got)
    left = line_dedup.without_lines(df, gone).collect()
    assert sorted(str((x["doc_id"], x["text"])) for x in left) == sorted(map(str, left_over(rows, got)))


def test_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a line that is long enough"), (1, "a line that is long enough"), (2, "a line that is long enough")], "doc_id long, text string")
    assert [r[0] for r in line_dedup.repeated_lines(df).collect()] == [2]
    assert line_dedup.repeated_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_rows_that_share_an_id_or_have_none(spark, parts):
    rows = [(1, "the first of the two texts\nwith a line more"), (1, "another text of the same id\nwhich has its own"), (None, "the first of the two textz\nok"), (None, "another text of the same jd\nok")]
    rows += [(2, "the first of the two text\nsomething else"), (3, "another text of the same i\nwhich has its own"), (3, "ok\n \n "), (4, "ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, F.rand(parts))
    gone = line_dedup.repeated_lines(df)
    got = {tuple(x) for x in gone.collect()}
    assert got == brute(rows, 20) and len(got) == 8
    left = line_dedup.without_lines(df, gone).collect()
    assert sorted(str((x["doc_id"], x["text"])) for x in left) == sorted(map(str, left_over(rows, got)))


def test_many_lines_take_linear_time(spark):
    text = "\n".join(f"line {k % 150_000} of a text with very many of them" for k in range(300_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    gone = spark.range(150_000, 300_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text_key(text)).alias("text_key"), F.col("id").cast("int").alias("line_no"))
    began = time.perf_counter()
    left = line_dedup.without_lines(df, gone).first()
    assert left["n_lines_removed"] == 150_000 and left["text"] == "\n".join(text.split("\n")[:150_000])
    assert time.perf_counter() - began < 30


def leaks(rows, items, window=13):
    tok = lambda s: re.findall("[a-z0-9\u0080-\U0010ffff]+", (s or "").lower())
    out = set()
    for i, t in rows:
        w = tok(t)
        for j, u in items:
            b = tok(u)
            n = min(window, len(b))
            allowed = decontam.tolerance(n, 0.8)
            if n >= 5 and any(sum(x != y for x, y in zip(w[p : p + n], b[q : q + n])) <= allowed for p in range(len(w) - n + 1) for q in range(len(b) - n + 1)):
                out.add((i, j))
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([4, 5, 9, 13, 20, 40])] + [(7, None), (None, "x"), (8, "")]
    rows = [(100, None), (101, ""), (102, "a " * 30_000)]
    for k in range(80):
        w = [word() for _ in range(r.randint(0, 30))]
        own = (r.choice(items[:6])[1] or "").split(" ")
        a = r.randrange(len(own))
        part = own[a:] if r.random() < 0.4 else own
        part = [word() if r.random() < r.choice([0, 0.1, 0.25]) else x.upper() for x in part]
        rows.append((k, " ".join(w) + ", " + "; ".join(part) + ". " + " ".join(w[::-1])))
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    want = leaks(rows, items)
    found = []
    for most in (1 << 20, 300):  # as an array, and as a table
        got = decontam.overlaps(df, bench, most_seeds=most).collect()
        assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want) > 20
        found.append(sorted(map(tuple, got)))
    assert found[0] == found[1]
    assert decontam.overlaps(df.limit(0), bench).count() == 0 and decontam.overlaps(df, bench.limit(0)).count() == 0


def test_repeated_tokens_and_rows(spark, monkeypatch):
    """A token that repeats in document and item meets itself on every diagonal; nothing is gathered at once."""
    monkeypatch.setattr(decontam, "_CHUNK", 500)
    rows = [(1, "la " * 3000), (1, "la " * 3000), (None, "so la " * 400), (2, "xy " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "la " * 60), (1, "la " * 60), (2, "so la " * 20)], "item_id long, text string")
    want = [(1, 1, 60, 0, 59, 0)] * 2 + [(None, 2, 40, 0, 39, 0)]
    for most in (1 << 20, 1):
        got = [tuple(r) for r in decontam.overlaps(df, bench, most_seeds=most).drop("text_key").collect()]
        assert {r[:3] for r in got} == {r[:3] for r in want} and len(got) == 3 and all(r[5] == 0 for r in got)
