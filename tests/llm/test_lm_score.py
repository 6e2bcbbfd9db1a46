import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandgraph.llm import lm_score


def corpus(n):
    r = random.Random(4)
    tongues = [["".join(r.choice(a) for _ in range(r.randint(2, 6))) for _ in range(60)] for a in ("abcde", "vwxyz")]
    rows = [(k, " ".join(r.choice(tongues[k % 2]).title() for _ in range(r.randint(1, 90)))) for k in range(n)]
    return rows + [(n, ""), (n + 1, None), (n + 2, "\t\n "), (n + 3, "Unseen wörds " * 3), (None, "abc"), (0, rows[0][1]), (n + 4, "x" * 100_000)]


def test_base_and_model(spark):
    rows = corpus(300)
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = lm_score.lm_scores(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 1).collect()
    assert len(got) == len(rows)
    lower = str.maketrans({k: k + 32 for k in range(65, 91)})
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (i, _), ws, h in zip(rows, tokens, held)), key=str)
    assert sorted(((*(r[k] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")), round(r["base_score"], 6)) for r in got), key=str) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    out = [r for r in got if r["held_out"] and r["n_known"] == r["n_tokens"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all((r["bits_per_byte"] is None) == (r["doc_id"] in (300, 301)) for r in got)


def plain(symbols, leaf, before, weights, after=None):
    """The natural log of a sequence's symbols by plain loops; after(k, node) gives what went through a node of the word before and took bit 1 there, for the first bits."""
    counts = [[leaf[lo:hi].reshape(-1, 256)] for lo, hi in zip(lm_score._AT, lm_score._AT[1:])]

    def tree(row, node, depth):
        lo = (node << (8 - depth)) - 256
        n, half = row[lo : lo + (1 << (8 - depth))], 1 << (7 - depth)
        return n.sum(), n[half:].sum()

    fold = lambda x, y: ((x * 256 + y) * 0x9E3779B1 % (1 << 32)) >> 21
    stretch = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    own, moved, out, pending = np.zeros(256), np.zeros((8, lm_score.INPUTS)), [], ([], np.zeros((8, lm_score.INPUTS)))
    for t, symbol in enumerate(symbols):
        if t and t % lm_score.STEP == 0:
            for x in pending[0]:
                own[x] += 1
            moved = moved + pending[1] * lm_score.RATE / lm_score.STEP
            pending = ([], np.zeros((8, lm_score.INPUTS)))
        back = [symbols[t - k] if t >= k else before for k in range(1, 5)]
        rows = [counts[k][0][c] for k, c in enumerate([0, back[0], fold(back[0], back[1])])]
        total = 0.0
        for depth in range(8):
            node, bit = (1 << depth) | (symbol >> (8 - depth)), (symbol >> (7 - depth)) & 1
            n, ones = tree(rows[0], node, depth)
            base = (ones + 0.4) / (n + 0.8)
            x = [stretch(base)]
            for row in rows[1:]:
                n, ones = tree(row, node, depth)
                x.append(stretch((ones + lm_score.PRIOR * base) / (n + lm_score.PRIOR)))
            n, ones = tree(own, node, depth)
            x.append(stretch((ones + lm_score.PRIOR * base) / (n + lm_score.PRIOR)))
            if after and depth < lm_score.AFTER:
                n, ones = after(t, node, depth)
                x.append(stretch((ones + lm_score.LEAN * base) / (n + lm_score.LEAN)))
            else:
                x.append(0.0)
            x.append(1.0)
            w = weights[min(t // lm_score.STEP, 3), depth] + moved[depth]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, w))))
            total += math.log(p if bit else 1 - p)
            pending[1][depth] += (bit - p) * np.array(x)
        pending[0].append(symbol)
        out.append(total)
    return out


def test_score_against_plain_loops(spark):
    rows = corpus(60)
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    fitted = lm_score.fit(df, held_out)[1]
    lower = str.maketrans({k: k + 32 for k in range(65, 91)})
    split = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [""] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    vocabulary = sorted({w for ws in split for w in ws})
    raw = "".join(vocabulary).encode()
    size = np.array([len(w.encode()) for w in vocabulary])
    cls = dict(zip(vocabulary, lm_score.classes(lm_score._hashes(np.frombuffer(raw, np.uint8), np.cumsum(size) - size, np.cumsum(size))).tolist()))
    learned = [ws for ws, h in zip(split, held) if not h]
    c = Counter(w for ws in learned for w in ws)
    n, once = sum(c.values()), sum(x == 1 for x in c.values())
    assert fitted.unknown == min(0.5, (once + 1) / (n + 2))

    def table(sequences, before):
        leaf = np.zeros(lm_score._AT[-1], np.int64)
        for q in sequences:
            for w in lm_score.contexts(np.array(q), np.array([len(q)]), before):
                leaf += np.bincount(w + np.array(q), minlength=len(leaf))
        return leaf

    leaf = table([[cls[w] for w in ws] for ws in learned], lm_score._END_CLASS)
    spelled = table([[*w.encode(), 10] for w, x in c.items() if x == 1 and w], 10)
    follow = Counter((a, cls[b] >> 5) for ws in learned for a, b in zip(["", *ws], ws))
    mass = Counter()
    for w, x in c.items():
        mass[cls[w]] += x + 0.5
    want = {}
    for k, ((i, t), ws) in enumerate(zip(rows, split)):
        def after(at, node, depth, ws=ws):
            word = ws[at - 1] if at else ""
            each = [follow[word, x] for x in range(8) if (x | 8) >> (3 - depth) == node]
            each = [float(lm_score._long(lm_score._short(np.array([x])))[0]) for x in each]
            return sum(each), sum(each[len(each) // 2 :])

        parts = plain([cls[w] for w in ws], leaf, lm_score._END_CLASS, fitted.classes.weights, after)
        total = 0.0
        for w, x in zip(ws, parts):
            if c[w]:
                total += (x + math.log(1 - fitted.unknown) + math.log((c[w] + 0.5) / mass[cls[w]])) / math.log(10)
            else:
                total += (math.log(fitted.unknown) + sum(plain([*w.encode(), 10][:5000], spelled, 10, fitted.bytes.weights))) / math.log(10)
        if len(t or "") < 5000:
            want.setdefault(str(i), []).append((round(total, 2), t))
    got = {}
    for r in lm_score.lm_scores(df, held_out).collect():
        got.setdefault(str(r["doc_id"]), []).append(r)
        if r["bits_per_byte"] is not None:
            size = max(len((t or "").encode()) for i, t in rows if i == r["doc_id"])
            assert abs(r["bits_per_byte"] * size + r["score"] * math.log2(10)) < 1e-6 * size
    for i, each in want.items():
        assert all(abs(a["score"] - b) < 0.02 + 1e-4 * abs(b) for a, (b, _) in zip(sorted(got[i], key=lambda r: r["score"]), sorted(each)))


def test_a_long_unknown_word_costs_its_bytes(spark):
    rows = corpus(200) + [(5001, "zq"), (5002, "zq" * 2000)]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.lm_scores(df, F.col("doc_id") > 5000).collect()}
    assert got[5002]["score"] < got[5001]["score"] - 50 and got[5002]["bits_per_byte"] > 0.05


def test_scores_do_not_depend_on_the_layout(spark):
    rows = corpus(400)
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    one, many = (sorted(((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm_score.lm_scores(df.repartition(n, F.rand(n)), held_out).collect())) for n in (1, 7))
    assert [x[:2] for x in one] == [x[:2] for x in many]
    assert all(abs(x[2] - y[2]) < 1e-4 * max(1, abs(x[2])) for x, y in zip(one, many))


def table_of(sequences, before):
    symbols, count = np.concatenate(sequences), np.array([len(x) for x in sequences])
    leaf = np.zeros(lm_score._AT[-1], np.int64)
    for w in lm_score.contexts(symbols, count, before):
        leaf += np.bincount(w + symbols, minlength=len(leaf))
    return leaf


def test_class_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    model = lm_score.Model.of(table_of([r.integers(0, 256, 700), r.integers(0, 256, 40)], 3), 3)
    tree = np.zeros((1, 16), np.float32)
    tree[0, 8:] = r.integers(0, 3, 8)
    for width in (4, 2, 1):
        tree[:, width : 2 * width] = tree[:, 2 * width : 4 * width : 2] + tree[:, 2 * width + 1 : 4 * width : 2]
    before, total = r.integers(0, 256, 50), 0
    for c in range(256):  # the same past, every class next
        s = np.append(before, c)
        total += math.exp(model.scores(s, np.array([51]), model.after(tree, np.zeros(51, int), s, np.float32(0)))[-1])
    assert abs(total - 1) < 1e-3


def test_texts_are_scored_alike_in_any_company():
    r = np.random.default_rng(3)
    s = r.integers(0, 9, 300)
    model = lm_score.Model.of(table_of([s], 0), 0)
    alone = model.scores(s[:100], np.array([100]))
    both = model.scores(np.concatenate([s[100:290], s[:100]]), np.array([190, 100]))
    assert np.allclose(alone, both[190:], atol=1e-4)


def test_newton_step_lowers_the_loss():
    r = np.random.default_rng(5)
    s = np.cumsum(r.integers(0, 3, 3000)) % 256
    model = lm_score.Model.of(table_of([s], 0), 0)
    sums = np.zeros((4, 8, lm_score.INPUTS, lm_score.INPUTS + 1))
    before = model.scores(s, np.array([3000]), None, sums).sum()
    model.weights = lm_score.newton(sums).astype(np.float32)
    after = model.scores(s, np.array([3000]), None, np.zeros_like(sums)).sum()
    assert after > before + 100


def test_learning_leaves_out_the_symbol_itself():
    s = np.arange(90)  # nothing repeats, so nothing can be learned from what stands before
    leaf = table_of([s], 0)
    alone, counted, base = lm_score.paths(leaf, True), lm_score.paths(leaf), lm_score._stretch(lm_score.plain(leaf))
    for w in lm_score.contexts(s, np.array([90]), 0)[1:]:
        once = leaf.reshape(-1, 256)[w // 256].sum(axis=1) == 1
        assert once.sum() > 80
        assert np.allclose(alone[(w + s)[once]], base[s[once]], atol=1e-5) and (counted[(w + s)[once]] > base[s[once]]).any()


def test_no_rows_and_no_training(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm_score.lm_scores(df.limit(0), F.lit(False)).count() == 0
    r = lm_score.lm_scores(df, F.lit(True)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and math.isfinite(r["score"])


def test_short_counts():
    x = np.concatenate([np.arange(5000), 10 ** np.arange(4, 9)])
    back = lm_score._long(lm_score._short(x))
    assert (back[:16] == x[:16]).all() and (np.abs(back - x) <= 0.05 * x + 0.5).all()


def test_every_stretch_teaches_the_start_weights():
    r = np.random.default_rng(2)
    leaf = r.integers(0, 9, lm_score._AT[-1])
    model = lm_score.Model.of(leaf, lm_score._END_CLASS)
    symbols = r.integers(0, 256, 12 * lm_score.STEP)

    def taught(n):
        sums = np.zeros((4, 8, lm_score.INPUTS, lm_score.INPUTS + 1))
        model.scores(symbols[:n], np.array([n]), sums=sums)
        return sums

    sizes = [taught(k * lm_score.STEP)[..., -2].sum() for k in range(1, 13)]
    assert all(a != b for a, b in zip(sizes, sizes[1:]))
    both = np.zeros((4, 8, lm_score.INPUTS, lm_score.INPUTS + 1))
    model.scores(np.concatenate([symbols, symbols[:40]]), np.array([len(symbols), 40]), sums=both)
    assert np.allclose(both, taught(len(symbols)) + taught(40), rtol=1e-3, atol=1e-2)
