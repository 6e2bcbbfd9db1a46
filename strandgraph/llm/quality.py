"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from the text alone. Trees are grown level by level on histograms of at most 64 bins, as
complete binary trees flattened into arrays, so that scoring is a few numpy gathers for a whole batch."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"!*#$%&|.,;:?-_/\\<>(){}[]=+@~^\"'`"
N_FEATURES = 22 + len(SYMBOLS)


def statistics(text: bytes) -> list[float]:
    """The features of one whole text; all zero for an empty one."""
    if not text:
        return [0.0] * N_FEATURES
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    p = count[count > 0] / n
    upper, small, digit = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    symbols = count[list(SYMBOLS)]
    w = text.split()
    nw = max(1, len(w))
    lengths = np.fromiter(map(len, w), np.int64, len(w)) if w else np.zeros(1, np.int64)
    seen = Counter(w)
    pairs = len(set(zip(w, w[1:])))
    repeats = sum(map(bytes.__eq__, w, w[1:])) if len(w) > 1 else 0
    lines = [x for x in text.split(b"\n") if x.strip()] or [b""]
    ends = Counter(x[-1:] for x in lines)
    return [
        math.log1p(n), math.log1p(len(w)), math.log1p(len(lines)), upper / n, small / n, digit / n, upper / max(1, upper + small),
        int(count[128:].sum()) / n, int(count[:32].sum()) / n, int(symbols.sum()) / n, int((symbols > 0).sum()), -float((p * np.log2(p)).sum()),
        float(lengths.mean()), float(lengths.std()), int(lengths.max()), len(seen) / nw, max(seen.values(), default=0) / nw, pairs / nw, repeats / nw,
        len(set(lines)) / len(lines), n / len(lines), (ends[b"."] + ends[b"!"] + ends[b"?"]) / len(lines), *(symbols / n).tolist(),
    ]


@dataclass
class Trees:
    """Complete trees of one depth as arrays: node k has the children 2k+1 and 2k+2, leaves follow the inner nodes."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        out, inner = np.full(len(x), self.base), self.feature.shape[1]
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            k = np.zeros(len(x), np.int64)
            while len(k) and k[0] < inner:
                k = 2 * k + 1 + (x[rows, f[k]] > t[k])
            out += v[k - inner]
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: float = 1.0) -> Trees:
    """Boosting of the logistic loss. Without rows of both labels, trees are empty and the score is the smoothed share of label 1."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    rate0 = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate0 / (1 - rate0)))
    if len(y) < 2 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    nf = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(nf)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # bin b: cuts[b-1] < x <= cuts[b]
    column = np.arange(nf) * bins
    out, f_all, t_all, v_all = np.full(len(y), base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            key = ((node - first)[:, None] * (nf * bins) + column + binned).ravel()
            sums = [np.bincount(key, np.repeat(v, nf), width * nf * bins).reshape(width, nf, bins).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (gt, ht) = sums, (s[:, :1, -1:] for s in sums)
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        value = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + penalty)
        out += value[at]
        f_all.append(feature), t_all.append(threshold), v_all.append(value)
    return Trees(base, np.array(f_all), np.array(t_all), np.array(v_all))


def learning_rows(labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, y) of at most `bound` labelled rows that may be learned from, by the order of a hash; rows with a null are left out, of repeated ids the highest label counts."""
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", bound: int = 8000) -> Trees:
    """Fits the trees on at most `bound` labelled rows. Only their statistics, at most bound x N_FEATURES doubles, reach the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = F.broadcast(learning_rows(labels, bound))  # two numbers a row, `bound` rows at most
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(rows, "doc_id").select("doc_id", "y", "text")
    table = picked.mapInArrow(scan, "doc_id long, y double, x array<double>").orderBy("doc_id", "x").limit(bound).toPandas()
    x = np.array(table.x.tolist(), float).reshape(len(table), N_FEATURES)
    return fit(x, table.y.to_numpy(float))


def quality_scores(docs: DataFrame, model: Trees, text: str = "text", name: str = "quality_score") -> DataFrame:
    """`docs` with the score of each row, in (0, 1), as `name`. A null text counts as empty, and an empty text is scored like any other.

    Rows are neither dropped nor merged; a column that `name` names already is replaced. Only the text goes to Python."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.large_binary())], float)
        return pa.array(model.score(x.reshape(len(texts), N_FEATURES)), pa.float64())

    return docs.withColumn(name, score(F.col(text)))
