"""Approximate nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

The nearest by Euclidean distance are those of the largest q.x - |x|^2 / 2, a maximum inner product search with an exact
offset for each vector. Vectors are product-quantised to 16 centroids in each pair of dimensions under the
anisotropic loss: the part of the residual that is parallel to the vector, which moves large inner products
most, weighs `eta` times as much as the rest. A scan adds up, for each query, a table entry for
every two codes; the best of each block of rows are ranked anew by their true distances.

The codebooks are fitted on a bounded sample; the index holds every row. Index and queries are tables of blocks, a row each, and
every block of queries meets every block of the index, so neither plan nor driver grows with either; a task keeps the best of the
blocks of queries at hand only. Of equal vectors, only the k + 1 of the
smallest ids can be among anyone's k nearest, so only those are kept: exact for any number of copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SUB, CODES = 2, 16
#: Rows of a block of the index, and of a block of queries.
ROWS, QUERIES = 4096, 2048
#: Blocks of queries whose best a task keeps before it hands them on.
_HELD = 16


def _padded(x: np.ndarray) -> np.ndarray:
    """Columns of zeros up to a multiple of 2 * SUB, so that codes come in pairs."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % (2 * SUB))))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)


def encode(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """The codes (rows x subspaces) that a coordinate descent on the anisotropic loss finds from the nearest centroids on."""
    parts, unit = x.reshape(len(x), -1, SUB), _unit(x).reshape(len(x), -1, SUB)
    diff = parts[:, :, None, :] - books[None]  # rows x subspaces x codes x SUB
    plain, along = (diff**2).sum(axis=3), (diff * unit[:, :, None, :]).sum(axis=3)
    codes = plain.argmin(axis=2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
    for _ in range(sweeps):
        for m in range(parts.shape[1]):
            rest = total - along[rows, m, codes[:, m]]
            codes[:, m] = (plain[:, m] + (eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
            total = rest + along[rows, m, codes[:, m]]
    return codes.astype(np.uint8)


def train(sample: np.ndarray, eta: float, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Codebooks (subspaces x CODES x SUB): alternates encoding and the least-squares centroids of the anisotropic loss."""
    x = _padded(sample.astype(float))
    n, m = len(x), x.shape[1] // SUB
    if not n:
        return np.zeros((m, CODES, SUB))
    pick = np.random.default_rng(seed).permutation(n)[np.arange(CODES) % n]
    books = x[pick].reshape(CODES, m, SUB).transpose(1, 0, 2).copy()
    unit = _unit(x).reshape(n, m, SUB)
    for turn in range(rounds):
        codes = encode(x, books, 1.0 if turn < rounds // 2 else eta, 0 if turn < rounds // 2 else 1)
        weight = 0.0 if turn < rounds // 2 else eta - 1
        residual = x.reshape(n, m, SUB) - books[np.arange(m), codes]
        along = (residual * unit).sum(axis=2)
        total = along.sum(axis=1)
        for k in range(m):
            u, part = unit[:, k], x.reshape(n, m, SUB)[:, k]
            rest = total - along[:, k] + (u * part).sum(axis=1)  # along the vector, without this subspace's centroid
            for c in range(CODES):
                i = codes[:, k] == c
                if i.any():
                    a = i.sum() * np.eye(SUB) + weight * u[i].T @ u[i]
                    b = part[i].sum(axis=0) + weight * (u[i] * rest[i, None]).sum(axis=0)
                    books[k, c] = np.linalg.solve(a, b)
            moved = ((part - books[k, codes[:, k]]) * u).sum(axis=1)
            total += moved - along[:, k]
    return books


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the distinct rows with an id and a finite, nonzero vector of the most frequent length (the shortest of those)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (length["d"] if length else 0)).distinct()


def build_index(vectors: DataFrame, copies: int = 11, sample: int = 8192, threshold: float = 0.2) -> tuple[DataFrame, np.ndarray]:
    """The index, blocks (ids, x, codes) of the usable vectors with at most `copies` of each distinct one, and the codebooks.

    The books are fitted on at most `sample` vectors, by the order of a hash of the id. `threshold` is the cosine from which on
    scores matter: eta is (d - 1) t^2 / (1 - t^2), at least 1. Of equal vectors the smallest ids are kept."""
    rows = usable(vectors)
    same = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    rows = written(rows.withColumn("rank", F.row_number().over(same)).where(F.col("rank") <= copies).drop("rank"))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    data = np.asarray(picked.flatten()).reshape(len(picked), -1) if len(picked) else np.zeros((0, 1))
    eta = max(1.0, (data.shape[1] - 1) * threshold**2 / (1 - threshold**2))
    books = train(data, eta)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                x = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
                c = np.concatenate([encode(y, books, eta) for y in np.array_split(_padded(x), -(-len(x) // 2048))])
                values = (part.column(0).to_numpy().tobytes(), x.tobytes(), (c[:, 0::2] * 16 + c[:, 1::2]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["ids", "x", "codes"])

    return written(rows.mapInArrow(pack, "ids binary, x binary, codes binary")), books


def _tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """queries x pairs of subspaces x 256: the part of q.x that a byte of two codes stands for."""
    t = np.einsum("qms,mcs->qmc", _padded(q).reshape(len(q), -1, SUB), books)
    return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def _best(ids: np.ndarray, q: np.ndarray, vec_id: np.ndarray, x: np.ndarray, codes: np.ndarray, books: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest to each query among the rows of a block (infinite distances where there are fewer)."""
    half = ((x * x).sum(axis=1) / 2).astype(np.float32)
    take = min(len(vec_id), rerank)
    tables = _tables(q, books)
    score = np.repeat(-half[None], len(q), axis=0)
    for j in range(codes.shape[1]):
        score += tables[:, j][:, codes[:, j]]
    order = np.argsort(vec_id, kind="stable")
    own = order[np.minimum(np.searchsorted(vec_id[order], ids), len(order) - 1)]  # of one id, all stand next to each other
    for i in np.flatnonzero(vec_id[own] == ids):
        same = vec_id == ids[i]
        score[i, same & (x == q[i]).all(axis=1)] = -np.inf
    top = np.argpartition(-score, take - 1, axis=1)[:, :take]
    diff = x[top] - q[:, None, :]
    d = np.sqrt(np.cumsum(diff * diff, axis=2)[..., -1])  # added from the first component on, as a loop would
    i = vec_id[top]
    d[np.isneginf(np.take_along_axis(score, top, 1))] = np.inf
    order = np.lexsort((i, d), axis=1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)


def _scan(batches: Iterator[pa.RecordBatch], books: np.ndarray, k: int, rerank: int) -> Iterator[pa.RecordBatch]:
    """From pairs of a block of queries and a block of the index, the k nearest to each query among what the task has seen since it last handed them on."""
    held: dict[int, list[np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for number, (ids, d, i) in held.items():
            row, _ = np.nonzero(np.isfinite(d))
            found = np.isfinite(d)
            yield pa.RecordBatch.from_arrays([pa.array(number + row), pa.array(ids[row]), pa.array(i[found]), pa.array(d[found])], ["query", "query_id", "vec_id", "score"])
        held.clear()

    for batch in batches:
        for number, *row in zip(batch.column(0).to_pylist(), *(batch.column(c) for c in range(1, 6))):
            ids, q, vec_id, x, codes = (np.frombuffer(v.as_buffer(), t) for v, t in zip(row, (np.int64, np.float64, np.int64, np.float64, np.uint8)))
            q, x, codes = q.reshape(len(ids), -1), x.reshape(len(vec_id), -1), codes.reshape(len(vec_id), -1)
            if number not in held:
                if len(held) == _HELD:
                    yield from out()
                held[number] = [ids.copy(), np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)]
            _, best_d, best_i = held[number]
            for s in range(0, len(ids), 128):
                part = slice(s, s + 128)
                d, i = _best(ids[part], q[part], vec_id, x, codes, books, k, rerank)
                d, i = np.concatenate([best_d[part], d], axis=1), np.concatenate([best_i[part], i], axis=1)
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d[part], best_i[part] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
    yield from out()


def search(index: DataFrame, books: np.ndarray, queries: DataFrame, k: int = 10, rerank: int = 200, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each row of `queries` (vec_id, embedding), nearest first, ties to the smaller vec_id.

    score is the Euclidean distance in double precision. A row equal to the query in id and vector is no candidate. Of each block of
    the index (`ROWS` vectors), the `rerank` best by the tables are ranked by true distance: a share that is the same at every size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for whole in batches:
            for k in range(0, whole.num_rows, block):
                part = whole.slice(k, block)
                values = (part.column(0).to_numpy().tobytes(), np.asarray(part.column(1).flatten()).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([at]), *(pa.array([v], pa.binary()) for v in values)], ["query", "query_ids", "q"])
                at += part.num_rows

    asked = written(queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(pack, "query long, query_ids binary, q binary"))
    met = asked.crossJoin(index.select("ids", "x", "codes")).mapInArrow(lambda b: _scan(b, books, k, rerank), "query long, query_id long, vec_id long, score double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """`search` for the rows whose vec_id is divisible by `every`, against all.

    Rows without an id, or with a vector that is null, empty, zero, not finite or not of the most frequent length, take no
    part; a repeated row counts once; rows of one id with different vectors are queries and candidates each by itself.
    Other columns are not read. Without usable rows the result is empty."""
    index, books = build_index(vectors, k + 1)
    return search(index, books, usable(vectors).where(F.col("vec_id") % every == 0), k)
