"""Benchmark decontamination by spaced-seed hashing.

A window of WINDOW tokens is cut into tolerance + 3 blocks; each mask looks at three of them and ignores the
positions of the others. As `tolerance` substitutions touch at most so many blocks, three stay whole, and some
mask meets every window pair within the tolerance: none is missed. Hits are verified token by token.

A benchmark of at most `most_seeds` seeds comes to the executors as a sorted array with a bitmap before it, so training
text is never shuffled. A larger one stays a table of seeds: its hashes set bits of a filter of bounded size, training windows
that the filter lets pass become rows, and the two tables are joined by seed. Neither plan nor driver grows with it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prefix_hash, span_hash, text_blocks, words, written

SCHEMA = "doc_id long, text_key long, item_id long, matched_tokens int, first_token int, last_token int, substitutions int"
_BITS = 22
#: Pairs of windows that are verified at once.
_CHUNK = 100_000


def tokens(data: np.ndarray, at: np.ndarray, ends: bool = False) -> tuple[np.ndarray, ...]:
    """Hash and row of each token (and its start and end): runs of ASCII letters, digits and bytes from 128 on, of lower-cased text."""
    solid = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    start, end = words(data, at, solid)
    out = mix(span_hash(prefix_hash(data), start, end)), np.searchsorted(at, start, "right") - 1
    return (*out, start, end) if ends else out


def tolerance(window: int, similarity: float) -> int:
    return window - math.ceil(similarity * window - 1e-9)


def seeds(hashes: np.ndarray, window: int, wrong: int) -> Iterator[np.ndarray]:
    """For each mask, the hash of every window's tokens at the mask's positions."""
    n = len(hashes) - window + 1
    blocks = wrong + 3 if window >= wrong + 3 and wrong else 1
    cut = [k * window // blocks for k in range(blocks + 1)]
    sums = []
    for a, b in zip(cut, cut[1:]):
        total = np.zeros(n, np.uint64)
        for o in range(a, b):
            total += hashes[o : o + n] * np.uint64(pow(0xD6E8FEB86659FD93, o + 1, 1 << 64))
        sums.append(total)
    for mask in combinations(range(blocks), min(3, blocks)):
        yield mix(reduce(np.add, (sums[k] for k in mask)) + np.uint64(sum(1 << k for k in mask) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class Index:
    """The seeds of a bounded number of benchmark items, lower-cased, by window length."""

    def __init__(self, items: list[tuple[int, str]], window: int, similarity: float, least: int):
        self.ids = np.array([i for i, _ in items], np.int64)
        hashed = []
        for _, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            hashed.append(tokens(raw, np.array([0, len(raw)]))[0])
        self.tokens = np.concatenate([*hashed, np.zeros(0, np.uint64)])
        at = np.concatenate([[0], np.cumsum([len(h) for h in hashed])]).astype(np.int64)
        self.by: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in sorted({min(window, len(h)) for h in hashed if len(h) >= least}):
            wrong = tolerance(size, similarity)
            key, item, where = [], [], []
            for k, h in enumerate(hashed):
                if min(window, len(h)) == size:
                    for s in seeds(h, size, wrong):
                        key.append(s), item.append(np.full(len(s), k)), where.append(at[k] + np.arange(len(s)))
            key, item, where = (np.concatenate(x) for x in (key, item, where))
            order = np.argsort(key, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[key >> np.uint64(64 - _BITS)] = True
            self.by.append((size, wrong, key[order], item[order], where[order], bitmap))

    def hits(self, hashes: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """(first tokens of windows, items, diagonals, substitutions, window length) of verified overlaps."""
        for size, wrong, key, item, where, bitmap in self.by:
            if len(hashes) < size:
                continue
            whole = row[: len(row) - size + 1] == row[size - 1 :]
            for s in seeds(hashes, size, wrong):
                at = np.flatnonzero(bitmap[s >> np.uint64(64 - _BITS)] & whole)
                lo, hi = np.searchsorted(key, s[at], "left"), np.searchsorted(key, s[at], "right")
                some = hi > lo
                at, lo, upto = at[some], lo[some], np.cumsum((hi - lo)[some])
                for c in range(0, int(upto[-1]) if len(upto) else 0, _CHUNK):  # pairs c to c + _CHUNK, never all at once
                    pair = np.arange(c, min(c + _CHUNK, int(upto[-1])))
                    own = np.searchsorted(upto, pair, "right")
                    pc, kc = at[own], lo[own] + pair - np.where(own > 0, upto[own - 1], 0)
                    bad = (hashes[pc[:, None] + np.arange(size)] != self.tokens[where[kc][:, None] + np.arange(size)]).sum(axis=1)
                    ok = bad <= wrong
                    yield pc[ok], item[kc[ok]], pc[ok] - where[kc[ok]], bad[ok], size


def _runs(p: np.ndarray, size: int) -> tuple[int, int, int]:
    """How many tokens the windows that start at the sorted places p cover, the first and the last of them."""
    return size + int(np.minimum(np.diff(p), size).sum()), int(p[0]), int(p[-1]) + size - 1


def _scan(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """The overlaps of whole documents with the items of an index."""
    for rows, data, at in text_blocks(batches, "text"):
        hashes, row = tokens(data, at)
        begin = np.searchsorted(row, np.arange(rows.num_rows), "left")
        held: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.int64) for _ in range(5))]
        n = 0
        for p, item, diagonal, bad, size in index.hits(hashes, row):
            held.append((item, diagonal, p, bad, np.full(len(p), size)))
            n += len(p)
            if n > 10 * _CHUNK:  # masks find the same pairs anew
                held, n = [_once(held)], 0
        item, diagonal, p, bad, size = _once(held)
        first = np.flatnonzero(np.append(True, (row[p[1:]] != row[p[:-1]]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]))) if len(p) else np.zeros(0, np.int64)
        best: dict[tuple[int, int], tuple[int, ...]] = {}
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(p)]):
            got = (*_runs(p[a:b], int(size[a])), int(bad[a:b].min()))
            key = (int(row[p[a]]), int(item[a]))
            if key not in best or got[0] > best[key][0]:  # of equals, that of the least diagonal, which comes first
                best[key] = got
        if best:
            columns = [*([rows.column(c)[r].as_py() for r, _ in best] for c in (0, 1)), [int(index.ids[i]) for _, i in best]]
            columns += zip(*((m, x - int(begin[r]), y - int(begin[r]), b) for (r, _), (m, x, y, b) in best.items()))
            kinds = [*[pa.int64()] * 3, *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _once(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The distinct hits of all lists, by item, diagonal and place (and so by row within these)."""
    item, diagonal, p, bad, size = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((p, diagonal, item))
    item, diagonal, p, bad, size = (x[order] for x in (item, diagonal, p, bad, size))
    new = np.append(True, (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (p[1:] != p[:-1]))[: len(p)]
    return item[new], diagonal[new], p[new], bad[new], size[new]


def _window_texts(data: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.ndarray, size: int) -> list[str]:
    raw = data.tobytes()
    return [" ".join(raw[a:b].decode() for a, b in zip(start[x : x + size].tolist(), end[x : x + size].tolist())) for x in p.tolist()]


def _item_seeds(batches: Iterator[pa.RecordBatch], window: int, similarity: float, least: int) -> Iterator[pa.RecordBatch]:
    """(item_id, item_key, size, q, seed, toks) for each mask and window of each item."""
    for rows, data, at in text_blocks(batches, "text", 1 << 18):
        hashes, row, start, end = tokens(data, at, True)
        for r in range(rows.num_rows):
            a, b = np.searchsorted(row, r, "left"), np.searchsorted(row, r, "right")
            if b - a < least:
                continue
            size = int(min(window, b - a))
            q = np.arange(b - a - size + 1)
            texts = _window_texts(data, start[a:b], end[a:b], q, size)
            for s in seeds(hashes[a:b], size, tolerance(size, similarity)):
                own = [rows.column(k).slice(r, 1).take(pa.array(np.zeros(len(q), np.int64))) for k in (0, 1)]
                values = [*own, pa.array(np.full(len(q), size, np.int32)), pa.array(q.astype(np.int32)), pa.array(s.view(np.int64)), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(values, ["item_id", "item_key", "size", "q", "seed", "toks"])


def _places(s: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of the filter that a seed sets, one after another."""
    for k in range(4):
        yield mix(s + np.uint64(k)) >> np.uint64(64 - bits)


def _filter(table: DataFrame, bits: int) -> np.ndarray:
    """The filter of all seeds of the table, 2**bits bits; only these reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(0).to_numpy().view(np.uint64)
            p = np.concatenate([x.astype(np.int64) for x in _places(s, bits)])
            yield pa.RecordBatch.from_arrays([pa.array(p >> 6), pa.array((np.uint64(1) << (p & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    words_ = table.select("seed").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words_.column(0).to_numpy()] = words_.column(1).to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _candidates(batches: Iterator[pa.RecordBatch], sizes: list[int], similarity: float, bloom: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, text_key, size, p, seed, toks) of each mask and window of whole documents that passes the filter."""
    rid = TaskContext.get().partitionId() << 40
    for rows, data, at in text_blocks(batches, "text"):
        hashes, row, start, end = tokens(data, at, True)
        begin = np.searchsorted(row, np.arange(rows.num_rows), "left")
        for size in sizes:
            if len(hashes) < size:
                continue
            whole = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
            for s in seeds(hashes, size, tolerance(size, similarity)):
                p = whole
                for k in range(4):
                    at_bits = mix(s[p] + np.uint64(k)) >> np.uint64(64 - bits)
                    p = p[(bloom[at_bits >> np.uint64(3)] >> (at_bits & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                for c in range(0, len(p), 20_000):
                    x = p[c : c + 20_000]
                    values = [pa.array(rid + row[x]), *(rows.column(k).take(pa.array(row[x])) for k in (0, 1)), pa.array(np.full(len(x), size, np.int32)), pa.array((x - begin[row[x]]).astype(np.int32)), pa.array(s[x].view(np.int64)), pa.array(_window_texts(data, start, end, x, size), pa.string())]
                    yield pa.RecordBatch.from_arrays(values, ["rid", "doc_id", "text_key", "size", "p", "seed", "toks"])
        rid += rows.num_rows


def _joined(source: DataFrame, items: DataFrame, window: int, similarity: float, least: int) -> DataFrame:
    """The overlaps by a join of seeds; windows are verified on their tokens."""
    table = written(items.mapInArrow(lambda b: _item_seeds(b, window, similarity, least), "item_id long, item_key long, size int, q int, seed long, toks string"))
    known = {r["size"]: r["n"] for r in table.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` sizes
    bits = min(27, max(_BITS, math.ceil(math.log2(16 * sum(known.values()) + 1))))
    bloom = _filter(table, bits)
    rows = written(source.mapInArrow(lambda b: _candidates(b, sorted(known), similarity, bloom, bits), "rid long, doc_id long, text_key long, size int, p int, seed long, toks string"))
    bad = F.aggregate(F.zip_with(F.split("toks", " "), F.split("theirs", " "), lambda x, y: (x != y).cast("int")), F.lit(0), lambda x, y: x + y)
    met = rows.join(table.withColumnRenamed("toks", "theirs"), ["seed", "size"]).select("rid", "doc_id", "text_key", "item_id", "item_key", "size", "p", (F.col("p") - F.col("q")).alias("d"), bad.alias("bad"))
    allowed = F.element_at(F.array(*(F.lit(tolerance(n, similarity)) for n in range(1, window + 1))), F.col("size"))
    per = met.where(F.col("bad") <= allowed).groupBy("rid", "doc_id", "text_key", "item_id", "item_key", "size", "d").agg(F.array_sort(F.collect_set("p")).alias("p"), F.min("bad").alias("bad"))
    steps = F.zip_with(F.slice("p", F.lit(2), F.size("p")), F.slice("p", F.lit(1), F.size("p") - 1), lambda y, x: y - x)
    covered = F.col("size") + F.aggregate(F.transform(steps, lambda x: F.least(x, F.col("size"))), F.lit(0), lambda x, y: x + y)
    got = F.struct((-covered).alias("m"), "d", F.get("p", F.lit(0)).alias("first"), (F.get("p", F.size("p") - 1) + F.col("size") - 1).alias("last"), "bad")
    best = per.groupBy("rid", "doc_id", "text_key", "item_id", "item_key").agg(F.min(got).alias("b"))
    return best.select("doc_id", "text_key", "item_id", (-F.col("b.m")).alias("matched_tokens"), F.col("b.first").alias("first_token"), F.col("b.last").alias("last_token"), F.col("b.bad").alias("substitutions"))


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 13, similarity: float = 0.8, least: int = 5, most_seeds: int = 1 << 20) -> DataFrame:
    """One row per document and benchmark item that overlap: some window of `window` tokens of the item (all of it, if shorter) stands in the document with at most 1 - similarity of its tokens substituted.

    text_key is a hash of the document's text, which tells rows apart that share a doc_id or have none. matched_tokens counts the document's tokens within such windows on the best diagonal, first_token and
    last_token are their ends, substitutions the fewest in one window. Items of fewer than `least` tokens
    aren't searched, as so short a string stands in many documents by chance (1 searches them all); null items
    aren't either, and equal ones are one. A null or empty text overlaps nothing; rows with a null doc_id give rows
    with a null; repeated rows repeat. Columns besides doc_id and the text are not read."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.lower(text).alias("text"))
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_key"), F.lower("text").alias("text")).distinct()
    masks = math.comb(tolerance(window, similarity) + 3, 3)
    sizes = items.agg(F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit("[^a-z0-9\\x{80}-\\x{10FFFF}]+")) + 1).alias("tokens")).first()
    if (sizes["chars"] or 0) <= 32 * most_seeds and masks * (sizes["tokens"] or 0) <= most_seeds:  # both are bounded, so it may come to the driver
        index = Index(sorted((r["item_id"], r["text"]) for r in items.collect()), window, similarity, least)
        return source.mapInArrow(lambda b: _scan(b, index), SCHEMA)
    return _joined(source, items, window, similarity, least)
