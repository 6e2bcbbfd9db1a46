"""Suffix-array dedup: removes every byte that a string of `length` bytes covers which also starts elsewhere.

Sparse suffixes. Of the start positions in each window of `length` bytes, the one whose `core` bytes have the
smallest hash is the window's anchor. Equal windows have the same anchor at the same offset, so only suffixes at anchors
(about one in 150 positions) are held against each other, and only those whose core occurs again. The
windows of an anchor stand next to each other; the bytes they span are the anchor's context.

1. Anchors are counted by core hash and by a 128-bit cryptographic digest of the context and the anchor's place in it.
   Contexts of one digest are the same bytes, and those that occur twice are repeated as they are.
2. The different contexts of a core are sorted as suffixes from the anchor on, and as reversed prefixes before it, by a
   bottom-up mergesort. Two are compared by their common extension, which a binary search over prefix polynomial hashes
   finds in logarithmic time. Walks from a suffix to its neighbours in that order give the partners that
   extend furthest to the left for each extension to the right; each match is verified byte by byte.
3. A core of more than `CROWDED` contexts is split: by ranges of offsets, each with a longer core (all bytes that the windows
   of the range have in common), in three rounds down to single windows. So no group is large and none is cut off."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prefix_hash, span_hash, text_blocks, written

#: Most contexts that are sorted together; which way a group takes doesn't change the result.
CROWDED = 256
#: Offsets a range is split into per round.
FAN = 7
_ROWS = 2048


def digest(context: bytes, place: int, low: int = 0) -> bytes:
    """128 bits that stand for a context, the anchor's place in it and, for a range of offsets, the least of them."""
    return hashlib.blake2b(context, digest_size=16, salt=place.to_bytes(8, "little") + low.to_bytes(8, "little")).digest()


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n, rows = len(v), -(-len(v) // width)
    x = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = v
    x = x.reshape(rows, width)
    before = np.minimum.accumulate(x, axis=1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(data: np.ndarray, at: np.ndarray, length: int, core: int) -> dict[str, np.ndarray]:
    """Of each anchor: its row, position in the row, bytes of context before (`left`) and from it on (`right`), and the hash of its core (h)."""
    names = ("row", "pos", "left", "right", "h")
    if len(data) < length:
        return {k: np.zeros(0, np.int64) for k in names}
    p = prefix_hash(data)
    start = np.arange(len(data) - core + 1)
    h = mix(span_hash(p, start, start + core))
    low = np.uint64((1 << 31) - 1)  # no text has more bytes
    least = _sliding_min((h & ~low) | start.astype(np.uint64), length - core + 1)  # of each window, by its start
    size = np.diff(at)
    whole = np.zeros(len(least) + 1, np.int8)  # windows that don't cross rows
    long = size >= length
    np.add.at(whole, at[:-1][long], 1)
    np.add.at(whole, np.minimum(at[1:][long] - length + 1, len(least)), -1)
    windows = np.flatnonzero(np.cumsum(whole)[:-1])
    spot = (least[windows] & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, (spot[1:] != spot[:-1]) | (windows[1:] != windows[:-1] + 1)))
    last = np.append(first[1:], len(spot)) - 1
    spot, begin, end = spot[first], windows[first], windows[last] + length
    row = np.searchsorted(at, spot, "right") - 1
    return {"row": row, "pos": spot - at[row], "left": spot - begin, "right": end - spot, "h": h[spot]}


class Suffixes:
    """Contexts of anchors, in groups that stand together, with common extensions by hash and binary search."""

    def __init__(self, contexts: list[bytes], left: np.ndarray, group: np.ndarray):
        self.raw = b"".join(contexts)
        self.data = np.frombuffer(self.raw, np.uint8)
        size = np.fromiter(map(len, contexts), np.int64, len(contexts))
        self.left, self.right = left.astype(np.int64), size - left
        self.at = np.cumsum(size) - size + self.left
        self.prefix = prefix_hash(self.data)
        self.first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.first, len(group)))
        self.group = np.repeat(np.arange(len(self.first)), self.size)

    def common(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """Bytes that i and j have in common from the anchor on, or before it."""
        room = self.right if forward else self.left
        low, high = np.zeros(len(i), np.int64), np.minimum(room[i], room[j])
        a, b = self.at[i], self.at[j]
        while len(low) and (low < high).any():
            mid = (low + high + 1) >> 1
            same = span_hash(self.prefix, a, a + mid) == span_hash(self.prefix, b, b + mid) if forward else span_hash(self.prefix, a - mid, a) == span_hash(self.prefix, b - mid, b)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, forward: bool, ties: np.ndarray) -> np.ndarray:
        """Whether i comes before j in the order of suffixes (or of reversed prefixes); `ties` where they are equal."""
        n, room = self.common(i, j, forward), self.right if forward else self.left
        end_i, end_j = n == room[i], n == room[j]
        byte = lambda k, end: self.data[np.where(end, 0, self.at[k] + n if forward else self.at[k] - 1 - n)]
        return np.where(end_i & end_j, ties, np.where(end_i, True, np.where(end_j, False, byte(i, end_i) < byte(j, end_j))))

    def sort(self, forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """The order within each group by a mergesort of all groups at once, and the bytes each has in common with the one before it in the order (-1: the first of its group)."""
        order, local = np.arange(len(self.at)), np.arange(len(self.at)) - np.repeat(self.first, self.size)
        base, total, width = np.repeat(self.first, self.size), np.repeat(self.size, self.size), 1
        while width < self.size.max(initial=0):
            run = local // width
            start = (run ^ 1) * width
            low = np.zeros(len(order), np.int64)
            high = np.clip(total - start, 0, width)
            live = np.flatnonzero(high > 0)
            while len(live):  # the place of each in the run next to its own
                mid = (low[live] + high[live]) >> 1
                other = order[base[live] + start[live] + mid]
                before = self.less(other, order[live], forward, run[live] % 2 == 1)  # of equals, those of the left run come first
                low[live], high[live] = np.where(before, mid + 1, low[live]), np.where(before, high[live], mid)
                live = live[low[live] < high[live]]
            merged = np.empty_like(order)
            merged[base + (run // 2) * 2 * width + local - run * width + low] = order
            order, width = merged, 2 * width
        same = np.full(len(order), -1)
        inner = np.flatnonzero(local > 0)
        same[inner] = self.common(order[inner - 1], order[inner], forward)
        return order, same

    def matches(self, length: int) -> Iterator[tuple[int, int, int]]:
        """(i, lowest and highest offset of the anchor in windows of i that another of its group has too), verified."""
        m = len(self.at)
        if not m:
            return
        order, same = self.sort(True)
        back, back_same = self.sort(False)
        next_same = lambda s: np.append(s[1:], -1)
        furthest, extent = np.empty(m, np.int64), np.empty(m, np.int64)
        furthest[back] = np.maximum(back_same, next_same(back_same))
        extent[order] = np.maximum(same, next_same(same))
        for step in (-1, 1):
            k = np.flatnonzero((furthest + extent >= length)[order])  # places in the order
            i, r, reach, place = order[k], np.full(len(k), 1 << 40), np.full(len(k), -1), k
            while len(i):
                edge = same[place] if step < 0 else next_same(same)[place]
                place = place + step
                r = np.minimum(r, edge)
                on = (edge >= 0) & (r + furthest[i] >= length)
                i, r, reach, place = i[on], r[on], reach[on], place[on]
                j = order[place]
                n = self.common(i, j, False)
                hit = (n > reach) & (n + r >= length)
                for a, b, x, y in zip(i[hit].tolist(), j[hit].tolist(), r[hit].tolist(), n[hit].tolist()):
                    yield from self.verified(a, b, length - x, y, length)
                reach = np.maximum(reach, n)
                on = reach < furthest[i]
                i, r, reach, place = i[on], r[on], reach[on], place[on]

    def verified(self, i: int, j: int, low: int, high: int, length: int) -> Iterator[tuple[int, int, int]]:
        a, b = int(self.at[i]), int(self.at[j])
        x, y = self.raw[a - high : a + length - low], self.raw[b - high : b + length - low]
        if x == y:
            yield i, low, high
            return
        n = r = 0  # a hash collision: the true extensions around the anchor
        while n < high and self.raw[a - 1 - n] == self.raw[b - 1 - n]:
            n += 1
        while r < length - low and self.raw[a + r] == self.raw[b + r]:
            r += 1
        if n + r >= length:
            yield i, length - r, n


def _sorted_matches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From (key, cls, n, lead, context) rows, all of a key together, (key, cls, low, high): offsets before the anchor, which stands `lead` bytes into the context."""
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> pa.RecordBatch:
        cols = {c: table.column(c).to_numpy() for c in ("key", "n", "lead")}
        s = Suffixes(table.column("context").to_pylist(), cols["lead"], cols["key"])
        out = [(i, lo, hi) for i, lo, hi in s.matches(length) if cols["n"][i] < 2]
        i, lo, hi = (np.array(x, np.int64) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
        cls = table.column("cls").combine_chunks().take(pa.array(i)).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(cols["key"][i]), cls, pa.array(lo), pa.array(hi)], ["key", "cls", "low", "high"])

    for whole in batches:
        for k in range(0, whole.num_rows, _ROWS):
            held.append(whole.slice(k, _ROWS))
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
            if cut:
                yield solve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield solve(pa.Table.from_batches(held))


def _split(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(h, c, low, high, lead, context) rows, one for each range of offsets below [low, high] that has windows in the context, with its own key and class."""
    names = ["h", "c", "low", "high", "lead", "context", "key", "cls"]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = []
            for h, c, low, high, lead, context in zip(*(part.column(k).to_pylist() for k in range(6))):
                anchor = lead + low  # `lead` is the place of offset `low`; that of the anchor itself
                step = -(-(high - low + 1) // FAN)
                for a in range(low, high + 1, step):
                    b = min(a + step - 1, high)
                    first, last = max(a, length - (len(context) - anchor)), min(b, anchor)
                    if first <= last:
                        x, y = max(0, anchor - b), min(len(context), anchor + length - a)
                        sub, core = context[x:y], context[anchor - a : anchor + length - b]
                        key = hashlib.blake2b(core + b"%d,%d" % (a, b), digest_size=8).digest()
                        rows.append((h, c, a, b, anchor - a - x, sub, int.from_bytes(key, "little", signed=True), digest(sub, anchor - a - x, a)))
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)


def _sizes(rows: DataFrame) -> DataFrame:
    """(key, cls, n, d): occurrences of each class, and classes of its key; only keys with two occurrences."""
    per_class = rows.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_class.groupBy("key").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("all")).where("all > 1").drop("all")
    return per_class.join(per_key, "key")


def _matched(distinct: DataFrame, length: int) -> DataFrame:
    dealt = distinct.select("key", "cls", "n", "lead", "context").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda b: _sorted_matches(b, length), "key long, cls binary, low long, high long")


def _crowded(rows: DataFrame, length: int) -> DataFrame:
    """(h, c, low, high) for contexts of crowded cores: offsets of the original anchor in repeated windows."""
    found = []
    while True:
        rows = written(rows.select("h", "c", "low", "high", "lead", "context").mapInArrow(lambda b: _split(b, length), "h long, c binary, low int, high int, lead int, context binary, key long, cls binary"))
        sizes = written(_sizes(rows))
        ends = rows.select("key", "cls", "h", "c", "low", F.greatest(F.col("low"), F.lit(length) - F.octet_length("context") + F.col("lead") + F.col("low")).alias("a"), F.least(F.col("high"), F.col("lead") + F.col("low")).alias("b"))
        found.append(ends.join(sizes.where("n > 1").select("key", "cls"), ["key", "cls"]).select("h", "c", F.col("a").cast("long").alias("low"), F.col("b").cast("long").alias("high")))
        few = sizes.where((F.col("d") > 1) & (F.col("d") <= CROWDED))
        distinct = rows.join(few, ["key", "cls"]).groupBy("key", "cls").agg(F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("context").alias("context"))
        met = _matched(distinct, length).withColumnsRenamed({"low": "nearest", "high": "furthest"})
        found.append(met.join(ends, ["key", "cls"]).select("h", "c", (F.col("nearest") + F.col("low")).alias("low"), (F.col("furthest") + F.col("low")).alias("high")))
        many = sizes.where(F.col("d") > CROWDED).select("key", "cls")
        if many.isEmpty():
            break
        rows = rows.join(many, ["key", "cls"])
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return written(out)


def packed(docs: DataFrame, text: str = "text", length: int = 400, core: int = 64) -> DataFrame:
    """(rid, doc_id, z, anchors): every row of `docs` under a number of its own, with its text compressed and its anchors, as a table."""
    fields = pa.struct([("h", pa.int64()), ("c", pa.binary()), ("pos", pa.int32()), ("left", pa.int32()), ("right", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, squeeze = TaskContext.get().partitionId() << 36, zstandard.ZstdCompressor(level=1).compress
        for rows, data, at in text_blocks(batches, "text", 1 << 19):
            raw, found = data.tobytes(), anchors(data, at, length, core)
            spot = at[found["row"]] + found["pos"]
            c = [digest(raw[a - x : a + y], x) for a, x, y in zip(spot.tolist(), found["left"].tolist(), found["right"].tolist())]
            values = [pa.array(found["h"].view(np.int64)), pa.array(c, pa.binary()), *(pa.array(found[k].astype(np.int32)) for k in ("pos", "left", "right"))]
            each = pa.ListArray.from_arrays(pa.array(np.searchsorted(found["row"], np.arange(rows.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays(values, fields=list(fields)))
            z = pa.array([squeeze(raw[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rid + np.arange(rows.num_rows)), rows.column(0), z, each], ["rid", "doc_id", "z", "anchors"])
            rid += rows.num_rows

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    # The numbers are read from the table ever after, so that they stay the same when a task runs again.
    return written(source.mapInArrow(find, "rid long, doc_id long, z binary, anchors array<struct<h:long,c:binary,pos:int,left:int,right:int>>"))


def repeated_spans(rows: DataFrame, length: int = 400, core: int = 64) -> DataFrame:
    """(rid, spans): for each of the `packed` rows that has any, the [start, end) byte ranges of repeated windows, which may overlap."""
    spots = rows.select("rid", F.inline("anchors"))
    per_context = spots.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), *(F.first(k).alias(k) for k in ("rid", "pos", "left", "right")))
    per_core = per_context.groupBy("h").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("all")).where("all > 1").drop("all")
    known = written(per_context.join(per_core, "h"))
    as_they_are = known.where("n > 1").select("h", "c", (F.lit(length) - F.col("right")).cast("long").alias("low"), F.col("left").cast("long").alias("high"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part, out = b.slice(k, 64), []
                for z, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = unpack(z)
                    out += [(w["h"], w["c"], w["n"], w["d"], w["left"], raw[w["pos"] - w["left"] : w["pos"] + w["right"]]) for w in wanted]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names)

    kinds, names = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()], ["h", "c", "n", "d", "lead", "context"]
    fields = ("h", "c", "n", "d", "pos", "left", "right")
    wanted = known.where("d > 1").groupBy("rid").agg(F.collect_list(F.struct(*fields)).alias("wanted"))  # of a document's own anchors
    contexts = written(rows.join(wanted, "rid").select("z", "wanted").mapInArrow(cut, "h long, c binary, n long, d long, lead int, context binary"))
    few = contexts.where(F.col("d") <= CROWDED).select(F.col("h").alias("key"), F.col("c").alias("cls"), "n", "lead", "context")
    sorted_out = _matched(few, length).select(F.col("key").alias("h"), F.col("cls").alias("c"), "low", "high")
    covered = as_they_are.unionByName(sorted_out)
    many = contexts.where(F.col("d") > CROWDED)
    if not many.isEmpty():
        start = many.select("h", "c", F.lit(0).alias("low"), F.lit(length - core).alias("high"), "lead", "context")
        covered = covered.unionByName(_crowded(start, length))
    covered = written(covered)
    met = spots.select("h", "c", "rid", "pos").join(covered, ["h", "c"])
    return met.groupBy("rid").agg(F.collect_set(F.struct((F.col("pos") - F.col("high")).cast("int").alias("start"), (F.col("pos") - F.col("low") + length).cast("int").alias("end"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one each, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, text: str = "text", length: int = 400, core: int = 64) -> DataFrame:
    """(doc_id, n_bytes, spans, kept binary) per row of `docs`: the maximal runs of bytes [start, end) covered by a string of `length` bytes that starts at two places or more of the corpus, and the other bytes joined.

    Matches don't cross rows; strings are judged on the input, so of two copies both lose the bytes. A null text is
    empty. Rows with a null doc_id, rows that share one and repeated rows are documents like any other, each judged by itself; a repeated row is a copy.
    Columns besides doc_id and the text are not read. An empty table gives an empty result."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                out = []
                for z, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw, runs, at, kept = unpack(z), merged([(s["start"], s["end"]) for s in spans or []]), 0, []
                    for x, y in runs:
                        kept.append(raw[at:x])
                        at = y
                    out.append((len(raw), [{"start": x, "end": y} for x, y in runs], b"".join([*kept, raw[at:]])))
                kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "spans", "kept"])

    source = packed(docs, text, length, core)
    rows = source.join(repeated_spans(source, length, core), "rid", "left").select("doc_id", "z", "spans")
    return rows.mapInArrow(apply, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
