"""Near-duplicates by Jaccard similarity of word shingles, 0.8 or more: an exact set-similarity join.

A document is the set of the 64-bit hashes of its shingles, in the order of the hashes. Of sets with a similarity of 0.8, at most
d = size // 5 members of either are missing from the other. Equal sets are one node from the start.

1. Of each set, the first 2 (d + 1) members are its keys. They are counted in packed form: blocks of documents hand their distinct
   keys to ranges of hashes, and get back for each whether others have it too, and whether more than CROWDED do (a passage
   that many documents share, say).
2. A set goes by its keys up to the one at which d + 1 of them aren't crowded, or by all, and of these the uncrowded ones that
   others have become rows. Two similar sets that both have d + 1 such keys share one: take the set whose keys end first; one of
   its d + 1 is in the other, before that one's end. If either has fewer, they share an uncrowded key or else d + 2 crowded ones; a
   set that has so many (0.8 d + 1, as sizes differ) gives its crowded keys too.
3. Of each key, the others are held against one of its sets, chosen by a hash, a few times over. Most groups are joined by
   this, with as many pairs as there are sets.
4. The sets of a key that are still in several components are held against each other by their bitmaps where few have the key, in
   blocks, and only pairs that may be similar are handed on. Those of one that many have are dealt out anew by parts: members fall into m parts by hash, and as two similar
   sets differ in at most size // 4 members, at least m - size // 4 parts are equal; a set with so many empty parts that these
   could be all of them gives its empty parts as keys too. These keys take step 3 likewise, and what is left is held against each other.

Every link is verified on the texts, if the sets' bitmaps allow it: members set one of BITS bits each, so two sets differ
in at least as many members as their bitmaps in bits. Texts travel compressed, which is less than their sets would be."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower, mix, prefix_hash, span_hash, text_blocks, words, written
from .components import connected_components

#: A key of more sets is split by parts; which way a key takes doesn't change the components.
CROWDED = 32
BITS = 1024
_ROUNDS = 2  # sets that the others of a key are held against before pairs are made
_ENTRIES = 200_000  # distinct keys of blocks in one range of hashes
_CUT = np.uint64(16)
_BLOCK = 2048  # sets that are held against each other at once
_FEW = 500_000  # rows of ids that are broadcast at most, after they have been counted
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PART = np.uint64(0xD6E8FEB86659FD93)
_EDGES = [4]
while _EDGES[-1] < 1 << 40:
    _EDGES.append(_EDGES[-1] * 5 // 4 + 1)


def sets(data: np.ndarray, at: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted shingle hashes of each row; of fewer than n words all make one, none without words. A-Z count as lower case."""
    data = lower(data)
    start, end = words(data, at)
    h = mix(span_hash(prefix_hash(data), start, end) + np.uint64(1))
    count = np.bincount(np.searchsorted(at, start, "right") - 1, minlength=len(at) - 1)
    first = np.cumsum(count) - count
    whole = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        whole = mix(whole * _ODD + h[k : k + len(whole)])
    out = []
    for f, c in zip(first.tolist(), count.tolist()):
        if c >= n:
            out.append(np.unique(whole[f : f + c - n + 1]))
        else:
            one = np.full(min(c, 1), c, np.uint64)
            for k in range(c):
                one = mix(one * _ODD + h[f + k])
            out.append(one)
    return out


def _node(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def _bitmap(s: np.ndarray) -> bytes:
    out = np.zeros(BITS, np.uint8)
    out[s % np.uint64(BITS)] = 1
    return np.packbits(out).tobytes()


_ROWS = "doc_id long, text_key long, node long, size long, bits binary, block long, n_keys long, packed array<binary>"


def _pack(keys: np.ndarray) -> bytes:
    """Keys of 48 bits: that two shingles may share one only adds rows, which are verified."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _scan(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one (with `block`) for each few MB of them: nodes, their sizes and numbers of keys, and the keys."""
    block = TaskContext.get().partitionId() << 32
    names = [x.split()[0] for x in _ROWS.split(", ")]
    kinds = [*[pa.int64()] * 4, pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
    for rows, data, at in text_blocks(batches, "text", 4 << 20):
        found = sets(data, at, n)
        node, size = np.array([_node(s) for s in found], np.int64), np.array([len(s) for s in found], np.int64)
        none = [None] * len(found)
        values = [rows.column(0), rows.column(1), pa.array(node), pa.array(size), pa.array([_bitmap(s) for s in found], pa.binary()), *(pa.array(none, k) for k in kinds[5:])]
        yield pa.RecordBatch.from_arrays(values, names)
        one = np.unique(node, return_index=True)[1]
        keys = [found[k][: 2 * (len(found[k]) // 5 + 1)] >> _CUT for k in one]
        many = np.array([len(k) for k in keys], np.int64)
        keys = np.concatenate(keys)
        packed = [*(x.tobytes() for x in (node[one], size[one], many)), _pack(keys)]
        values = [*[None] * 5, block, len(np.unique(keys)), packed]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)
        block += 1


def _by_range(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys by range, where each range of them ends, for each key its place among these, and how often each occurs."""
    own, place, often = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.argsort(own % np.uint64(ranges), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return own[order], np.searchsorted(own[order] % np.uint64(ranges), np.arange(ranges + 1)), rank[place], often[order]


def _dealt(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, packed in zip(b.column(0), b.column(1)):
            own, cut, _, often = _by_range(_unpack(packed[3].as_py()), ranges)
            often = np.minimum(often, CROWDED + 1).astype(np.uint8)
            rows = [(k, block.as_py(), _pack(own[cut[k] : cut[k + 1]]), zstandard.compress(often[cut[k] : cut[k + 1]].tobytes())) for k in np.flatnonzero(np.diff(cut)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["range", "block", "keys", "often"])


def _flagged(table: pa.Table) -> pa.Table:
    """For each block and each of its keys in this range, two bits: whether it occurs again, there or in another block, and whether it is crowded."""
    slices = [_unpack(x) for x in table.column("keys").to_pylist()]
    often = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint8) for x in table.column("often").to_pylist()])
    known, place = np.unique(np.concatenate(slices), return_inverse=True)
    total = np.bincount(place, often)[place]
    at = np.cumsum([0, *map(len, slices)])
    flags = [np.packbits(np.stack([total[a:b] > 1, total[a:b] > CROWDED])).tobytes() for a, b in zip(at, at[1:])]
    return pa.table({"block": table.column("block"), "range": table.column("range"), "flags": pa.array(flags, pa.binary()), "n": pa.array(np.diff(at))})


def _shared_rows(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """(key, node, size) of the keys by which the sets of each block go."""
    for b in batches:
        for packed, answers in zip(b.column(0), b.column(1)):
            packed, answers = packed.as_py(), sorted(answers.as_py(), key=lambda a: a["range"])
            node, size, many = (np.frombuffer(x, np.int64) for x in packed[:3])
            keys = _unpack(packed[3])
            place = _by_range(keys, ranges)[2]
            flags = np.concatenate([np.unpackbits(np.frombuffer(a["flags"], np.uint8), count=2 * a["n"]).reshape(2, -1) for a in answers], axis=1)
            shared, crowded = flags[0][place] > 0, flags[1][place] > 0
            owner = np.repeat(np.arange(len(node)), many)
            free = np.cumsum(~crowded) - ~crowded  # uncrowded keys before each
            free -= np.repeat(free[np.minimum(np.cumsum(many) - many, max(len(keys) - 1, 0))] if len(keys) else many, many)
            d = size // 5
            swamped = 5 * np.bincount(owner, crowded, len(node)) >= 4 * d + 5
            hit = shared & np.where(crowded, swamped[owner], free <= d[owner])
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit].view(np.int64)), pa.array(node[owner[hit]]), pa.array(size[owner[hit]])], ["key", "node", "size"])


def part_keys(s: np.ndarray) -> np.ndarray:
    """Keys of a set of four or more; two sets with a similarity of 0.8 share one."""
    own = int(np.searchsorted(_EDGES, len(s), "right")) - 1
    out = []
    for scheme in (own, own + 1):  # a set meets those of its own range of sizes and of the next
        m = _EDGES[scheme + 1] * 3 // 10 + 2
        salt = mix(np.array([scheme], np.uint64) * _PART)[0]
        part = (mix(s ^ salt) % np.uint64(m)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        held, at = np.unique(part[order], return_index=True)
        sums = np.add.reduceat(mix(s[order] + salt), at)
        out.append(mix(mix(held.astype(np.uint64) + salt) ^ sums))
        if m - len(s) // 4 <= m - len(held):
            empty = np.setdiff1d(np.arange(m), held)
            out.append(mix(mix(empty.astype(np.uint64) + salt) ^ _ODD))
    return np.concatenate(out)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _sets_of(packed: list[bytes], n: int) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    raw = [unpack(x) for x in packed]
    return sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), n)


def _parts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        found = _sets_of(part.column(1).to_pylist(), n)
        keys = [part_keys(s).view(np.int64) for s in found]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in found]), pa.array(keys, pa.list_(pa.int64()))], ["node", "size", "keys"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, BITS // 64) for k in (2, 3))
        apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        yield batch.select([0, 1]).filter(pa.array(9 * apart <= np.asarray(batch.column(4)), pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches, 64):
        texts = {node: z for k in (0, 1) for node, z in zip(part.column(k).to_pylist(), part.column(k + 2).to_pylist())}
        found = dict(zip(texts, _sets_of(list(texts.values()), n)))
        keep = []
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            both = len(np.intersect1d(found[a], found[b], assume_unique=True))
            keep.append(5 * both >= 4 * (len(found[a]) + len(found[b]) - both))
        yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _near_size(a: str, b: str) -> Column:
    return (5 * F.col(a) >= 4 * F.col(b)) & (5 * F.col(b) >= 4 * F.col(a))


def _counted(keyed: DataFrame) -> DataFrame:
    """Rows (key, node, size, n) of keys that n > 1 nodes have."""
    keyed = written(keyed.distinct())
    return written(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"))


def _star_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b) of each node and the ones that a key's others are held against."""
    picks = keyed.groupBy("key").agg(*(F.min_by(F.struct("node", "size"), F.xxhash64("node", F.lit(k))).alias(f"to{k}") for k in range(_ROUNDS)))
    met = keyed.select("key", "node", "size").join(picks, "key").select("node", "size", F.explode(F.array(*(f"to{k}" for k in range(_ROUNDS)))).alias("to"))
    met = met.where((F.col("node") != F.col("to.node")) & _near_size("size", "to.size"))
    return met.select(F.least("node", "to.node").alias("a"), F.greatest("node", "to.node").alias("b")).distinct()


def _open(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (key, node, size, n, component) of keys whose nodes are in several components."""
    labelled = keyed.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return written(labelled.join(several, "key"))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (gid, node, size, component, side, bits) rows, all of a gid together, the pairs (a, b) of different components, and of different sides if there are two, that sizes and bitmaps allow."""
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> pa.RecordBatch:
        gid, node, size, component, side = (table.column(k).to_numpy() for k in range(5))
        bits = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint64).reshape(-1, BITS // 64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        first = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(gid)]):
            two = side[lo:hi].min() != side[lo:hi].max()
            for i in range(lo, hi - 1):
                j = slice(i + 1, hi)
                n = size[j] + size[i]
                near = (component[j] != component[i]) & (5 * np.minimum(size[j], size[i]) >= 4 * np.maximum(size[j], size[i]))
                if two:
                    near &= side[j] != side[i]
                k = np.flatnonzero(near)
                if len(k):
                    k = k[9 * np.bitwise_count(bits[j][k] ^ bits[i]).sum(axis=1, dtype=np.int64) <= n[k]] + i + 1
                    out.append((np.minimum(node[k], node[i]), np.maximum(node[k], node[i])))
        a, b = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for whole in batches:
        for k in range(0, whole.num_rows, _BLOCK):
            held.append(whole.slice(k, _BLOCK))
            table = pa.Table.from_batches(held)
            gid = table.column(0).to_numpy()
            cut = int(np.searchsorted(gid, gid[-1], "left"))  # the last may go on
            if cut:
                yield solve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield solve(pa.Table.from_batches(held))


def _pairs(keyed: DataFrame, bits: DataFrame) -> DataFrame:
    """(a, b) of one key in different components that may be similar. The sets of a key that more than _BLOCK have meet block by block."""
    rows = keyed.join(bits, "node")
    small = rows.where(F.col("n") <= _BLOCK).select(F.col("key").alias("gid"), "node", "size", "component", F.lit(0).alias("side"), "bits")
    blocks = F.ceil(F.col("n") / _BLOCK)
    large = rows.where(F.col("n") > _BLOCK).withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    large = large.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("gid"), "node", "size", "component", (F.col("own") > F.col("other")).cast("int").alias("side"), "bits")
    dealt = small.unionByName(large).repartition("gid").sortWithinPartitions("gid")
    return dealt.mapInArrow(_compared, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", n: int = 5) -> DataFrame:
    """(doc_id, text_key, node, component_id, first) per row of `docs`; component_id is the smallest doc_id reachable over links of similarity 0.8 or more.

    text_key is a hash of the text; node is the same for rows with the same shingles; `first` marks the row of each component that comes
    first by (doc_id, text_key), rows without a doc_id last, and rows equal to it. Null texts and those without words have no shingles and are linked with each
    other. Rows with a null doc_id keep it and get the component of their text, null if no row of that has a doc_id; rows that share a
    doc_id are documents each by itself. Repeated rows stay. Other columns of `docs` are not read."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return pa.array([squeeze(t.as_buffer()) for t in texts.cast(pa.large_binary())], pa.binary())

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scanned = written(source.mapInArrow(lambda b: _scan(b, n), _ROWS))
    rows, blocks = scanned.where("block IS NULL"), scanned.where("block IS NOT NULL").select("block", "n_keys", "packed")
    ranges = int((blocks.agg(F.sum("n_keys")).first()[0] or 0) // _ENTRIES) + 1  # more keys, more ranges, none larger
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = written(rows.groupBy("node").agg(F.min(F.struct(*(F.col(c) for c in ("size", "bits")))).alias("s"), F.min(row).alias("row")).select("node", "s.size", "s.bits", "row"))

    def texts(wanted: DataFrame) -> DataFrame:
        """(node, z): one compressed text of each node in `wanted`."""
        at = written(nodes.join(wanted.distinct(), "node", "left_semi").select("node", F.col("row.doc_id").alias("_id"), F.col("row.text_key").alias("_key")))
        same = (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
        if at.limit(_FEW + 1).count() <= _FEW:
            found = source.join(F.broadcast(at), same).select("node", pack("text").alias("z"))
        else:
            found = source.select("doc_id", "text_key", pack("text").alias("z")).join(at, same).select("node", "z")
        return written(found.dropDuplicates(["node"]))

    def possible(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose bitmaps allow a similarity of 0.8."""
        x, y = (nodes.select(F.col("node").alias(k), F.col("bits").alias(v), F.col("size").alias(f"n{k}")) for k, v in (("a", "x"), ("b", "y")))
        near = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n"))
        return near.mapInArrow(_possible, "a long, b long")

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets have a similarity of 0.8 or more."""
        near = written(pairs)
        held = texts(near.select(F.explode(F.array("a", "b")).alias("node")))
        x, y = (held.select(F.col("node").alias(k), F.col("z").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return written(near.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(lambda b: _verified(b, n), "a long, b long"))

    dealt = blocks.select("block", "packed").mapInArrow(lambda b: _dealt(b, ranges), "range long, block long, keys binary, often binary")
    flagged = dealt.groupBy("range").applyInArrow(_flagged, "block long, range long, flags binary, n long")
    answers = flagged.groupBy("block").agg(F.collect_list(F.struct("range", "flags", "n")).alias("answers"))  # at most one for each range
    keyed = _counted(blocks.join(answers, "block").select("packed", "answers").mapInArrow(lambda b: _shared_rows(b, ranges), "key long, node long, size long"))
    bits = nodes.select("node", "bits")
    links = similar(possible(_star_pairs(keyed)))
    left = _open(keyed, connected_components(links))
    few, many = _pairs(left.where(F.col("n") <= CROWDED), bits), left.where((F.col("n") > CROWDED) & (F.col("size") >= 4)).select("node")
    parts = _counted(texts(many).mapInArrow(lambda b: _parts(b, n), "node long, size long, keys array<long>").select(F.explode("keys").alias("key"), "node", "size"))
    links = links.unionByName(similar(few.unionByName(possible(_star_pairs(parts))).distinct()))
    found = written(connected_components(links))
    links = links.unionByName(similar(_pairs(_open(parts, found), bits)))
    found = connected_components(links)
    label = written(nodes.select("node", "row").join(found, "node", "left").select("node", "row", F.coalesce("component", "node").alias("component")))
    least = label.groupBy("component").agg(F.min("row").alias("least"))
    out = rows.select("doc_id", "text_key", "node").join(label.select("node", "component"), "node").join(least, "component")
    return out.select("doc_id", "text_key", "node", F.col("least.doc_id").alias("component_id"), (row == F.col("least")).alias("first"))
