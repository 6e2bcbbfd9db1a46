"""LM scoring by online logistic context mixing.

A token (an ASCII-lower-cased word, or the end of a text) is coded as: whether training texts have it; then its class,
eight bits of its hash, and the word among those of its class by training counts; or, if they don't, its bytes and
a mark of their end. The unknown have the Good-Turing share of the words seen once. Every bit of a class, and of a byte, is
predicted from hashed contexts. Those of a class: none, the class before, the two before, the classes
of this text so far, and the very word before, for the first three bits. Those of a byte are the bytes before it likewise. The
predictions are stretched, combined by a weight set that the bit's place and the stretch of text (first, second, third or
later) choose, and squashed. Each text refines its own weights as it is read, every STEP tokens.

The weights that all texts start from are one Newton step of the logistic loss over all tokens of all training texts, each
token taken out of the counts that predict it. Sums of gradients and curvatures
don't depend on how rows are dealt out.

Counts come from all training texts. Words, and the classes that follow each, are counted by ranges of word hashes over
blocks of documents, in which each word stands once, and go back to the blocks that hold the words: these tables grow with the
corpus and are never broadcast. The tables of the hashed contexts have a fixed number of slots (some 5 MB each) and are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import bucketed
from .common import lower, mix, prefix_hash, span_hash, text_blocks, words, written

END = np.uint64(0x5BD1E9955BD1E995)
#: log2 of the contexts of each hashed predictor; each has 256 symbols.
SIZES = (0, 8, 11)
STEP, RATE, PRIOR = 32, 0.02, 12.0
#: Bits of a class that the word before predicts, and the observations that it leans on those without a context.
AFTER, LEAN = 3, 4.0
#: Rows of the inputs: the hashed contexts, the text's own history, the word before, and a constant.
INPUTS = len(SIZES) + 3
_RIDGE, _FAR = 50.0, 1.0  # what a weight leans on its start, and the furthest it goes from there
_FOLLOW = 1 << AFTER
_MARK = 10  # ends the bytes of a word, as no word has a line feed
_AT = np.concatenate([[0], np.cumsum([256 << s for s in SIZES])])
_SLICE = 65536
_SEQUENCES = 128
_pack = zstandard.ZstdCompressor(level=3).compress
_unpack = zstandard.ZstdDecompressor().decompress


def _zip(x: np.ndarray) -> bytes:
    """Packed with the first bytes of all numbers together, then the second ones."""
    x = np.ascontiguousarray(x)
    return _pack(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unzip(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(_unpack(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _each(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, one at a time, as they may be large."""
    return (tuple(c[k].as_py() for c in batch.columns) for k in range(batch.num_rows))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans, one after another."""
    at = np.cumsum(size) - size
    return np.repeat(start - at, size) + np.arange(int(size.sum()))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words; an empty one is the end of a text."""
    return np.where(end > start, mix(span_hash(prefix_hash(data), start, end) + np.uint64(1)), END)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the tokens of all rows, ends of texts included, and the number of tokens of each row."""
    first, last = words(data, at)
    row = np.searchsorted(at, first, "right") - 1
    count = np.bincount(row, minlength=len(at) - 1) + 1
    start, end = np.zeros(count.sum(), np.int64), np.zeros(count.sum(), np.int64)
    place = np.arange(len(first)) + row
    start[place], end[place] = first, last
    return _hashes(data, start, end), start, end, count


def classes(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(56)).astype(np.int64)


def contexts(symbols: np.ndarray, count: np.ndarray, before: int) -> list[np.ndarray]:
    """For each hashed predictor, where the context of each symbol starts in the tables. Before a sequence stands `before`."""
    first = np.cumsum(count) - count
    place = np.arange(len(symbols)) - np.repeat(first, count)
    back = [np.where(place >= k, np.concatenate([np.full(k, before), symbols[:-k]])[: len(symbols)], before) for k in (1, 2)]
    mixed = lambda a, b: ((a * 256 + b) * 0x9E3779B1 % (1 << 32)) >> (32 - SIZES[2])
    each = [np.zeros(len(symbols), np.int64), back[0], mixed(back[0], back[1])]
    return [_AT[k] + 256 * c for k, c in enumerate(each)]


def _stretch(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


#: For each symbol: its bits, as 1 and -1; and the nodes of a tree (node 1 is its root) that it goes through, and its leaf, from 256 on.
_SIGN = np.where((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1, 1, -1).astype(np.float32)
_PATH = (1 << np.arange(9)) | (np.arange(256)[:, None] >> np.arange(8, -1, -1))


def trees(leaf: np.ndarray) -> np.ndarray:
    """For every context, what went through each node of the tree of a symbol's bits."""
    out = np.zeros((len(leaf) // 256, 512))
    out[:, 256:] = leaf.reshape(-1, 256)
    for width in (128, 64, 32, 16, 8, 4, 2, 1):
        out[:, width : 2 * width] = out[:, 2 * width : 4 * width : 2] + out[:, 2 * width + 1 : 4 * width : 2]
    return out


def plain(leaf: np.ndarray) -> np.ndarray:
    """For every symbol the probabilities of its own bits without a context."""
    tree = trees(leaf[:256])[0]
    return ((tree[_PATH[:, 1:]] + 0.4) / (tree[_PATH[:, :-1]] + 0.8)).astype(np.float32)


def paths(leaf: np.ndarray, alone: bool = False) -> np.ndarray:
    """For every context and symbol, the stretched probabilities of the symbol's own bits. A context leans on the plain ones by PRIOR observations. With `alone`, each symbol as if one occurrence of it had not been counted."""
    tree, base = trees(leaf), plain(leaf)
    out = np.empty((len(tree), 256, 8), np.float32)
    for k in range(8):
        through, same = tree[:, _PATH[:, k]], tree[:, _PATH[:, k + 1]]
        out[:, :, k] = _stretch((np.maximum(same - alone, 0) + PRIOR * base[:, k]) / (np.maximum(through - alone, 0) + PRIOR))
    out[0] = _stretch(base)
    return out.reshape(-1, 8)


def start_weights() -> np.ndarray:
    """(stretch of text, bit, input): what all weights are before anything is learned."""
    out = np.full((4, 8, INPUTS), 0.2, np.float32)
    out[..., -1] = 0
    return out


@dataclass
class Model:
    """Predicts sequences of symbols (classes of words, or bytes of a word) bit by bit. What it has counted is packed, as it goes to every task."""

    packed: bytes
    before: int
    weights: np.ndarray

    @staticmethod
    def of(leaf: np.ndarray, before: int) -> Model:
        return Model(_zip(leaf), before, start_weights())

    def after(self, tree: np.ndarray, word: np.ndarray, symbol: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The stretched predictions of a symbol's own bits by the word before it: `tree` has, for each word, how often each node of the first AFTER bits followed; `own` occurrences of the symbol itself don't count."""
        base = _plain(self.packed)
        out = np.zeros((len(symbol), 8), np.float32)
        through = tree[word, 1] - own
        for k in range(AFTER):
            same = tree[word, (2 << k) | (symbol >> (7 - k))] - own
            out[:, k] = _stretch((same + LEAN * base[symbol, k]) / (through + LEAN))
            through = same
        return out

    def scores(self, symbols: np.ndarray, count: np.ndarray, after: np.ndarray | None = None, sums: np.ndarray | None = None) -> np.ndarray:
        """The natural log of each symbol's probability. With `sums` (stretch, bit, INPUTS, INPUTS + 1), symbols count as learned from, weights stay as they are, and the curvatures and gradients of the loss are added to these, from every symbol."""
        where = contexts(symbols, count, self.before)
        out = np.zeros(len(symbols))
        order = np.argsort(-count, kind="stable")
        first = np.cumsum(count) - count
        for k in range(0, len(order), _SEQUENCES):
            part = order[k : k + _SEQUENCES]
            self._part(symbols, where, first[part], count[part], after, sums, out)
        return out

    def _part(self, symbols: np.ndarray, where: list[np.ndarray], first: np.ndarray, size: np.ndarray, after: np.ndarray | None, sums: np.ndarray | None, out: np.ndarray) -> None:
        table, base = _paths(self.packed, sums is not None), _plain(self.packed)
        seen = np.zeros((len(size), 512), np.float32)
        moved = np.zeros((INPUTS, len(size), 8), np.float32)
        for turn, s in enumerate(range(0, int(size.max(initial=0)), STEP)):
            live = int(np.searchsorted(-size, -s, "left"))  # sequences longer than s, which stand first
            step = s + np.arange(min(STEP, int(size[0]) - s))
            at = first[:live, None] + np.minimum(step, size[:live, None] - 1)
            inside = step < size[:live, None]
            c = symbols[at]
            key = np.arange(live)[:, None, None] * 512 + _PATH[c]
            sign, through = _SIGN[c], seen.ravel()[key]
            p = (through[:, :, 1:] + PRIOR * base[c]) / (through[:, :, :-1] + PRIOR)
            x = [table[w[at] + c] for w in where] + [_stretch(p), np.zeros_like(p) if after is None else after[at], sign]
            w = self.weights[min(turn, 3)].T  # INPUTS x 8
            z = reduce(np.add, (v * (w[k] + moved[k, :live, None, :] if sums is None else w[k]) for k, v in enumerate(x)))
            guess = 1 / (1 + np.exp(-z))  # of the symbol's own bits
            out[at[inside]] = np.log(guess.astype(np.float64).prod(axis=2))[inside]
            error = (1 - guess) * inside[:, :, None]
            if sums is None:
                for k, v in enumerate(x):
                    moved[k, :live] += np.einsum("atk,atk->ak", error, v) * np.float32(RATE / STEP)
            else:
                rows = np.stack([v.reshape(-1, 8).T for v in x], axis=1)  # bit, input, symbol
                curve = (guess * error).reshape(-1, 8).T[:, None, :]
                sums[min(turn, 3), :, :, :-1] += (rows * curve) @ rows.transpose(0, 2, 1)
                sums[min(turn, 3), :, :, -1] += (rows @ error.reshape(-1, 8).T[:, :, None])[:, :, 0]
            seen[:live] += np.bincount(key[inside].ravel(), minlength=live * 512).reshape(live, 512)


@lru_cache(maxsize=2)
def _paths(packed: bytes, alone: bool) -> np.ndarray:
    return paths(_unzip(packed, np.int64), alone)


@lru_cache(maxsize=2)
def _plain(packed: bytes) -> np.ndarray:
    return plain(_unzip(packed, np.int64))


def newton(sums: np.ndarray) -> np.ndarray:
    """The start weights after one step that the sums of curvatures and gradients over all training texts give."""
    out = start_weights().astype(float)
    for k in np.ndindex(out.shape[:2]):
        step = np.linalg.solve(sums[k][:, :-1] + _RIDGE * np.eye(INPUTS), sums[k][:, -1])
        out[k] += np.clip(step, -_FAR, _FAR)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for about 3 MB of documents: their tokens as places in the list of the block's words, most frequent first, the words' bytes, and how often what classes follow each in training texts (every token is followed by one, and as many texts begin as end: the sums are the words' training counts)."""
    part, k = TaskContext.get().partitionId(), 0
    for rows, data, at in text_blocks(batches, "text", 3 << 20):
        data = lower(data)
        hashes, start, end, count = tokens(data, at)
        _, one, place, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        place, one = rank[place], one[order]
        size = end[one] - start[one]
        held = np.asarray(rows.column(1).to_pylist(), bool)
        learned = np.repeat(~held, count)
        follow = np.bincount((_before(place, count, hashes[one]) * _FOLLOW + (classes(hashes) >> (8 - AFTER)))[learned], minlength=_FOLLOW * len(one))
        ids = rows.column(0)
        payload = [_zip(place.astype(np.uint32)), _zip(count.astype(np.int64)), _zip(np.diff(at)), _zip(np.asarray(ids.fill_null(0))), _zip(np.asarray(ids.is_null().to_pylist(), bool)), _zip(held)]
        spelled = [_pack(data[_spans(start[one], size)].tobytes()), _zip(size.astype(np.uint32))]
        values = [pa.array([part << 32 | k]), *(pa.array([v], pa.list_(pa.binary())) for v in (payload, spelled)), pa.array([_zip(follow.astype(np.uint32))], pa.binary()), pa.array([len(one)])]
        yield pa.RecordBatch.from_arrays(values, ["block", "payload", "spelled", "follow", "n_words"])
        k += 1


def _before(place: np.ndarray, count: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The word before each token, as a place in the block's list; before a text stands an end."""
    out = np.roll(place, 1)
    out[np.cumsum(count) - count] = np.flatnonzero(hashes == END)[0]
    return out


def _words(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, sizes and hashes of a list of words."""
    data, size = np.frombuffer(_unpack(spelled[0]), np.uint8), _unzip(spelled[1], np.uint32).astype(np.int64)
    start = np.cumsum(size) - size
    return data, start, size, _hashes(data, start, start + size)


def _short(x: np.ndarray) -> np.ndarray:
    """Counts in a byte: as they are below 16, then in steps of an eighth of an octave."""
    return np.where(x < 16, x, 16 + np.rint(8 * np.log2(np.maximum(x, 16) / 16)).astype(np.int64)).astype(np.uint8)


def _long(x: np.ndarray) -> np.ndarray:
    return np.where(x < 16, x, np.rint(16 * 2 ** ((x.astype(np.float32) - 16) / 8))).astype(np.float32)


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The words of a block and their counts, by bucket."""
    for b in batches:
        for block, spelled, follow in _each(b):
            data, start, size, known = _words(spelled)
            follow = _unzip(follow, np.uint32).reshape(-1, _FOLLOW)
            bucket = (known % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cut)).tolist():
                own = order[cut[k] : cut[k + 1]]
                rows.append((k, block, [_pack(data[_spans(start[own], size[own])].tobytes()), _zip(size[own].astype(np.uint32)), _zip(follow[own].ravel())]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "block", "words"])


_COUNTED = "block long, bucket long, counts array<binary>, mass double, n long, v long, once long"


def _slices(leaf: np.ndarray) -> list[tuple[int, bytes]]:
    return [(k // _SLICE, _zip(leaf[k : k + _SLICE])) for k in range(0, len(leaf), _SLICE) if leaf[k : k + _SLICE].any()]


def _spelling(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, a mark after each, and how many each word has then."""
    out = np.full(int(size.sum()) + len(size), _MARK, np.int64)
    out[_spans(np.cumsum(size + 1) - size - 1, size)] = data[_spans(start, size)]
    return out, size + 1


def _counted(table: pa.Table) -> pa.Table:
    """The counts over all blocks of the words of one bucket, to each block that has them; as block -1 - class, the sums of each class; and as block -1000 - k, a slice of the byte contexts of the words seen once."""
    slices = table.column("words").to_pylist()
    each = [_words(x[:2]) for x in slices]
    known, one, place = np.unique(np.concatenate([x[3] for x in each]), return_index=True, return_inverse=True)
    follow = np.zeros((len(known), _FOLLOW), np.int64)
    each_follow = np.concatenate([_unzip(x[2], np.uint32).reshape(-1, _FOLLOW) for x in slices])
    for c in range(_FOLLOW):
        follow[:, c] = np.bincount(place, each_follow[:, c], len(known))
    total, short = follow.sum(axis=1), _short(follow)
    bucket, rows, a = table.column("bucket")[0].as_py(), [], 0
    for block, (_, _, size, _) in zip(table.column("block").to_pylist(), each):
        own = place[a : a + len(size)]
        rows.append((block, bucket, [_zip(total[own]), _pack(short[own].T.tobytes())], None, None, None, None))
        a += len(size)
    kind, seen = classes(known), total > 0
    sums = [np.bincount(kind[m], x[m], 256) for m, x in ((seen, total + 0.5), (seen, total), (seen, np.ones(len(total))), (total == 1, np.ones(len(total))))]
    rows += [(-1 - c, bucket, None, float(sums[0][c]), *(int(s[c]) for s in sums[1:])) for c in range(256) if sums[1][c]]
    data, size = np.concatenate([x[0] for x in each]), np.concatenate([x[2] for x in each])
    once = one[(total == 1) & (size[one] > 0)]
    symbols, count = _spelling(data, (np.cumsum(size) - size)[once], size[once])
    leaf = np.zeros(_AT[-1], np.int64)
    for w in contexts(symbols, count, _MARK):
        leaf += np.bincount(w + symbols, minlength=len(leaf))
    rows += [(-1000 - k, bucket, [x], None, None, None, None) for k, x in _slices(leaf)]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _COUNTED.split(", ")])


def _held(payload: list[bytes]) -> tuple[np.ndarray, ...]:
    return tuple(_unzip(x, k) for x, k in zip(payload, (np.uint32, np.int64, np.int64, np.int64, bool, bool)))


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each class followed each hashed context in the training texts of this task, in slices of the tables."""
    leaf = np.zeros(_AT[-1], np.int64)
    for b in batches:
        for payload, spelled in _each(b):
            place, count, _, _, _, held = _held(payload)
            cls = classes(_words(spelled)[3])[place]
            learned = np.repeat(~held, count)
            for w in contexts(cls, count, _END_CLASS):
                leaf += np.bincount((w + cls)[learned], minlength=len(leaf))
    task = TaskContext.get().partitionId()
    rows = [(k, task, x) for k, x in _slices(leaf)]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()))], ["slice", "task", "leaf"])


_END_CLASS = int(classes(END[None])[0])


def _summed(table: pa.Table) -> pa.Table:
    total = reduce(np.add, (_unzip(x, np.int64) for x in table.column("leaf").to_pylist()))
    return pa.table({"slice": table.column("slice")[:1], "task": pa.array([table.column("task")[0].as_py() // 64]), "leaf": pa.array([_zip(total)], pa.binary())})


def _table(parts: DataFrame) -> np.ndarray:
    """One table from the slices (slice, task, leaf) of many tasks, summed 64 at a time; only a fixed number of slots reaches the driver."""
    parts = written(parts)
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        parts = parts.groupBy("slice", (F.col("task") / 64).cast("long").alias("group")).applyInArrow(lambda _, t: _summed(t), "slice long, task long, leaf binary")
        tasks = -(-tasks // 64)
        if tasks == 1:
            break
    leaf = np.zeros(_AT[-1], np.int64)
    for row in parts.toLocalIterator():
        x = _unzip(row["leaf"], np.int64)
        leaf[row["slice"] * _SLICE : row["slice"] * _SLICE + len(x)] = x
    return leaf


@dataclass
class Fitted:
    """What the training texts have taught: sums over all of them, and the models of classes and of bytes."""

    buckets: int
    n: int
    v: int
    unknown: float
    mass: np.ndarray
    classes: Model
    bytes: Model

    def read(self, spelled: list[bytes], answers: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, sizes and hashes of the block's words, their training counts, the tree of what follows each)."""
        data, start, size, known = _words(spelled)
        order = np.argsort((known % np.uint64(self.buckets)).astype(np.int64), kind="stable")
        answers = sorted(answers, key=lambda a: a["bucket"])  # as they were dealt out
        out = np.zeros(len(known), np.int64)
        out[order] = np.concatenate([_unzip(a["counts"][0], np.int64) for a in answers])
        tree = np.zeros((len(known), 2 * _FOLLOW), np.float32)
        tree[order, _FOLLOW:] = _long(np.concatenate([np.frombuffer(_unpack(a["counts"][1]), np.uint8).reshape(_FOLLOW, -1).T for a in answers]))
        for width in (1 << k for k in reversed(range(AFTER))):
            tree[:, width : 2 * width] = tree[:, 2 * width : 4 * width : 2] + tree[:, 2 * width + 1 : 4 * width : 2]
        return data, start, size, known, out, tree


def _gradients(batches: Iterator[pa.RecordBatch], fitted: Fitted) -> Iterator[pa.RecordBatch]:
    """The sums that `newton` takes, over the training texts of this task."""
    sums = np.zeros((4, 8, INPUTS, INPUTS + 1))
    for b in batches:
        for payload, spelled, answers in _each(b):
            place, count, _, _, _, held = _held(payload)
            if held.all():
                continue
            _, _, _, known, _, tree = fitted.read(spelled, answers)
            learned = np.repeat(~held, count)
            cls = classes(known)[place]
            before = _before(place, count, known)[learned]
            cls = cls[learned]
            fitted.classes.scores(cls, count[~held], fitted.classes.after(tree, before, cls, np.float32(1)), sums)
    flat = sums.ravel()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "x"])


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _scored(batches: Iterator[pa.RecordBatch], fitted: Fitted) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for payload, spelled, answers in _each(b):
            place, count, size, ids, null, held = _held(payload)
            data, start, long, known, total, tree = fitted.read(spelled, answers)
            cls = classes(known)
            base = np.log10((total + 0.5) / (fitted.n + 0.5 * (fitted.v + 1)))
            word = np.log10(1 - fitted.unknown) + np.log10((total + 0.5) / fitted.mass[cls])
            new = np.flatnonzero(total == 0)
            symbols, many = _spelling(data, start[new], long[new])
            spelling = np.add.reduceat(fitted.bytes.scores(symbols, many), np.cumsum(many) - many) if len(new) else np.zeros(0)
            word[new] = np.log10(fitted.unknown) + spelling / np.log(10)
            seen = (total > 0)[place]
            after = fitted.classes.after(tree, _before(place, count, known), cls[place], np.float32(0))
            token = word[place] + np.where(seen, fitted.classes.scores(cls[place], count, after) / np.log(10), 0)
            row = np.repeat(np.arange(len(count)), count)
            sums = [np.bincount(row, x, len(count)) for x in (seen, base[place], token)]
            bits = pa.array(-sums[2] * np.log2(10) / np.maximum(size, 1), mask=size == 0)
            values = [pa.array(ids, mask=null), pa.array(held), pa.array(count), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(count), fitted.n, np.int64)), pa.array(sums[1]), pa.array(sums[2]), bits]
            yield pa.RecordBatch.from_arrays(values, [x.split()[0] for x in SCHEMA.split(", ")])


def fit(docs: DataFrame, held_out: Column, text: str = "text") -> tuple[DataFrame, Fitted]:
    """Blocks (payload, spelled, answers) of all rows, and what those that aren't held out teach."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    blocks = source.mapInArrow(_blocks, "block long, payload array<binary>, spelled array<binary>, follow binary, n_words long")
    # In buckets, so that what goes back to the blocks is all that joins move; at least as many as shuffles have, or Spark deals the blocks out anew.
    blocks = bucketed(blocks, "block", min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 100_000))
    entries = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = int(entries // 400_000) + 1  # more words, more buckets, none larger
    dealt = blocks.select("block", "spelled", "follow").mapInArrow(lambda b: _dealt(b, buckets), "bucket long, block long, words array<binary>")
    counted = written(dealt.groupBy("bucket").applyInArrow(_counted, _COUNTED))
    sums = {-1 - r["block"]: r for r in counted.where("block BETWEEN -256 AND -1").groupBy("block").agg(*(F.sum(c).alias(c) for c in ("mass", "n", "v", "once"))).collect()}
    n, v, once = (sum(r[k] for r in sums.values()) for k in ("n", "v", "once"))
    mass = np.array([sums[c]["mass"] if c in sums else 1.0 for c in range(256)])
    leaf = _table(blocks.select("payload", "spelled").mapInArrow(_leaves, "slice long, task long, leaf binary"))
    spelled = _table(counted.where("block <= -1000").select((-1000 - F.col("block")).alias("slice"), F.col("bucket").alias("task"), F.get("counts", F.lit(0)).alias("leaf")))
    fitted = Fitted(buckets, n, v, min(0.5, (once + 1) / (n + 2)), mass, Model.of(leaf, _END_CLASS), Model.of(spelled, _MARK))
    answers = counted.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))  # at most one for each bucket
    joined = blocks.select("block", "payload", "spelled").join(answers, "block").select("payload", "spelled", "answers")
    rows = joined.mapInArrow(lambda b: _gradients(b, fitted), "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()  # as many as there are weights
    total = np.zeros(4 * 8 * INPUTS * (INPUTS + 1))
    for r in rows:
        total[r["k"]] = r["x"]
    fitted.classes.weights = newton(total.reshape(4, 8, INPUTS, INPUTS + 1)).astype(np.float32)
    return joined, fitted


def lm_scores(docs: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    Rows with `held_out` false or null are learned from; all are scored. base_score is the log10 probability of the
    tokens by add-0.5 counts, score that of the mixing model, bits_per_byte the latter's per byte of the text (null
    if it has none); it codes the words of a text, not its letter case and kinds of white space. A null text is empty: one token, its end. Null doc_ids
    and repeated rows stay. Without training texts all words are unknown. Scores don't depend on how rows are dealt out. Other columns are not read."""
    joined, fitted = fit(docs, held_out, text)
    return joined.mapInArrow(lambda b: _scored(b, fitted), SCHEMA)
