"""Line dedup by a deletion-neighbourhood join: lines that equal an earlier line go, as do lines of at least
`min_chars` code points that come within one edit (Levenshtein distance 1) of one; the earliest stays.

Before variants are made, lines are held against each other by halves: two lines within one edit share the first or
the last half (of the shorter one's length), so only lines that share a half are of interest, and only
positions in the other half can differ. Those lines emit a hashed key for each deletion: with the position for
a substitution (both lines of a key then differ at that position alone), without it for an insertion, where a
line meets the lines that become it by one deletion. Keys that meet are told apart by a digest of the variant itself,
and summed up by the earliest line, never paired, so a line that thousands of others resemble costs one row each.
Links are verified on the texts.

A row is known by its doc_id and a 64-bit hash of its text, so rows that share a doc_id, or have none, keep their own lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, prefix_hash, span_hash, text_blocks, written

_FIRST, _LAST, _SWAP, _SELF, _CUT = (np.uint64(x) for x in (0x51ED270B1A2D9A1F, 0x2545F4914F6CDD1D, 0xD1342543DE82EF95, 0xA0761D6478BD642F, 0xA0761D6478BD642F))
_SIZE = np.uint64(0xE7037ED1A0B428DB)


def _points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _tagged(h: np.ndarray, n: np.ndarray, tag: np.uint64) -> np.ndarray:
    return mix((h + n.astype(np.uint64) * _SIZE) ^ tag)


def _lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, line_no, line hash, half keys) of each line that isn't blank; no half keys where it is too short for edits."""
    for rows, data, at in text_blocks(batches, "text"):
        # All rows at once: a line feed between rows, which ends a line there too.
        raw = data.tobytes()
        chars = _points(b"\n".join(raw[a:b] for a, b in zip(at, at[1:])))
        feeds = np.flatnonzero(chars == 10)
        start, end = np.concatenate([[0], feeds + 1]), np.append(feeds, len(chars))
        per_row = np.array([raw.count(b"\n", a, b) + 1 for a, b in zip(at, at[1:])])
        row = np.repeat(np.arange(len(per_row)), per_row)
        number = np.arange(len(start)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        solid = np.concatenate([[0], np.cumsum(~((chars == 32) | ((chars >= 9) & (chars <= 13))))])
        some = solid[end] > solid[start]
        s, e = start[some], end[some]
        p, n = prefix_hash(chars), e - s
        keys = []
        for h in (n // 2, (n - 1) // 2):
            keys += [_tagged(span_hash(p, s, s + h), h, _FIRST) & ~np.uint64(1), _tagged(span_hash(p, e - h, e), h, _LAST) | np.uint64(1)]
        own, short = pa.array(row[some]), n < min_chars
        values = [rows.column(0).take(own), rows.column(1).take(own), pa.array(number[some], pa.int32()), pa.array(_tagged(span_hash(p, s, e), n, _SELF).view(np.int64)), *(pa.array(x.view(np.int64), mask=short) for x in keys)]
        yield pa.RecordBatch.from_arrays(values, ["doc_id", "text_key", "line_no", "line", "k0", "k1", "k2", "k3"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, role, place, key): role 0 deletions with their position, 1 the line itself, 2 deletions; only where the flags say an edit may be."""
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for line, text, tail, head in zip(*(batch.column(k).to_pylist() for k in range(4))):  # tail: the first half is shared
            c = _points(text.encode())
            n = len(c)
            p = prefix_hash(c)
            low, high = (0 if head else (n - 1) // 2), (n if tail else n - (n - 1) // 2)
            i = np.arange(low, high)
            first, rest = span_hash(p, np.zeros_like(i), i), span_hash(p, i + 1, np.full_like(i, n))
            cut = first + rest * powers(n + 1)[0][i]
            whole = span_hash(p, np.array([0]), np.array([n]))
            shorter, at = np.unique(_tagged(cut, np.full_like(i, n - 1), _CUT), return_index=True)
            keys = [(_tagged(cut, i * 2_000_003 + n, _SWAP), i), (_tagged(whole, np.array([n]), _CUT), np.array([-1])), (shorter, i[at])]
            for role, (k, place) in enumerate(keys):
                out[0].append(np.full(len(k), line)), out[1].append(np.full(len(k), role, np.int8)), out[2].append(place.astype(np.int32)), out[3].append(k.view(np.int64))
        if out[0]:
            kinds = (pa.int64(), pa.int8(), pa.int32(), pa.int64())
            whole_out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(out, kinds)], ["line", "role", "place", "key"])
            for k in range(0, whole_out.num_rows, 200_000):
                yield whole_out.slice(k, 200_000)


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, text_key, text) of the rows that have a text."""
    return docs.where(F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))


def repeated_lines(docs: DataFrame, text: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc_id, text_key, line_no, keep_doc_id, keep_line_no, edits) for each line that goes and the earliest line that it repeats within `edits` 0 or 1.

    Lines are what stands between line feeds. Earlier is by doc_id, rows without one last, then by the hash of the text and the line's number.
    A line goes if an earlier one is within the bound, be that kept or not. Blank lines always stay; lines of fewer than
    `min_chars` code points go only if they equal an earlier one. A null text has no lines; rows that are equal in
    doc_id and text are one occurrence. Other columns are not read."""
    source = _rows(docs, text)
    seen = written(source.mapInArrow(lambda b: _lines(b, min_chars), "doc_id long, text_key long, line_no int, line long, k0 long, k1 long, k2 long, k3 long"))
    spot = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "line_no")
    lines = written(seen.groupBy("line", "k0", "k1", "k2", "k3").agg(F.min(spot).alias("at"), F.count(F.lit(1)).alias("n")))
    halves = lines.where("k0 IS NOT NULL").select("line", F.explode(F.array_distinct(F.array("k0", "k1", "k2", "k3"))).alias("half"))
    shared = halves.join(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"), "half")
    flags = shared.groupBy("line").agg(F.max(F.col("half") % 2 == 0).alias("tail"), F.max(F.col("half") % 2 != 0).alias("head"))
    wanted = flags.join(lines.select("line", "at"), "line")
    # The texts of these lines, from the row where each stands first.
    per_row = wanted.groupBy(F.col("at.doc_id").alias("_id"), F.col("at.text_key").alias("_key")).agg(F.collect_list(F.struct("line", "at", "tail", "head")).alias("w"))
    cut = source.join(per_row, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select(F.split("text", "\n").alias("s"), F.explode("w").alias("w"))
    texts = cut.select("w.line", F.get("s", F.col("w.at.line_no")).alias("text"), "w.tail", "w.head", "w.at")
    texts = written(texts.dropDuplicates(["line"]))  # equal rows give equal ones
    keys = written(texts.select("line", "text", "tail", "head").mapInArrow(_variants, "line long, role byte, place int, key long"))
    met = keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key").join(texts.select("line", "at", "text"), "line")
    variant = F.when(F.col("role") == 1, F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), F.col("place")), F.substring("text", F.col("place") + 2, F.length("text"))))
    met = written(met.select("line", "role", "key", "at", F.md5(F.concat_ws("\n", F.when(F.col("role") == 0, F.col("place")), variant).cast("binary")).alias("variant")))
    low = met.groupBy("key", "variant").agg(*(F.min(F.when(F.col("role") == r, F.col("at"))).alias(f"m{r}") for r in range(3)))
    best = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    near = met.join(low, ["key", "variant"]).select("line", "at", best.alias("to")).where("to < at").select("line", "to").distinct()
    sides = texts.select("line", F.col("text").alias("x")), texts.select(F.col("at").alias("to"), F.col("text").alias("y"))
    near = near.join(sides[0], "line").join(sides[1], "to").where(F.levenshtein("x", "y", 1) >= 0).groupBy("line").agg(F.min("to").alias("to"))  # -1: further apart
    near = written(near)
    keep = lines.join(near, "line", "left").where("n > 1 OR to IS NOT NULL").select("line", F.coalesce("to", "at").alias("keep"), F.col("to").isNotNull().cast("int").alias("edits"))
    gone = seen.select("doc_id", "text_key", "line_no", "line").join(keep, "line").where(spot > F.col("keep"))
    return gone.select("doc_id", "text_key", "line_no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), "edits").distinct()


def without_lines(docs: DataFrame, gone: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the lines (doc_id, text_key, line_no) of `gone`, the other lines as they were; `n_lines_removed` tells how many went.

    Rows stay, even those of which no line is left (an empty text); an existing n_lines_removed is replaced."""
    drop = gone.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("line_no").alias("_gone"))
    joined = docs.join(drop, (F.xxhash64(docs[text]) == F.col("_key")) & docs["doc_id"].cast("long").eqNullSafe(F.col("_id")), "left")
    split = joined.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split(F.col(text), "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))  # in linear time, unlike a search for each line
    left = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    out = split.withColumn("n_lines_removed", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")))
    return out.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left)).drop("_id", "_key", "_gone", "_lines")
