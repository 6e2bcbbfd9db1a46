"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is embedded as the popcounts of its 16 segments of 4 bits. The Manhattan distance of two
embeddings is a lower bound of the Hamming distance, so fingerprints within 2 bits lie within Manhattan
distance 2, and both are within 1 of some point of the grid. Each distinct fingerprint is put into its own
cell and the at most 32 next to it; the range join is an equi-join on cells, and bit_count(x ^ y) verifies.

A cell with many fingerprints is not paired: its rows are dealt out anew by the fingerprints within one bit that
lie in the cell. Two that share such a midpoint differ in at most 2 bits, and those within 2 bits share one,
so a link to the smallest of a midpoint (which at most 65 share) is exact and linear.

No join is left to Spark to broadcast: packed numbers take a fraction of their size in files, so what seems small would fill the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

SEED = 42
#: A cell of more fingerprints is split by midpoints; which way a cell takes doesn't change the links.
CROWDED = 32


def fingerprint(text: bytes, n: int = 3) -> int:
    """Majority of the XXH64 bits of all word n-grams of `text`, A-Z in lower case; 0 without words."""
    w = text.lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[k:] for k in range(n)))) if len(w) >= n else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", n: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row of `docs`; a null text counts as empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", n) for t in batch.column(1).cast(pa.large_binary())], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, "doc_id long, fp long")


def _popcounts(x: Column) -> Column:
    """The popcounts of the 16 segments, each in its own 4 bits."""
    low, high = (y.bitwiseAND(F.lit(0x5555555555555555)) for y in (x, F.shiftrightunsigned(x, 1)))
    pairs = F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))
    return pairs.bitwiseAND(F.lit(0x3333333333333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x3333333333333333))


def _cells(v: Column) -> Column:
    out = [v]
    for s in range(0, 64, 4):
        count, one = F.shiftrightunsigned(v, s).bitwiseAND(F.lit(15)), F.lit(1 << s)
        out += [F.when(count < 4, v + one), F.when(count > 0, v - one)]
    return F.array_compact(F.array(*out))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): verified links between the nodes of (fp, node) rows with distinct fp, enough to connect all within 2 bits."""
    embedded = distinct.select("fp", "node", F.explode(_cells(_popcounts(F.col("fp")))).alias("cell"))
    met = embedded.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(embedded.join(met.hint("merge"), "cell"))
    few, many = shared.where(F.col("n") <= CROWDED), shared.where(F.col("n") > CROWDED)
    x, y = few.select("cell", F.col("fp").alias("x"), F.col("node").alias("a")), few.select("cell", F.col("fp").alias("y"), F.col("node").alias("b"))
    near = x.join(y.hint("merge"), "cell").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2)).select("a", "b")
    bits = [F.lit(0), *(F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64))]
    at = many.select("node", "cell", F.explode(F.array(*(F.col("fp").bitwiseXOR(b) for b in bits))).alias("mid")).where(_popcounts(F.col("mid")) == F.col("cell"))
    stars = at.join(at.groupBy("mid").agg(F.min("node").alias("b")).hint("merge"), "mid").where("node <> b").select(F.col("node").alias("a"), "b")
    return near.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", n: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row of `docs`; component_id is the smallest doc_id reachable over links of 2 or fewer bits.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null doc_id keep it and get the
    component of their fingerprint, null if no row of that has a doc_id. Repeated rows stay. Other columns of
    `docs` are not read. An empty table gives an empty result."""
    fps = written(fingerprints(docs, text, n))
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = connected_components(links(distinct.where("node IS NOT NULL")))
    group = distinct.join(found.hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(group.hint("merge"), "fp").select("doc_id", "fp", "component_id")
