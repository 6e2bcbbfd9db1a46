"""The data model: a property graph as named DataFrames.

nodes: id, key, name, short, kind, file, line, end_line, signature, project, tags
edges: src, dst, kind, note, confidence, source, site, role, ord (a total order; ties of every ranking fall back on it)
Other tables are None where a source has none: files, dirs, unresolved, external_types, project_refs, handlers, meta.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bucketed, written

NODES = "id long, key string, name string, short string, kind string, file string, line int, end_line int, signature string, project string, tags array<string>"
EDGES = "src long, dst long, kind string, note string, confidence double, source string, site string, role int, ord long"

#: Edges at or above this score are trusted.
TRUST = 0.8
#: Bits of an edge's role.
READ, WRITE, SUBSCRIBE = 1, 2, 4


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None
    dirs: DataFrame | None = None
    unresolved: DataFrame | None = None
    external_types: DataFrame | None = None
    project_refs: DataFrame | None = None
    handlers: DataFrame | None = None
    diagnostics: DataFrame | None = None
    meta: DataFrame | None = None
    by_src: tuple[DataFrame, ...] = ()
    by_dst: tuple[DataFrame, ...] = ()

    def stored(self, buckets: int | None = None) -> Graph:
        """With nodes and edges as tables, for plans that read them again and again.

        Edges are kept by either end too, in buckets (as many as shuffle partitions, unless told otherwise), so that a level of a
        walk shuffles its frontier only. Edges of hubs stand apart, unbucketed, so that joins with them can be split."""
        n = buckets or int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        edges = written(self.edges)
        return replace(self, nodes=written(self.nodes), edges=edges, by_src=_dealt(edges, "src", n), by_dst=_dealt(edges, "dst", n))

    def leaving(self) -> tuple[DataFrame, ...]:
        """The edges in parts, each to be joined on its source."""
        return self.by_src or (self.edges,)

    def entering(self) -> tuple[DataFrame, ...]:
        """The edges in parts, each to be joined on its target."""
        return self.by_dst or (self.edges,)


#: A node of fewer edges is no hub, however small the graph.
LEAST_HUB = 100_000


def _dealt(edges: DataFrame, key: str, buckets: int) -> tuple[DataFrame, ...]:
    """Edges in buckets by `key`, and those of hubs: nodes with more than a quarter of an even bucket, so fewer than four for each bucket."""
    limit = max(LEAST_HUB, edges.count() // (4 * buckets))
    hubs = written(edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(key))
    if hubs.isEmpty():
        return (bucketed(edges, key, buckets),)
    return bucketed(edges.join(F.broadcast(hubs), key, "left_anti"), key, buckets), written(edges.join(F.broadcast(hubs), key, "left_semi").select(*edges.columns))
