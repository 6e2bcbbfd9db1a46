"""Why an answer is empty, what was left unresolved, and all there is to know of one node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import TYPES, is_entrypoint, is_flow, is_test, leaf, score, under
from ..graph import Graph
from ..tables import written
from . import rank, walk

#: The order of kinds in a report of unresolved sites, and how many of each are kept as a sample.
KINDS = {"di": 0, "mediatr": 1, "type": 2}
SAMPLE = {"call": 250, "type": 100, "di": 75, "mediatr": 75}


def kind_order(kind: str = "kind") -> Column:
    out = F.lit(3)
    for k, n in KINDS.items():
        out = F.when(F.col(kind) == k, n).otherwise(out)
    return out


def unresolved_totals(sites: DataFrame, kind: str | None = None, prefix: str | None = None) -> DataFrame:
    """(kind, reason, sites, place): all sites by kind and reason, in the order of a report."""
    rows = sites.where(F.col("kind") == kind) if kind else sites
    rows = rows.where(under("file", prefix)) if prefix else rows
    per = rows.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("sites"))  # a row for each kind and reason
    return per.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(kind_order(), F.desc("sites"), "kind", "reason")))


def unresolved_sample(sites: DataFrame, by: tuple[str, ...] = ("kind",), caps: dict[str, int] | None = None) -> DataFrame:
    """The first sites of each group, by file and line, as many as the cap of their kind (6 where none is given); totals are never taken from these."""
    cap = F.lit(6)
    for k, n in (caps or {}).items():
        cap = F.when(F.col("kind") == k, n).otherwise(cap)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("file", "line", "expression"))
    return sites.withColumn("nth", nth).where(F.col("nth") <= cap).drop("nth")


def _pieces(line: Column, last: Column) -> Column:
    """The fewest (level, block) that make up the lines from `line` to `last`; a block of level k has the 2^k lines from block * 2^k on."""
    size = F.bin(last.cast("long") - line.cast("long") + 1)  # as many digits as levels can serve
    at = lambda k: (F.ceil(line / F.pow(F.lit(2.0), k)), F.floor((last.cast("long") + 1) / F.pow(F.lit(2.0), k)))  # noqa: E731  exact for lines of 32 bits

    def ends(k: Column) -> Column:
        lo, hi = at(k)
        row = lambda block: F.struct(k.alias("level"), block.alias("block"))
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
        return F.array(F.when((lo < hi) & odd(lo), row(lo)), F.when((lo < hi) & odd(hi), row(hi - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.length(size) - 1), ends)))


def _counted_within(spans: DataFrame, points: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(id, *by, n): how many of the points (f, at, *by) lie in each span (id, f, line, last).

    Points are summed by blocks of lines of the sizes that the spans of their file are made of, so a wide span meets a few
    sums, not every point, and no file's spans meet all of its points."""
    cut = spans.select("id", "f", F.explode(_pieces(F.col("line"), F.col("last"))).alias("p")).select("id", "f", "p.level", "p.block")
    sums = points.groupBy("f", "at", *by).agg(F.count(F.lit(1)).alias("n")).join(cut.select("f", "level").distinct(), "f")
    sums = sums.groupBy("f", "level", F.floor(F.col("at") / F.pow(F.lit(2.0), "level")).alias("block"), *by).agg(F.sum("n").alias("n"))
    return cut.join(sums.hint("merge"), ["f", "level", "block"]).groupBy("id", *by).agg(F.sum("n").alias("n"))


def reasons(graph: Graph, targets: DataFrame | None = None) -> DataFrame:
    """(id, kind, reason, n): what may hide edges of each target (id), or of every node: unresolved sites and types from elsewhere within its span, and interfaces that nothing implements."""
    nodes = graph.nodes if targets is None else graph.nodes.join(targets.select("id"), "id", "left_semi")
    nodes = written(nodes.select("id", "kind", F.lower("file").alias("f"), "line", F.greatest("end_line", "line").alias("last")))
    sites = graph.unresolved.select("kind", "reason", F.lower("file").alias("f"), F.col("line").alias("at"))
    out = _counted_within(nodes, sites, ("kind", "reason"))
    bare = nodes.where("kind = 'interface'").select("id").join(graph.edges.where(F.col("kind").isin("Interface", "DiBinding")).select(F.col("src").alias("id")), "id", "left_anti")
    out = out.unionByName(bare.select("id", F.lit("interface").alias("kind"), F.lit("no-implementation").alias("reason"), F.lit(1).cast("long").alias("n")))
    if graph.external_types is not None:
        at = graph.external_types.select("name", F.explode("sites").alias("site")).select("name", F.lower(F.regexp_extract("site", r"^(.*):\d+$", 1)).alias("f"), F.regexp_extract("site", r":(\d+)$", 1).try_cast("int").alias("at"))
        outside = _counted_within(nodes, at, ("name",))
        out = out.unionByName(outside.select("id", F.lit("external-type").alias("kind"), F.col("name").alias("reason"), "n"))
    return out


def mentions(graph: Graph, target: int, most: int = 20) -> DataFrame:
    """(kind, file, line, expression): unresolved sites elsewhere whose text has the last part of the target's name, if that has three letters."""
    own = walk.one(graph, target).select(F.lower(leaf("short")).alias("leaf"), F.lower("file").alias("own"), F.col("line").alias("a"), F.greatest("end_line", "line").alias("b")).where(F.length("leaf") >= 3)
    met = graph.unresolved.crossJoin(F.broadcast(own)).where(F.contains(F.lower("expression"), F.col("leaf")))  # one row
    met = met.where(~((F.lower("file") == F.col("own")) & F.col("line").between(F.col("a"), F.col("b"))))
    return met.select("kind", "file", "line", "expression").orderBy("file", "line", "expression").limit(most)


def silence(graph: Graph, target: int) -> DataFrame:
    """(outgoing, incoming, reasons): one row on why a node may look lonely."""
    counts = graph.edges.agg(F.count_if((F.col("src") == target) & is_flow()).alias("outgoing"), F.count_if((F.col("dst") == target) & (F.col("kind") != "TypeUse")).alias("incoming"))
    return counts.crossJoin(reasons(graph, walk.one(graph, target)).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("reasons")))


def dead_ends(graph: Graph, start: int, depth: int = 12) -> DataFrame:
    """(id, level): nodes reached from `start` or what it holds from which no flow goes on."""
    begin = walk.seeds(walk.expand(graph, walk.one(graph, start)), order=F.col("ord"))
    reached = begin.unionByName(walk.walk(walk.flow(graph), begin, depth, rank=[F.round((1 - score()) * 1_000_000)]))
    return reached.select("id", "level").join(graph.edges.where(is_flow()).select(F.col("src").alias("id")), "id", "left_anti")


def silence_between(graph: Graph, start: int, goal: int, depth: int = 12, most: int = 5) -> DataFrame:
    """(answer, id, n): why `start` doesn't reach `goal`.

    path with its hops, if it does; else the dead ends of the walk with the most reasons, with their number, and reverse, with the hops
    of the other way round, if that exists."""
    row = lambda answer, id_, n: graph.nodes.sparkSession.range(1).select(F.lit(answer).alias("answer"), F.lit(id_).cast("long").alias("id"), F.lit(n).cast("long").alias("n"))
    there = walk.hops(graph, start, goal, depth).first()["hops"]
    if there:
        return row("path", goal, there)
    ends = dead_ends(graph, start, depth).select("id").distinct()
    why = reasons(graph, ends).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    worst = ends.join(why, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "id").limit(most)
    back = walk.hops(graph, goal, start, depth).first()["hops"]
    out = worst.select(F.lit("dead-end").alias("answer"), "id", F.col("n").cast("long").alias("n"))
    return out.unionByName(row("reverse", start, back)) if back else out


def overloads(graph: Graph, name: str) -> DataFrame:
    """(id, name, key, signature) of the methods of a name, in order."""
    return graph.nodes.where((F.lower(leaf("short")) == name.lower()) & (F.col("kind") == "method")).select("id", "name", "key", "signature").orderBy("name", "key")


def context(graph: Graph, target: int, depth: int = 3) -> DataFrame:
    """(section, place, text): role, members, callers, callees, implementations, entrypoints, impact and files of a node, each list cut as a report cuts it."""
    own = walk.one(graph, target)
    top = lambda df, n, *order: df.orderBy(*order).limit(n).withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # noqa: E731  numbers n rows
    nodes = graph.nodes.select("id", "short", "kind", "file", "line", "tags")
    callers = walk.direct_callers(graph, target).join(nodes, "id")
    flow = graph.edges.where((F.col("src") == target) & is_flow()).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(F.when(F.col("note").eqNullSafe("di-bound"), 0).otherwise(1).alias("b"), (-score()).alias("s"), "ord")).alias("o"))
    callees = top(flow.join(nodes, "id"), 12, "o")
    impls = rank.implementations(graph, target).join(nodes.drop("kind"), "id").where("place <= 8")
    reached = walk.reverse_reach(graph, target, depth).join(nodes.drop("kind"), "id")
    eps = top(reached.where(is_entrypoint()), 10, "level", "ord")
    called = top(callers, 12, "is_test", "id")
    held = own.where(F.col("kind").isin(*TYPES)).select(F.col("id").alias("src")).join(graph.edges.where("kind = 'TypeUse'").where(F.col("note").isin("member", "ctor")).select("src", F.col("dst").alias("id")), "src").join(nodes, "id")
    members = top(held, 20, (F.col("kind") == "method").cast("int"), "line", "id")
    impact = callers.agg(F.count(F.lit(1)).alias("a")).crossJoin(reached.agg(F.count(F.lit(1)).alias("b"))).crossJoin(eps.agg(F.count(F.lit(1)).alias("c")))  # a row each
    files = own.select("file", F.lit(0).alias("g"), F.lit(0).alias("n"))
    for g, part in enumerate((called, callees, impls.withColumnRenamed("place", "n"), eps), 1):
        files = files.unionByName(part.select("file", F.lit(g).alias("g"), "n"))
    files = top(files.where("file <> ''").groupBy(F.lower("file").alias("file")).agg(F.min(F.struct("g", "n")).alias("o")), 10, "o")
    sections = [
        ("ROLE", own, F.lit(1), F.concat_ws("  ", F.array_distinct(F.concat(F.array("kind"), F.filter("tags", lambda t: ~t.startswith("http:") & ~t.startswith("route:")))))),
        ("MEMBERS", members, F.col("n"), F.col("short")), ("CALLED BY", called, F.col("n"), F.col("short")), ("CALLS", callees, F.col("n"), F.col("short")),
        ("IMPLEMENTATION", impls, F.col("place"), F.col("short")), ("ENTRYPOINTS", eps, F.col("n"), F.col("short")),
        ("IMPACT", impact, F.lit(1), F.format_string("%d direct caller(s), %d reachable member(s), %d entrypoint(s)", "a", "b", "c")), ("FILES", files, F.col("n"), F.col("file")),
    ]
    out = None
    for name, df, n, text in sections:
        part = df.select(F.lit(name).alias("section"), n.cast("long").alias("place"), text.alias("text"))
        out = part if out is None else out.unionByName(part)
    return out
