"""Rankings and counts over nodes and edges: implementations, wiring sites, the map, entrypoints, quality, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import TYPES, exit_name, is_entrypoint, is_flow, is_inferred, is_test, score, under
from ..graph import Graph


def implementations(graph: Graph, target: int) -> DataFrame:
    """(id, kind, note, score, is_test, site, place): what implements, overrides or is bound to `target`, once each, bindings first; bound ones, then no tests, then by score."""
    own = graph.edges.where((F.col("src") == target) & F.col("kind").isin("Interface", "Override", "DiBinding"))
    best = F.min_by(F.struct("kind", "note", score().alias("score"), "ord"), F.struct(F.when(F.col("kind") == "DiBinding", 0).otherwise(1), "ord"))
    sites = F.min_by("site", F.when(F.col("kind") == "DiBinding", F.col("ord")))
    bound = F.max((F.col("kind") == "DiBinding") | F.col("note").eqNullSafe("di-bound"))
    rows = own.groupBy(F.col("dst").alias("id")).agg(best.alias("r"), sites.alias("site"), bound.alias("bound")).join(graph.nodes.select("id", is_test().alias("is_test")), "id")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("bound"), "is_test", F.desc("r.score"), "r.ord")  # of one target only
    return rows.select("id", "r.kind", "r.note", "r.score", "is_test", "site", F.row_number().over(order).alias("place"))


def wiring_sites(graph: Graph) -> DataFrame:
    """(src, dst, kind, site, matching, total) for edges of dispatch: their own site, else that of the best binding of their source."""
    bindings = graph.edges.where("kind = 'DiBinding'").select(F.col("src").alias("s"), F.col("dst").alias("d"), "site", score().alias("score"), "ord")
    per = bindings.groupBy("s").agg(F.count(F.lit(1)).alias("total"), F.min_by("site", F.struct((-F.col("score")).alias("a"), "ord")).alias("best"))
    pair = bindings.groupBy("s", "d").agg(F.count(F.lit(1)).alias("matching"), F.min_by("site", F.struct((-F.col("score")).alias("a"), "ord")).alias("exact"))
    hop = graph.edges.where(F.col("kind").isin("Interface", "Override")).select("src", "dst", "kind", F.col("site").alias("own"))
    out = hop.join(per, hop["src"] == per["s"], "left").drop("s").join(pair, (hop["src"] == pair["s"]) & (hop["dst"] == pair["d"]), "left")
    return out.select("src", "dst", "kind", F.coalesce("own", "exact", "best").alias("site"), F.coalesce("matching", F.lit(0)).alias("matching"), F.coalesce("total", F.lit(0)).alias("total"))


def entrypoints(graph: Graph, wanted: str | None = None, prefix: str | None = None) -> DataFrame:
    out = graph.nodes.where(is_entrypoint())
    if prefix:
        out = out.where(under("file", prefix))
    if wanted:
        low = wanted.lower()
        out = out.where(F.contains(F.lower("short"), F.lit(low)) | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(low))))
    return out.select("id", "short", "project", F.array_join("tags", ",").alias("tags"))


def map_header(graph: Graph, prefix: str | None = None) -> DataFrame:
    """(files, symbols, edges) in scope; an edge needs both ends there."""
    nodes = graph.nodes.where(under("file", prefix)) if prefix else graph.nodes
    edges = graph.edges
    if prefix:
        for end in ("src", "dst"):
            edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    counts = nodes.agg(F.count_distinct(F.when(F.col("file") != "", F.lower("file"))).alias("files"), F.count(F.lit(1)).alias("symbols"))
    return counts.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # a row each


def map_projects(graph: Graph, refs: DataFrame, depths: DataFrame) -> DataFrame:
    """(project, types, entrypoints, symbols, depth, is_test, refs): mostly tests counts as a test project."""
    per = graph.nodes.groupBy("project").agg(F.count_if(F.col("kind").isin(*TYPES)).alias("types"), F.count_if(is_entrypoint()).alias("entrypoints"), F.count_if(is_test()).alias("tests"), F.count(F.lit(1)).alias("symbols"))
    out = refs.groupBy(F.col("src").alias("project")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("refs"))
    out = per.join(depths, "project", "left").join(out, "project", "left")
    return out.select("project", "types", "entrypoints", "symbols", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), (F.col("tests") * 2 > F.col("symbols")).alias("is_test"), F.coalesce("refs", F.lit("")).alias("refs"))


def common_prefix(names: DataFrame, column: str) -> DataFrame:
    """(prefix): the first dotted part, if all names share it, else empty."""
    head = F.substring_index(column, ".", 1)
    return names.agg(F.when(F.min(head) == F.max(head), F.min(head)).otherwise("").alias("prefix"))


def map_entrypoints(graph: Graph, most: int = 5) -> DataFrame:
    """(file, entrypoints, kinds): the files with the most."""
    kinds = F.array_distinct(F.transform(F.filter("tags", lambda t: t.startswith("http:") | t.isin("handler", "consumer", "hosted", "action")), lambda t: F.substring_index(t, ":", 1)))
    rows = graph.nodes.where(is_entrypoint() & (F.col("file") != "")).select(F.lower("file").alias("file"), "id", kinds.alias("kinds"))
    found = rows.groupBy("file").agg(F.count(F.lit(1)).alias("entrypoints"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))), ",").alias("kinds"))
    return found.orderBy(F.desc("entrypoints"), "file").limit(most)


def degrees(graph: Graph) -> DataFrame:
    """(id, callers): edges into a node that are no type use."""
    return graph.edges.where("kind <> 'TypeUse'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))


def busiest(graph: Graph, kinds: tuple[str, ...], most: int) -> DataFrame:
    """(id, short, callers): the nodes of these kinds, no tests, that more than one edge enters, by their number."""
    rows = degrees(graph).where("callers > 1").join(graph.nodes.where(F.col("kind").isin(*kinds) & ~is_test()).select("id", "short"), "id")
    return rows.orderBy(F.desc("callers"), "id").limit(most).select("id", "short", "callers")


def flow_counts(graph: Graph) -> DataFrame:
    return graph.edges.where(is_flow()).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


def edge_quality(graph: Graph) -> DataFrame:
    """(kind, edges, inferred, sources, lowest): edges by kind, those below the trusted score, and the lowest score."""
    return graph.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_if(is_inferred()).alias("inferred"), F.count_distinct("source").alias("sources"), F.round(F.min(score()), 6).alias("lowest"))


def inferred_by_source(graph: Graph) -> DataFrame:
    return graph.edges.where("confidence IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("edges"), F.round(F.min("confidence"), 6).alias("lowest"))


def resolution_rate(bound: Column, total: Column) -> Column:
    """Percent to one place, floored; 100 of nothing."""
    return F.when(total > 0, F.floor(1000 * bound / F.greatest(total, F.lit(1))) / 10).otherwise(100.0)


def usage_by(log: DataFrame, column: str, since: Column | None = None) -> DataFrame:
    """Invocations by caller or command: number, median of milliseconds and of tokens, sessions, hits."""
    rows = log.where(F.col("ts") >= since) if since is not None else log
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("runs"), F.median("ms").alias("median_ms"), F.median("out_tokens").alias("median_tokens"), F.count_distinct("session").alias("sessions"), F.count_if(F.col("exit") == 0).alias("hits"))


def usage_exits(log: DataFrame) -> DataFrame:
    return log.groupBy("exit").agg(F.count(F.lit(1)).alias("runs")).select(F.col("exit").cast("long").alias("exit"), exit_name("exit").alias("name"), "runs")


def never_used(log: DataFrame, commands: DataFrame) -> DataFrame:
    """Of (cmd), those that no invocation names."""
    return commands.join(log.select("cmd").distinct(), "cmd", "left_anti")


def within_budget(lines: DataFrame, cost: Column, order: list[Column], budget: int, by: list[str]) -> DataFrame:
    """The lines of each group that fit: the longest prefix of the order whose costs sum up to at most `budget`, with `upto` and whether the group was cut."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("cost", cost).withColumn("upto", F.sum("cost").over(w))
    return out.withColumn("cut", F.max("upto").over(Window.partitionBy(*by)) > budget).where(F.col("upto") <= budget)


#: What of a budget is kept for a closing mark, what an opening note may take, and beyond which budget none is suggested.
CLOSING, OPENING, CEILING = 40, 60, 4000


def answer_lines(lines: DataFrame, order: list[Column], budget: int, by: list[str], opening: int = 0) -> tuple[DataFrame, DataFrame]:
    """The (by, text) lines that an answer of a budget holds, and per group (shown, total, cost, fits): its size, and the budget that would hold it all, null beyond the ceiling."""
    from ..functions.predicates import token_cost

    kept = min(opening, OPENING) + CLOSING
    shown = within_budget(lines, token_cost("text"), order, max(0, budget - kept), by)
    whole = lines.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.sum(token_cost("text")).alias("cost"))
    need = F.col("cost") + kept + 10
    sizes = whole.join(shown.groupBy(*by).agg(F.count(F.lit(1)).alias("shown")), by, "left")
    return shown, sizes.select(*by, F.coalesce("shown", F.lit(0)).cast("long").alias("shown"), "total", "cost", F.when(need <= CEILING, need).alias("fits"))


def usage_tail(log: DataFrame, most: int = 10) -> DataFrame:
    """The latest invocations."""
    return log.orderBy(F.desc("ts"), "session", "cmd").limit(most).select("ts", "cmd", "caller", "exit")


def resolution(sites: DataFrame, calls: DataFrame, by: str) -> DataFrame:
    """(by, calls, failed, rate): the share of calls resolved, in percent to one place, floored, where `sites` are those that weren't."""
    both = calls.groupBy(by).agg(F.count(F.lit(1)).alias("calls")).join(sites.groupBy(by).agg(F.count(F.lit(1)).alias("failed")), by, "left")
    failed = F.coalesce("failed", F.lit(0))
    return both.select(by, "calls", failed.cast("long").alias("failed"), resolution_rate(F.col("calls") - failed, F.col("calls")).cast("double").alias("rate"))
