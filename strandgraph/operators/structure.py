"""Structure of the graph as a whole: cycles, collapsed views, stable ids and diagrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..components import connected_components
from ..functions.predicates import TYPES, TRUST, is_flow, is_synthetic, is_test, score
from ..functions.text import dot, mermaid
from ..graph import WRITE, Graph
from ..tables import written
from . import walk


def groups(graph: Graph, level: str) -> DataFrame:
    """(id, grp): the group of each node at the level of types (by short name), namespaces or projects; nodes without one are left out."""
    if level == "project":
        return graph.nodes.where("project <> ''").select("id", F.col("project").alias("grp"))
    types = graph.nodes.where(F.col("kind").isin("type", "interface")).select("id", "short", "name")
    if level == "type":
        owned = graph.edges.where("kind = 'TypeUse'").join(types.select(F.col("id").alias("src"), "short"), "src").groupBy(F.col("dst").alias("id")).agg(F.min_by("short", "ord").alias("grp"))
        return types.select("id", F.col("short").alias("grp")).unionByName(owned.join(types.select("id"), "id", "left_anti"))
    return namespaces(graph)


def namespaces(graph: Graph) -> DataFrame:
    """(id, grp): the name in front of the longest declared type that a node's name begins with, else in front of its last dot; prefixes are joined as keys, not searched for."""
    declared = graph.nodes.where(F.col("kind").isin(*TYPES)).select(F.col("name").alias("prefix")).distinct()
    parts = F.split("name", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    each = graph.nodes.select("id", "name", F.explode(prefixes).alias("prefix"))
    types = each.join(declared, "prefix")
    # The shortest declared prefix is the outermost type; what stands before it is no type.
    outer = types.groupBy("id").agg(F.min_by("prefix", F.length("prefix")).alias("outer"))
    return graph.nodes.select("id", "name").join(outer, "id", "left").select("id", F.regexp_extract(F.coalesce("outer", "name"), r"^(.*)\.[^.]*$", 1).alias("grp"))


def collapsed(graph: Graph, level: str) -> DataFrame:
    """(a, b): flow between different groups, once each."""
    g = groups(graph, level)
    flow = graph.edges.where(is_flow()).select("src", "dst").join(g.select(F.col("id").alias("src"), F.col("grp").alias("a")), "src").join(g.select(F.col("id").alias("dst"), F.col("grp").alias("b")), "dst")
    return flow.where("a <> b").select("a", "b").distinct()


def _least_reaching(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (node, label) lowered along edges (a, b) until none falls: the least label that reaches a node."""
    while True:
        sent = edges.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("new"))
        moved = written(labels.join(sent, "node", "left").select("node", F.least("label", F.coalesce("new", "label")).alias("label"), (F.col("new") < F.col("label")).alias("fell")))
        labels = moved.select("node", "label")
        if moved.where("fell").isEmpty():
            return labels


def _trimmed(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The edges without nodes that nothing enters or leaves, and whether any went."""
    both = written(edges.select(F.col("a").alias("n")).distinct().join(edges.select(F.col("b").alias("n")).distinct(), "n", "left_semi"))
    kept = written(edges.join(both.select(F.col("n").alias("a")), "a", "left_semi").join(both.select(F.col("n").alias("b")), "b", "left_semi"))
    return kept, kept.count() < edges.count()


def _chains(edges: DataFrame) -> DataFrame:
    """Edges (a, b) from a node that has no other way out to one that has no other way in: every cycle through one end goes through the other."""
    out = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("a")
    into = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("b")
    return written(edges.where("a <> b").join(out, "a", "left_semi").join(into, "b", "left_semi"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components of more than one node; component is the least node.

    Nodes without edges in or out are trimmed and chains are drawn together into one node, over and over, so that long cycles and tails
    take rounds by the logarithm of their length. Then the least label that reaches a node, taken forward, cuts the graph into
    parts, of which those that reach their label's node back are its component. What is left goes on. Every loop ends when
    nothing changes, never after a number of rounds."""
    edges = written(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    first = edges
    stands: DataFrame | None = None  # (node, at): the node that a node was drawn into
    done: list[DataFrame] = []  # (node, component) of the nodes drawn together
    while True:
        while True:
            edges, shrunk = _trimmed(edges)
            chain = _chains(edges)
            if not chain.isEmpty():
                into = written(connected_components(chain))
                sizes = into.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(chain.join(into, chain["a"] == into["node"]).groupBy("component").agg(F.count(F.lit(1)).alias("m")), "component")
                rings = written(sizes.where("n = m").select("component"))  # a chain that closes is a component as it is
                done.append(written(rings.select(F.col("component").alias("node"), "component")))
                rest = edges.join(chain, ["a", "b"], "left_anti")
                for end in ("a", "b"):
                    rest = rest.join(into.select(F.col("node").alias(end), F.col("component").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
                edges = written(rest.select("a", "b").distinct())
                moved = into.select("node", F.col("component").alias("at"))
                if stands is None:
                    stands = moved
                else:
                    again = stands.join(moved.select(F.col("node").alias("at"), F.col("at").alias("_to")), "at", "left").select("node", F.coalesce("_to", "at").alias("at"))
                    stands = again.unionByName(moved.join(stands, "node", "left_anti"))
                stands = written(stands)
                shrunk = True
            if not shrunk:
                break
        if edges.isEmpty():
            break
        nodes = edges.select(F.col("a").alias("node")).distinct()
        labels = _least_reaching(edges, written(nodes.select("node", F.col("node").alias("label"))))
        same = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la = lb").select("a", "b")
        same = written(same)
        back = _least_reaching(same.select(F.col("b").alias("a"), F.col("a").alias("b")), written(labels.select("node", F.col("node").alias("label"))))
        # Within a part, the root has the part's label; what comes back to it has that as its least label against the edges too.
        found = written(labels.join(back.withColumnRenamed("label", "back"), "node").where("label = back").select("node", F.col("label").alias("component")))
        loops = edges.where("a = b").select(F.col("a").alias("node"))
        many = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        real = many.where("n > 1").select("component").unionByName(found.join(loops, "node", "left_semi").select("component")).distinct()
        done.append(written(found.join(real, "component", "left_semi").select("node", "component")))
        edges = written(edges.join(found.select(F.col("node").alias("a")), "a", "left_anti").join(found.select(F.col("node").alias("b")), "b", "left_anti"))
    if not done:
        return first.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    found = reduce(DataFrame.unionByName, done)
    if stands is not None:  # back to the nodes that were drawn together
        drawn = stands.where("node <> at").join(found.select(F.col("node").alias("at"), "component"), "at").select("node", "component")
        found = found.unionByName(drawn)
    least = found.groupBy("component").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def shortest_loop(edges: DataFrame, start: str) -> list[str]:
    """A shortest way from `start` back to it over edges (a, b), the least node first among equals; empty if there is none."""
    at = edges.where(F.col("a") == start).select("b", F.array("a", "b").alias("path"))
    seen = None
    while True:  # ends: no node is come to twice
        at = written(at.groupBy("b").agg(F.min("path").alias("path")))
        end = at.where(F.col("b") == start).first()
        if end or at.isEmpty():
            return list(end["path"]) if end else []
        seen = at.select("b") if seen is None else seen.unionByName(at.select("b"))
        at = at.select(F.col("b").alias("a"), "path").join(edges, "a").join(seen, "b", "left_anti").select("b", F.concat("path", F.array("b")).alias("path"))


def test_projects(graph: Graph) -> DataFrame:
    return graph.nodes.where("project <> ''").groupBy("project").agg(F.count_if(is_test()).alias("t"), F.count(F.lit(1)).alias("n")).where("t * 2 > n").select("project")


def exported(graph: Graph, level: str, type_use: bool = False) -> DataFrame:
    """(a, b, kind, role, score, edges): the graph drawn between groups: no tests, no synthetic nodes, nothing within a group; roles by bitwise or, scores by their least."""
    shown = graph.nodes.where(~is_test() & ~is_synthetic()).join(test_projects(graph), "project", "left_anti").select("id")
    g = written(groups(graph, level).join(shown, "id"))
    edges = graph.edges if type_use else graph.edges.where("kind <> 'TypeUse'")
    both = edges.join(g.select(F.col("id").alias("src"), F.col("grp").alias("a")), "src").join(g.select(F.col("id").alias("dst"), F.col("grp").alias("b")), "dst")
    return both.where("a <> b").groupBy("a", "b", "kind").agg(F.bit_or(F.coalesce("role", F.lit(0))).cast("long").alias("role"), F.round(F.min(score()), 6).alias("score"), F.count(F.lit(1)).alias("edges"))


def withheld(graph: Graph, level: str) -> DataFrame:
    """(type_use, tests, synthetic, within, drawn): why edges aren't drawn, each counted where the first rule holds, and how many are."""
    test = graph.nodes.join(test_projects(graph).withColumn("tp", F.lit(True)), "project", "left").select("id", (is_test() | F.coalesce("tp", F.lit(False))).alias("t"), is_synthetic().alias("s"))
    g = groups(graph, level)
    rows = graph.edges.select("src", "dst", "kind")
    for end in ("src", "dst"):
        rows = rows.join(test.select(F.col("id").alias(end), F.col("t").alias(f"t_{end}"), F.col("s").alias(f"s_{end}")), end).join(g.select(F.col("id").alias(end), F.col("grp").alias(f"g_{end}")), end, "left")
    why = (
        F.when(F.col("kind") == "TypeUse", "type_use").when(F.col("t_src") | F.col("t_dst"), "tests").when(F.col("s_src") | F.col("s_dst"), "synthetic")
        .when(F.col("g_src").isNull() | F.col("g_dst").isNull() | (F.col("g_src") == F.col("g_dst")), "within").otherwise("drawn")
    )
    names = ("type_use", "tests", "synthetic", "within", "drawn")
    return rows.select(why.alias("why")).agg(*(F.count_if(F.col("why") == n).alias(n) for n in names))


def stable_ids(names: DataFrame, prefix: str = "n_", digits: int = 8) -> DataFrame:
    """(name, id): a prefix and as many hex digits of the name's SHA-256 as tell it from all others, 8 or 12 and so on."""
    rows = names.select("name").distinct().select("name", F.sha2(F.col("name").cast("binary"), 256).alias("h"), F.lit(digits).alias("n"))
    while True:
        cut = F.substring("h", F.lit(1), F.col("n"))
        met = rows.groupBy(cut.alias("cut")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        if met.isEmpty():
            return rows.select("name", F.concat(F.lit(prefix), cut).alias("id"))
        rows = written(rows.withColumn("cut", cut).join(met, "cut", "left").select("name", "h", F.when(F.col("c").isNotNull(), F.least(F.col("n") + 4, F.lit(64))).otherwise(F.col("n")).alias("n")))


def edge_label() -> Column:
    return F.concat("kind", F.when(F.col("score") < TRUST, F.concat(F.lit(" ?"), F.format_string("%.2f", "score"))).otherwise(""))


def diagram(view: DataFrame, form: str = "mermaid") -> DataFrame:
    """(place, line): a view of `exported` as Mermaid or DOT text; edges that write or aren't trusted are dashed."""
    ids = written(stable_ids(view.select(F.col("a").alias("name")).unionByName(view.select(F.col("b").alias("name")))))
    ends = view.join(ids.select(F.col("name").alias("a"), F.col("id").alias("ai")), "a").join(ids.select(F.col("name").alias("b"), F.col("id").alias("bi")), "b")
    dashed = (F.col("role").bitwiseAND(WRITE) != 0) | (F.col("score") < TRUST)
    spark = view.sparkSession
    if form == "mermaid":
        nodes = F.concat(F.lit("  "), "id", F.lit('["'), mermaid(F.col("name")), F.lit('"]'))
        edges = F.concat(F.lit("  "), "ai", F.when(dashed, ' -. "').otherwise(' -- "'), edge_label(), F.when(dashed, '" .-> ').otherwise('" --> '), "bi")
        head, tail = ["flowchart LR"], []
    elif form == "dot":
        nodes = F.concat(F.lit('  "'), "id", F.lit('" [label="'), dot(F.col("name")), F.lit('"];'))
        edges = F.concat(F.lit('  "'), "ai", F.lit('" -> "'), "bi", F.lit('" [label="'), edge_label(), F.when(dashed, '", style=dashed];').otherwise('"];'))
        head, tail = ["digraph G {"], ["}"]
    else:
        raise ValueError(f"no such form: {form}")
    row = lambda part, df, sort, line: df.select(F.struct(F.lit(part).alias("part"), sort.alias("sort")).alias("place"), line.alias("line"))
    fixed = spark.createDataFrame([(k, x) for k, x in ((0, head), (3, tail)) for x in x] or [], "part int, line string").select(F.struct("part", F.lit("").alias("sort")).alias("place"), "line")
    return fixed.unionByName(row(1, ids, F.col("name"), nodes)).unionByName(row(2, ends, F.concat_ws("\x01", "a", "b", "kind"), edges))


def lines(df: DataFrame) -> Iterator[str]:
    """The lines of a diagram in order, one partition at a time."""
    return (r["line"] for r in df.orderBy("place").toLocalIterator())


def around(graph: Graph, start: int, depth: int = 1, direction: str = "both", type_use: bool = False) -> DataFrame:
    """`walk.neighbourhood` over what a diagram would draw: no type use, no tests, no synthetic nodes."""
    shown = graph.nodes.where(~is_test() & ~is_synthetic()).join(test_projects(graph), "project", "left_anti").select("id")
    return walk.neighbourhood(graph, start, depth, written(shown), direction, type_use)
